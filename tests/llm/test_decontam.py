import hashlib
import random
import re

from heliograph.llm import decontam as dc
from tests.llm.helpers import same_rows


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, own in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    assert same_rows(dc.op8_decontam(spark, sf), dc.ORACLE_SQL, sf) == 1000
    assert dc.op8_decontam(spark, sf).where("contaminated").count() > 0


def test_brute_force_and_edge_cases(spark, monkeypatch):
    random.seed(5)
    text = lambda n: " ".join(random.choice(["a", "B", "é", "É", "K", "K", "x1", "c-d"]) for _ in range(n))
    items = [(1, text(3)), (2, text(5)), (3, ""), (4, None), (10, text(9)), (None, "zz"), (1, "a"), (1, "a"), (7, "Éa")]
    docs = [(i, text(random.randint(0, 40))) for i in range(30)] + [(100, None), (101, ""), (102, "..."), (103, "zz"), (None, "a"), (3, "dup zz"), (5, "a " * 30000)]
    docs += docs[:3]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id bigint, text string, n_words int")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, doc_id int")
    small = [r for r in docs if r[0] != 5 or len(r[1]) < 1000]
    for bound in (200_000, 0):
        monkeypatch.setattr(dc, "BROADCAST_ROWS", bound)
        got = sorted(map(tuple, dc.contaminated(d, b, 4).collect()), key=repr)
        plan = dc.contaminated(d, b, 4)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
        assert [g for g in got if g[1] < 1000] == brute(small, items, 4)
        assert [g[1:4] for g in got if g[1] >= 1000] == [(30000, 30000, 1)]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.contaminated(d, none).where("contaminated").count() == 0 and dc.contaminated(d, none).count() == len(docs)
    assert dc.contaminated(spark.createDataFrame([], "doc_id bigint, text string"), b).count() == 0


def test_native(spark, sf):
    plan = dc.op8_decontam(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_windows_beyond_a_broadcast(spark, monkeypatch):
    """The benchmark's side is shuffled: equal results, and no words or texts go along with the tokens."""
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, dc.contaminated(docs, bench).collect()), key=repr)
    assert any(r[-1] for r in want)
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    staged = {}
    keep = dc.Workspace.stage

    def stage(self, df, name):
        staged[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(dc.Workspace, "stage", stage)
    assert sorted(map(tuple, dc.contaminated(docs, bench).collect()), key=repr) == want
    assert not any("text#" in x or "words#" in x for x in staged["candidates"].splitlines() if "Exchange" in x)
