import random
import re
from itertools import combinations

import corpus_pipeline as cp
from heliograph.llm import similar as sm


def shingles(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted(r.doc_id for r in sm.near_duplicates(df).collect())


def test_planted_copies(spark):
    random.seed(5)
    word = lambda: f"w{random.randrange(3000)}"
    rows = [(1000, ""), (1001, None), (1002, "a B"), (1003, "A  b")]
    for g in range(6):
        base = [word() for _ in range(random.choice([30, 120, 400]))]
        for _ in range(random.choice([2, 40])):
            t = list(base)
            for _ in range(random.randint(0, len(t) // 40 + 1)):
                t[random.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    rows += [(2000 + i, " ".join(["one common line that many of the texts hold in them"] + [word() for _ in range(9)])) for i in range(60)]
    want = brute(rows)
    assert 20 < len({c for _, c in want}) < len(rows) - 20
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == [d for d, c in want if d == c]
    assert sm.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_stage_removes_copies_of_0_8(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(d for d, c in brute(rows) if d == c)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, sf).collect()) == want


def test_ids_that_are_null_or_shared(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, "x"), (None, a, "x"), (None, b, "x"), (2, c, "x"), (5, c, "x"), (5, d, "x"), (None, b, "y"), (7, None, "x"), (8, "", "x"), (None, d + " more", "x")]
    rows += [(30, "two of a kind", "y"), (30, "two of a kind", "x"), (31, "two of a kind", "x")] + [(40, "fifty of a kind", "x")] * 50
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept_id string")
    got = sm.near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, a, "x"), (None, b, "x"), (30, "two of a kind", "x"), (40, "fifty of a kind", "x"), (2, c, "x"), (5, d, "x"), (7, None, "x")]))


def test_any_order_of_shingles_finds_all_pairs(spark):
    """The sample of common shingles chooses an order and lengths of lists, no result: similar sets share a posting in every order."""
    import numpy as np

    random.seed(8)
    texts = []
    for _ in range(15):
        words = [f"w{random.randrange(500)}" for _ in range(random.randrange(30, 90))]
        texts += [" ".join(words), " ".join(words[: len(words) - random.randrange(1, 8)]), " ".join(words + ["more"] * 3)]
    sets = {sm.set_id(h): set(h.tolist()) for h in (sm.shingles(t.encode()) for t in texts)}
    near = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    all_ = np.array(sorted(set().union(*sets.values())), np.uint64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for common in (all_[:0], all_, all_[::2], all_[: len(all_) // 3]):
        keys = {}
        for r in sm.postings(docs, common).collect():
            keys.setdefault(r.u, set()).add(r.key)
        assert len(near) > 15 and all(keys[a] & keys[b] for a, b in near)


def test_tables_go_when_no_step_reads_them(spark, monkeypatch):
    from pathlib import Path

    made = []
    monkeypatch.setattr(sm, "Workspace", lambda *a, kind=sm.Workspace: made.append(kind(*a)) or made[-1])
    texts = ["a b c d e f g h i j", "a b c d e f g h i j k", "z y x w v u t s r q", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stays = sm.kept(docs)
    left = {p.name for p in Path(made[0].path.removeprefix("file://")).iterdir()}
    assert "sets" in left and not left & {"signatures", "lists", "entries-of-lists"}
    assert sorted(r.doc_id for r in stays.collect()) == [0, 2, 3]


def test_texts_are_read_again_for_likely_pairs_only(spark, monkeypatch):
    """Long texts that share many words pass the short sketch, which is full; the wide one, of the table of sets, tells them apart."""
    random.seed(9)
    word = lambda: f"w{random.randrange(100000)}"
    shared = [word() for _ in range(300)]
    texts = [" ".join(shared + [word() for _ in range(1000)]) for _ in range(6)]
    texts.append(texts[0] + " and a few more words")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    read, compared, hashes, exact = [], [], sm.set_hashes, sm.exact
    monkeypatch.setattr(sm, "set_hashes", lambda docs, wanted: read.append(wanted.count()) or hashes(docs, wanted))
    monkeypatch.setattr(sm, "exact", lambda pairs, *a: compared.append(pairs.count()) or exact(pairs, *a))
    assert found(docs) == [0, 1, 2, 3, 4, 5]
    assert max(compared) > 4  # candidates
    assert sum(read) == 2
