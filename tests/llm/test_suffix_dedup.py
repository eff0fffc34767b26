import hashlib
import random

import numpy as np
import pytest

from heliograph.llm import suffix_dedup as sd
from heliograph.llm.common import Workspace
from tests.llm.helpers import same_rows

DOC = "doc_id bigint, text string"


def brute(rows, length=100):
    """Texts that share a doc_id in the order of their hashes; equal rows are one occurrence."""
    seen, out, done = set(), [], {}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1]))):
        b = (t or "").encode()
        if (d, b) in done:
            out.append(done[d, b])
            continue
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cover[i] += 1
                cover[i + length if i + length < len(cover) else -1] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[: len(b)] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        done[d, b] = (d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
        out.append(done[d, b])
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1, 60, 1 << 18])
def test_intervals_hold_equal_windows(shard):
    random.seed(shard)
    segs = [bytes(random.choice(b"ab\x00\xff") for _ in range(random.randint(20, 60))) for _ in range(12)]
    segs += [segs[0][3:], segs[1][:30] + segs[2][:20], b"a" * 40, b"a" * 33]
    interval, first, _ = sd.repeats(segs, 5, 20, shard)
    at = {(s, i): interval[first[s] + i] for s, x in enumerate(segs) for i in range(len(x) - 19)}
    names = {}
    for (s, i), v in at.items():
        assert names.setdefault(segs[s][i : i + 20], v) == v
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("wide", [2, 8192])
def test_brute_force_and_edge_cases(spark, wide):
    random.seed(8)
    word = lambda: random.choice(["the ", "wörd ", "a", "xyz ", "\n", "q" * 9, "0 "])
    text = lambda n: "".join(word() for _ in range(n))
    common = [text(60) for _ in range(6)]
    rows = [(i, "".join(random.choice([text(random.randint(1, 30)), random.choice(common), random.choice(common)[7:150]]) for _ in range(random.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 200 + "a"), (104, common[0][:100].encode()[:99].decode("utf8", "ignore")), (-5, common[1]), (None, common[2]), (105, text(30000) + common[3])]
    rows += [(106, common[4] * 3), (107, rows[0][1]), (50, common[0] * 2), (50, text(80)), (50, text(80) + common[5]), (None, text(50)), (None, common[2]), (None, common[2] + common[3])]
    df = spark.createDataFrame([(*r, b"z") for r in rows], DOC + ", size binary")
    got = sorted(map(tuple, sd.dedup(df, wide=wide).collect()), key=repr)
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    t = "".join(chr(97 + i * i % 23) + str(i) for i in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (2, t[:50])], DOC)
    assert sorted(tuple(r)[:4] for r in sd.dedup(df).collect()) == [(1, len(t), 0, 0), (1, len(t), 0, 0), (2, 50, 0, 0)]
    assert sd.dedup(spark.createDataFrame([], DOC)).count() == 0


def test_texts_that_share_a_doc_id(spark):
    """Unique text is kept, whatever another text of that doc_id loses."""
    random.seed(31)
    x, y = ("".join(random.choice("abcdefgh ") for _ in range(200)) for _ in range(2))
    rows = [(1, x), (2, x), (2, y)]
    got = sorted(map(tuple, sd.dedup(spark.createDataFrame(rows, DOC)).collect()))
    assert got == brute(rows) and sorted(r[2] for r in got) == [0, 0, 200]


def test_equal_hashes_of_unequal_texts(spark):
    """Two texts found by lattice reduction whose polynomial hashes are equal; neither loses a byte."""
    rows = [(1, "tyyawoixzhsdkaaauramvgnxaqhyoprhlhvhyojangwiidpyqpumzgepcrprudfuxjdxkxwqnqvgjjspqmsbphxzmnvflrwyvxlc"), (2, "tyyawoixzhsdkaaauramvgnxaqhyoprhlhvhyojanescnjsyorupzhdpamnrudfuxjdxkxwqnqvgjjspqmsbphxzmnvflrwyvxlc")]
    df = spark.createDataFrame(rows, DOC)
    for part in (df.coalesce(1), df.repartition(2)):
        assert sorted(map(tuple, sd.dedup(part).collect())) == brute(rows)


def test_blocks_split_between_groups(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, sd.op1_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("batch", [1, 3, 4])
def test_groups_go_on_after_a_full_batch(spark, monkeypatch, batch):
    """A block gets full with the last row of an Arrow batch and its group goes on in the next one."""
    random.seed(17)
    line = bytes(random.choice(b"abcdefgh") for _ in range(100))
    rows = [(7, i, 0, 2, (line + b"%d" % (i % 10)) if i % 2 else (b"%d" % (i % 10) + line)) for i in range(30)]
    first, want = set(), {}
    for _, d, _, m, text in rows:
        want[d] = {i for i in range(m) if text[i : i + 100] in first}
        first |= {text[i : i + 100] for i in range(m)}
    monkeypatch.setattr(sd, "BLOCK_SYMBOLS", batch * 102)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = sd.merge_groups(spark.createDataFrame(rows, sd.SEGMENT), 100, 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {d: set() for d in want}
    for r in found:
        got[r.doc_id] |= set(range(r.start, r.start + r.size - 99))
    assert got == want


def test_windows_of_wide_groups_are_sent_once_a_task(spark):
    """A passage that many documents share, each with its own words around it, in groups that are dealt by windows."""
    random.seed(23)
    word = lambda n: "".join(random.choice("ijklmnop") for _ in range(n))
    line = "".join(random.choice("abcdefgh ") for _ in range(130))
    rows = [(i, word(random.randint(50, 90)) + line + word(random.randint(50, 90))) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    src, _ = sd.numbered(docs, Workspace(spark, "t"))
    judged = sd.judge_groups(sd.find_runs(src, 100, 45), 100, 5)
    assert judged.where("kind = 2").count() > 400
    sent = sd.fetch(src.repartition(8, "doc_id"), judged.where("kind > 0"), 100).where("bytes IS NOT NULL")
    assert sent.groupBy("pkey").count().agg({"count": "max"}).first()[0] <= 8
    assert sorted(map(tuple, sd.dedup(docs, wide=5).collect()), key=repr) == brute(rows)
    # runs of a crowded task do not go to their group
    found = sd.find_runs(src.coalesce(1), 100, 45)
    assert found.where("kind = 2").count() > 400 and found.where("kind = 3").count() > 0
    assert found.where("kind = 1").groupBy("pkey").count().agg({"count": "max"}).first()[0] < sd.CROWD
    assert sorted(map(tuple, sd.dedup(docs.coalesce(1)).collect()), key=repr) == brute(rows)
    assert sorted(map(tuple, sd.dedup(docs.repartition(3)).collect()), key=repr) == brute(rows)


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    assert same_rows(sd.op1_suffix_dedup(spark, sf), sd.ORACLE_SQL, sf) == 1000
