import random

import numpy as np
import pytest

from heliograph.llm.common import Workspace
from heliograph.llm.fm_dedup import ORACLE_SQL, FMIndex, Wavelet, op12_fm_dedup, pieces_of, byte_powers, sliding_least, without_repeats, word_starts
from tests.llm.helpers import same_rows

DOCS = "doc_id bigint, text string"


def brute(docs, window):
    split = [(i, (t or "").encode().split()) for i, t in docs]
    order = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, w in split:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            first[key] = min(first.get(key, order(i)), order(i))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < order(i):
                gone |= set(range(a, a + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def corpus(rng, n, words):
    """Texts with shared passages, copies, near copies and periodic stretches."""
    word = lambda: rng.choice(words)
    passages = [[word() for _ in range(rng.randrange(10, 60))] for _ in range(4)]
    docs = []
    for k in range(n):
        kind = rng.random()
        if docs and kind < 0.3:
            w = list(rng.choice(docs)[1])
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = word()
        else:
            w = []
            for _ in range(rng.randrange(1, 4)):
                w += [word() for _ in range(rng.randrange(30))] + (rng.choice(passages) if rng.random() < 0.7 else [word()] * rng.randrange(40))
        docs.append((rng.randrange(n), w))
    return [(i, "".join(x + rng.choice([" ", "\t", "\n", "  ", "\x0b"]) for x in w)) for i, w in docs]


@pytest.mark.parametrize("seed,crowd,block", [(1, 512, 1 << 19), (2, 2, 1 << 19), (3, 1, 40), (4, 512, 40)])
def test_brute_force(spark, seed, crowd, block):
    """Shards of one anchor and of all, crowded anchors and calm ones, small batches."""
    rng = random.Random(seed)
    docs = corpus(rng, 150, ["a", "bb", "ccc", "Ä", "ä", " ", "x-y", "🙂"])
    docs += [(None, docs[0][1]), (None, docs[0][1]), (3, docs[1][1]), (3, docs[1][1]), (7, None), (8, ""), (9, " \n"), (-1 << 62, docs[2][1]), (-1, docs[3][1])]
    df = spark.createDataFrame(docs, DOCS).repartition(6).selectExpr("*", "1 AS ord", "'x' AS digest", "2 AS n")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = without_repeats(df, Workspace(spark, "t"), window=12, crowd=crowd, block_words=block)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, 12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_passages_and_copies_of_fifty_words(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, short = fresh(50), fresh(49)
    docs = [(10 + k, " ".join(fresh(30) + (passage if k % 2 else short) + fresh(30))) for k in range(8)]
    docs += [(90, docs[0][1]), (91, " ".join(passage))]
    found = {r.doc_id: r.n_removed for r in without_repeats(spark.createDataFrame(docs, DOCS), Workspace(spark, "t")).collect()}
    assert found == {10: 0, 11: 0, 12: 0, 13: 50, 14: 0, 15: 50, 16: 0, 17: 50, 90: 109, 91: 50}


def test_empty_table_and_long_text(spark, monkeypatch):
    import heliograph.llm.fm_dedup as fm

    empty = without_repeats(spark.createDataFrame([], DOCS), Workspace(spark, "t"))
    assert empty.collect() == []
    rng = random.Random(6)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[20_000:50_000])), (3, "same " * 5000), (4, "same " * 49), (5, "same " * 51)]
    found = {r.doc_id: (r.n_words, r.n_removed) for r in without_repeats(spark.createDataFrame(docs, DOCS), Workspace(spark, "t")).collect()}
    assert found == {1: (60_000, 0), 2: (30_000, 30_000), 3: (5000, 0), 4: (49, 0), 5: (51, 51)}


def test_pieces_cover_all_windows(monkeypatch):
    import heliograph.llm.fm_dedup as fm

    rng = random.Random(7)
    joined = b" ".join(rng.choice([b"a", b"bc", b"d"]) for _ in range(3000))
    monkeypatch.setattr(fm, "STRETCH_WORDS", 700)
    starts = word_starts(joined)
    found = list(pieces_of(joined, starts, 50, byte_powers))
    assert [i for a, n, _ in found for i in range(a, a + n)] == list(range(3000 - 49))
    anchors = {}
    for a, n, anchor in found:
        for i in range(a, a + n):
            window = joined[starts[i] : starts[i + 50] - 1]
            assert anchors.setdefault(window, anchor) == anchor
    assert sliding_least(np.array([5, 3, 4, 1, 2, 6]), 3).tolist() == [3, 1, 1, 1]


@pytest.mark.parametrize("depth", [9, 12, 16, 33, 50])
def test_index_against_brute_force(depth):
    """Ranks, backward search and matching statistics, of sequences that the index does not hold too."""
    rng = np.random.default_rng(depth)
    pieces = [rng.integers(1, 4, rng.integers(depth, 3 * depth)) for _ in range(20)]
    text = np.concatenate([np.append(p, 0) for p in pieces])
    owner = np.repeat(rng.integers(0, 9, 20), [len(p) + 1 for p in pieces])
    index = FMIndex(text, 5, owner, depth)
    w = Wavelet(text, 5)
    for symbol in range(4):
        assert w.rank(np.full(len(text) + 1, symbol), np.arange(len(text) + 1)).tolist() == [0, *np.cumsum(text == symbol).tolist()]
    strange = [np.concatenate([pieces[3][: depth + 2], pieces[4], [4], pieces[5]]), rng.integers(1, 5, 80)]
    stream = np.concatenate([*pieces, *strange])
    lens = np.array([len(p) for p in [*pieces, *strange]])
    starts = np.cumsum(lens) - lens
    got, least = index.streamed(stream, starts, lens)
    held = {}
    for i in range(len(text)):
        for n in range(1, depth + 1):
            part = text[i : i + n]
            if len(part) < n or (part == 0).any():
                break
            key = part.tobytes()
            held[key] = min(held.get(key, 99), int(owner[i]))
    for a, n in zip(starts.tolist(), lens.tolist()):
        for i in range(a, a + n):
            best = max((m for m in range(1, min(depth, a + n - i) + 1) if stream[i : i + m].tobytes() in held), default=0)
            assert got[i] == best
            if best == depth:
                assert least[i] == held[stream[i : i + depth].tobytes()]


def test_query(spark, sf):
    assert same_rows(op12_fm_dedup(spark, sf), ORACLE_SQL, sf) == 200
