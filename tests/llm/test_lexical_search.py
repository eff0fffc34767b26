import math
import random
import re

import numpy as np
import pytest

from heliograph.llm.common import Workspace
from heliograph.llm.lexical_search import ORACLE_SQL, RESULT, accumulate, item_blocks, op13_lexical_search, radix_order, search, segments
from tests.llm.helpers import same_rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, best=10):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    out = []
    for item_id, text in sorted(set(items), key=lambda x: (x[0] is not None, x)):
        found = []
        for doc_id, words in bags:
            score = 0
            for t in set(terms(text)) & set(words):
                df = sum(t in w for _, w in bags)
                m = 10 + 90 * len(words) * n_docs // total
                tf = words.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, monkeypatch, seed):
    """Small segments, several blocks of items, ties, shared ids, nulls and repeated rows."""
    import heliograph.llm.lexical_search as ls

    monkeypatch.setattr(ls, "SEGMENT_DOCS", 5)
    rng = random.Random(seed)
    words = ["Ärger", "ärger", "A1", "a1", "Straße", "x", "y", "z", "9", "lang" * 30]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "_", "\x7f", "  "]) for _ in range(n))
    docs = [(rng.randrange(40), text(rng.randrange(12))) for _ in range(60)] + [(None, "x y"), (None, None), (5, ""), (6, " .,"), (7, "x y"), (7, "x y")]
    items = [(k, text(rng.randrange(1, 6))) for k in range(8)] + [(3, "x z"), (3, "x z"), (None, "y"), (20, None), (21, "nowhere"), (22, "...")]
    ddf, idf = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS)
    extra = ddf.selectExpr("*", "1 AS score", "2 AS item_id")
    want = brute(docs, items)
    assert rows(search(extra, idf, Workspace(spark, "t"))) == want
    assert rows(search(ddf, idf, Workspace(spark, "t"), block_terms=3)) == want
    assert len(list(item_blocks(idf, 3))) > 3


def test_radix_order():
    rng = np.random.default_rng(1)
    for bits in (1, 15, 16, 17, 40, 63):
        keys = rng.integers(0, 1 << bits, 5000, dtype=np.uint64)
        assert (radix_order(keys, bits) == np.argsort(keys, kind="stable")).all()


def test_long_documents_do_not_overflow():
    """90 * n * N beyond 64 bits."""
    n_docs, n_terms, n = 1 << 40, 1 << 52, 1 << 30
    item, doc, score = accumulate(np.array([n]), np.array([0]), np.array([0]), np.array([n]), n_docs, n_terms, np.array([7]), np.array([0, 1]), np.array([0]))
    m = 10 + 90 * n * n_docs // n_terms
    assert score.tolist() == [7 * (1_000_000_000 * n // (1000 * n + 8 * m))] and item.tolist() == doc.tolist() == [0]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        found = search(d, i, Workspace(spark, "t"))
        assert found.collect() == [] and found.dtypes == spark.createDataFrame([], RESULT).dtypes


def test_a_long_text_is_whole(spark):
    docs = spark.createDataFrame([(1, "q " * 400_000 + "end"), (2, "other words")], DOCS)
    lens = np.frombuffer(segments(docs.where("doc_id = 1"), {b"end": 0}).first()["lens"], "<i8")
    assert lens.tolist() == [400_001]
    assert [r.doc_id for r in search(docs, spark.createDataFrame([(1, "end")], ITEMS), Workspace(spark, "t")).collect()] == [1]


def test_query(spark, sf):
    assert same_rows(op13_lexical_search(spark, sf), ORACLE_SQL, sf) > 0
