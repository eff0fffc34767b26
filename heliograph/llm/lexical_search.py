r"""Ranked lexical search by sort-based accumulation.

The documents become segments: for a range of documents of one task, their lengths and the postings (term, document, occurrences) of
the items' terms. Document frequencies and lengths are summed over the segments. Then each segment is scored on its own, as a
document lies in one segment whole: the postings' impacts are spread over the items that hold the term, the item-document-impact
arrays are joined, keys that pack item and document are radix sorted (16 bits a pass), equal keys are summed by ``reduceat``,
and each item keeps its best in a heap. Only a task's best rows of each item are shuffled.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms (or of one larger item), so what is broadcast is bounded; each block scores
all documents.

Cases: null and termless texts match nothing and do not count; texts of any length are whole; rows that share a doc_id are documents of
their own; null doc_ids come after all others among equal scores; item rows that are equal count once, others that
share an item_id are ranked apart; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.llm.common import Workspace, documents, only, ranges, strings

#: Bytes of terms (letters in lower case), all others are spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BEST = 10
#: Terms of a block of items, counted for each item.
BLOCK_TERMS = 1 << 20
#: Documents and postings of a segment, more only for the postings of its last document.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 13, 1 << 18
SEGMENT = "doc_ids array<bigint>, lens binary, terms binary, docs binary, tfs binary"
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def item_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Blocks of (item_id, distinct terms); the driver holds one at a time."""
    src = only(items, "item_id", "text").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    block, n = [], 0
    for r in src.toLocalIterator():
        found = sorted(set(terms_of(r.text or "")))
        if block and n + len(found) > block_terms:
            yield block
            block, n = [], 0
        if found:
            block.append((r.item_id, found))
            n += len(found)
    if block:
        yield block


def segments(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Lengths and postings of the vocabulary's terms, a row a range of documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        has, at = number.__contains__, number.__getitem__
        ids, lens, counts, terms, tfs = [], [], [], [], []

        def segment() -> pa.RecordBatch:
            post = np.repeat(np.arange(len(ids), dtype="<i4"), counts)
            raw = [np.asarray(lens, "<i8"), np.asarray(terms, "<i4"), post, np.asarray(tfs, "<i8")]
            cols = [pa.array([ids], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in raw]]
            for x in (ids, lens, counts, terms, tfs):
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=["doc_ids", "lens", "terms", "docs", "tfs"])

        for batch in it:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text")):
                words = terms_of(text.as_py())
                if words:
                    found = Counter(filter(has, words))
                    ids.append(doc_id)
                    lens.append(len(words))
                    counts.append(len(found))
                    terms.extend(map(at, found))
                    tfs.extend(found.values())
                    if len(ids) >= SEGMENT_DOCS or len(terms) >= SEGMENT_POSTINGS:
                        yield segment()
        if ids:
            yield segment()

    src = only(docs, "doc_id", "text")
    return src.select(src["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, SEGMENT)


def rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in it:
        for r in range(batch.num_rows):
            raw = [np.frombuffer(batch.column(name)[r].as_buffer(), kind) for name, kind in (("lens", "<i8"), ("terms", "<i4"), ("docs", "<i4"), ("tfs", "<i8"))]
            yield batch.column("doc_ids")[r].values, *raw


def statistics(segs: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and each known term's number of documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(n_terms, np.int64)
        for _, lens, terms, _, _ in rows_of(it):
            n, total = n + len(lens), total + int(lens.sum())
            df += np.bincount(terms, minlength=n_terms)
        seen = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], seen]), pa.int64()), pa.array(np.concatenate([[n, total], df[seen]]), pa.int64())], names=["term", "n"])

    found = {r.term: r.n for r in segs.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term of the block
    df = np.zeros(n_terms, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(-1, 0), found.get(-2, 0), df


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order of the keys, by stable passes over 16 bits from the lowest."""
    order = np.arange(len(keys))
    for at in range(0, bits, 16):
        digit = ((keys >> np.uint64(at)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]  # a radix sort for this type
    return order


def accumulate(lens, terms, docs, tfs, n_docs: int, n_terms: int, weights, starts, members) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of all pairs with a score above 0, sorted by item and document. ``members[starts[t]:starts[t + 1]]`` are
    the items of term t."""
    if len(lens) and 90 * int(lens.max()) * n_docs >= 1 << 63:
        m = np.array([10 + 90 * n * n_docs // n_terms for n in lens.tolist()], np.int64)
    else:
        m = 10 + 90 * lens * n_docs // n_terms
    impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))
    spread = starts[terms + 1] - starts[terms]
    low = max(1, int(len(lens) - 1).bit_length())
    item = members[ranges(starts[terms], spread)]
    keys = (item.astype(np.uint64) << np.uint64(low)) | np.repeat(docs, spread).astype(np.uint64)
    order = radix_order(keys, low + int(item.max(initial=0)).bit_length())
    keys, impact = keys[order], np.repeat(impact, spread)[order]
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    score, keys = np.add.reduceat(impact, first), keys[first]
    keys, score = keys[score > 0], score[score > 0]
    return (keys >> np.uint64(low)).astype(np.int64), (keys & np.uint64((1 << low) - 1)).astype(np.int64), score


def best_of_tasks(segs: DataFrame, block: list[tuple[int | None, list[bytes]]], vocabulary: dict[bytes, int], best: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best documents of each item."""
    n_docs, n_terms, df = statistics(segs, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    holder = np.repeat(np.arange(len(block)), [len(t) for _, t in block])
    term = np.array([vocabulary[t] for _, ts in block for t in ts], np.int64)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    shared = segs.sparkSession.sparkContext.broadcast((weights, starts, holder[order], [i for i, _ in block]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, members, item_ids = shared.value
        heaps: dict[int, list[tuple[int, int, int]]] = {}
        for ids, lens, terms, docs, tfs in rows_of(it):
            null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            item, doc, score = accumulate(lens, terms, docs, tfs, n_docs, n_terms, weights, starts, members)
            edges = np.nonzero(np.concatenate([[True], item[1:] != item[:-1], [True]]))[0] if len(item) else [0]
            for a, b in zip(edges[:-1], edges[1:]):
                heap, s = heaps.setdefault(int(item[a]), []), score[a:b]
                least = heap[0][0] if len(heap) == best else 1
                if b - a > best:
                    least = max(least, int(np.partition(s, b - a - best)[b - a - best]))
                for x in (a + np.nonzero(s >= least)[0]).tolist():
                    entry = (int(score[x]), -int(null[doc[x]]), -int(number[doc[x]]))  # the worst one is the heap's first
                    if len(heap) < best:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
        rows = [(i, item_ids[i], None if null else -neg, s) for i, heap in heaps.items() for s, null, neg in heap]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "item_id", "doc_id", "score"])

    return segs.mapInArrow(run, "item bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, ws: Workspace, best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    out = None
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for k, block in enumerate(item_blocks(items, block_terms)):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in block for t in ts}))}
        segs = ws.stage(segments(docs, vocabulary), f"segments{k}")
        ranked = best_of_tasks(segs, block, vocabulary, best).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best)
        ranked = ws.stage(ranked.select("item_id", "rank", "doc_id", "score"), f"ranked{k}")
        ws.drop(f"segments{k}")
        out = ranked if out is None else out.unionByName(ranked)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "lexical-search"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, n, t),
g AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT nd FROM s) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f GROUP BY t),
r AS (SELECT q.item_id, f.doc_id, CAST(sum(g.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * f.n * s.nd) // s.nt)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN g USING (t), s GROUP BY q.item_id, f.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 10
"""
