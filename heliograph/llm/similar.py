"""SimHash near-duplicates by exact similarity, for sets of word shingles.

Two documents are linked if their sets of ``SHINGLE``-word shingles have a Jaccard similarity of ``4 / 5`` or more. Candidates
come first from the positional byte index of the sets' fingerprints (:func:`heliograph.llm.simhash.links`). Four bits do not
cover that similarity (about ten of 64 bits differ at 0.8), so the sets are indexed as well: in any order of the shingles such a
pair shares one among the first n - ceil(4 n / 5) + 1 of each set of n, so each set is posted under these only (prefix
filter); common shingles, found in a sample, come last in the order, which decides lengths of lists but no result. Postings are
a shingle's hash and the set's; only lists of several sets get the sets' sizes and sketches. Pairs of a list pass by size and by
a parity sketch (its differing bits never exceed the differing shingles), which lose none, then by a wider sketch, which the table of
sets holds, and are verified by the sets, whose texts are read again for those in a pair that passed only. Each list first links its
members with its first; then only pairs of different components are compared.

Cases: words are split and lower-cased as for fingerprints; a text of fewer words is one shingle; wordless and null texts are equal.
Shingles and sets are 64-bit hashes. Rows with one doc_id and one text are one document, which stays once; rows that share a doc_id are linked
by their own texts; of a group the document with the smallest doc_id (null last), then the smallest hash of its text, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import Workspace, byte_view, only, ranges, release_shuffles, shuffle_partitions, strings
from heliograph.llm.simhash import LOWER, SEED, components, fingerprint, links as fingerprint_links

SHINGLE = 5
#: One text in so many is counted for common shingles; they occur at least so often in it, and at most so many are put last.
SAMPLE, COMMON, MOST_COMMON = 16, 20, 50_000
SKETCH = 4  # words of 64 bits
WIDE_SKETCH = 4096  # bits
NAMES = ["key", "u", "size", *[f"s{k}" for k in range(SKETCH)]]
SIGNATURE = "doc_id bigint, text_key bigint, set_id bigint, fp bigint, size int, " + ", ".join(f"s{k} bigint" for k in range(SKETCH)) + ", wide binary"


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's shingles."""
    words = text.translate(LOWER).split()
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(view[x:y], SEED) for x, y in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64))


def set_id(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)


def wide_sketch(h: np.ndarray) -> bytes:
    return np.packbits((np.bincount((h & np.uint64(WIDE_SKETCH - 1)).astype(np.int64), minlength=WIDE_SKETCH) & 1).astype(np.uint8)).tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and text, each document once a task at least."""
    src = only(docs, "doc_id", "text")
    return src.select(src["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def each_set(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of rows (first and stop) and their sets."""
    data, offs = byte_view(strings(batch, "text"))
    for a in range(0, batch.num_rows, 1000):
        b = min(a + 1000, batch.num_rows)
        yield a, b, [shingles(data[offs[r] : offs[r + 1]].tobytes()) for r in range(a, b)]


def signatures(docs: DataFrame) -> DataFrame:
    """Each row's set, its fingerprint, size and sketches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b, sets in each_set(batch):
                odd = [np.bincount((h & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1 for h in sets]
                sketch = np.packbits(np.array(odd, np.uint8), axis=1).view(np.int64)
                cols = [np.array([set_id(h) for h in sets], np.int64), fingerprint(sets).view(np.int64), np.array(list(map(len, sets)), np.int32), *[np.ascontiguousarray(sketch[:, k]) for k in range(SKETCH)], [wide_sketch(h) for h in sets]]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_key"), *map(pa.array, cols[:-1]), pa.array(cols[-1], pa.binary())], names=[c.split()[0] for c in SIGNATURE.split(", ")])

    return keyed(docs).mapInArrow(run, SIGNATURE)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many sampled texts have. A task counts its own before it sends them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            for _, _, sets in each_set(batch):
                new = [h for h in sets if (k := set_id(h)) not in seen and not seen.add(k)]
                if new:
                    h, n = np.unique(np.concatenate(new), return_counts=True)
                    some = n > 1  # a shingle of one text in a block of texts is not common
                    yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some])], names=["h", "n"])

    n = keyed(docs).where(F.pmod("text_key", F.lit(SAMPLE)) == 0).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = n.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()  # a bounded list
    return np.sort(np.array([r.h for r in top], np.int64).view(np.uint64))


def postings(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, u): each set under its prefix, once a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            for _, _, sets in each_set(batch):
                keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for h in sets:
                    k, n = set_id(h), len(h)
                    if k in seen or not n:
                        continue
                    seen.add(k)
                    late = np.isin(h, common)
                    keys.append(np.concatenate([h[~late], h[late]])[: n - -(-4 * n // 5) + 1])
                    ids.append(np.full(len(keys[-1]), k))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "u"])

    return keyed(docs).mapInArrow(run, "key bigint, u bigint")


def lists_of_several(posted: DataFrame) -> DataFrame:
    """The postings, each once, of keys that several sets have."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, u in whole_lists(it, ["key", "u"]):
            own = np.concatenate([[True], (key[1:] != key[:-1]) | (u[1:] != u[:-1])])  # a set can come from several tasks
            key, u = key[own], u[own]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(start, len(key)))
            several = np.repeat(count > 1, count)
            yield pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(u[several])], names=["key", "u"])

    n = shuffle_partitions(posted.sparkSession)
    return posted.repartition(n, "key").sortWithinPartitions("key", "u").mapInArrow(run, "key bigint, u bigint")


def near(size: np.ndarray, sketch: np.ndarray, a, b) -> np.ndarray:
    """Which pairs can be similar: 9 times the differing shingles are at most the sum of the sizes."""
    both = size[a] + size[b]
    differ = np.maximum(np.bitwise_count(sketch[a] ^ sketch[b]).sum(-1, dtype=np.int64), np.abs(size[a] - size[b]))
    return 9 * differ <= both


def whole_lists(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole lists; the last list of a batch may go on in the next."""
    held = None
    for batch in it:
        if not batch.num_rows:
            continue
        new = [batch.column(c).to_numpy() for c in names]
        if held is not None:
            new = [np.concatenate(x) for x in zip(held, new)]
        cut = int(np.searchsorted(new[0], new[0][-1]))
        held = [x[cut:] for x in new]
        if cut:
            yield [x[:cut] for x in new]
    if held is not None:
        yield held


def with_signature(lists: DataFrame, sets: DataFrame) -> DataFrame:
    return lists.join(sets.select(F.col("set_id").alias("u"), *NAMES[2:]), "u").select(*NAMES)


def first_links(entries: DataFrame) -> DataFrame:
    """Candidates (u, v): of each list, its first member with the others."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, u, size, *sketch in whole_lists(it, NAMES):
            size, sketch = size.astype(np.int64), np.stack(sketch, 1).view(np.uint64)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(start, len(key)))
            a, b = np.repeat(start, count - 1), ranges(start + 1, count - 1)
            good = near(size, sketch, a, b)
            pairs = np.unique(np.stack([u[a[good]], u[b[good]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    n = shuffle_partitions(entries.sparkSession)
    return entries.repartition(n, "key").sortWithinPartitions("key", "u").mapInArrow(run, "u bigint, v bigint")


def other_links(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """Candidates of the lists between components, each pair once a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, comp, u, size, *sketch in whole_lists(it, ["key", "component", *NAMES[1:]]):
            size, sketch = size.astype(np.int64), np.stack(sketch, 1).view(np.uint64)
            new = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(key))
            mixed = comp[start] != comp[stop - 1]  # sorted by component
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(start[mixed].tolist(), stop[mixed].tolist()):
                last = np.searchsorted(comp[i:j], comp[i:j], side="right") + i
                for a in range(i, int(np.searchsorted(comp[i:j], comp[j - 1])) + i):
                    b = np.arange(last[a - i], j)  # members of later components
                    b = b[near(size, sketch, a, b)]
                    one.append(np.full(len(b), u[a]))
                    two.append(u[b])
            pairs = np.unique(np.stack([np.concatenate(one), np.concatenate(two)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    n = shuffle_partitions(entries.sparkSession)
    named = entries.join(comp, entries["u"] == comp["node"], "left").select("key", F.coalesce("component", "u").alias("component"), *NAMES[1:])
    return named.repartition(n, "key").sortWithinPartitions("key", "component").mapInArrow(run, "u bigint, v bigint")


def fingerprint_pairs(sets: DataFrame, ws: Workspace) -> DataFrame:
    """Candidates whose fingerprints are equal or linked by the positional index."""
    least = ws.stage(sets.groupBy("fp").agg(F.min("set_id").alias("first_set")), "entries")
    linked = ws.stage(fingerprint_links(least.select("fp")), "fingerprint-links")
    one, two = (least.select(F.col("fp").alias(e), F.col("first_set").alias(f"set_{e}")) for e in ("u", "v"))
    far = linked.join(one, "u").join(two, "v").select(F.col("set_u").alias("u"), F.col("set_v").alias("v"))
    return far.unionByName(sets.join(least, "fp").select(F.col("first_set").alias("u"), F.col("set_id").alias("v")).where("u != v"))


def exact(pairs: DataFrame, rep: DataFrame, column: str, check) -> DataFrame:
    """The pairs (u, v) whose sets pass a check on a column of the table of sets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "m", "n")))
            yield batch.select(["u", "v"]).filter(pa.array([check(*r) for r in rows], pa.bool_()))

    a = rep.select(F.col("set_id").alias("u"), F.col(column).alias("a"), F.col("size").alias("m"))
    b = rep.select(F.col("set_id").alias("v"), F.col(column).alias("b"), F.col("size").alias("n"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b", "m", "n").mapInArrow(run, "u bigint, v bigint")


def set_hashes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, hashes and size of the sets of some documents (text_key, one for each set)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, _, sets in each_set(batch):
                cols = [pa.array([set_id(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["set_id", "hashes", "size"])

    found = keyed(docs).join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"]).select("text")
    return found.mapInArrow(run, "set_id bigint, hashes binary, size int")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, forest: bool) -> DataFrame:
    """Links among similar sets that join all that the similar ones of the pairs join. With ``forest`` each set is first verified with
    the smallest one it may be similar to, then only pairs of different components are; else all pairs are."""
    spark = docs.sparkSession
    ws = Workspace(spark, "similar")
    pairs = ws.stage(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    release_shuffles(spark)  # of the lists, which are far more than the pairs
    likely = ws.stage(exact(pairs, sets, "wide", can_be_alike), "likely")
    ws.drop("pairs")
    release_shuffles(spark)
    ids = likely.select(F.explode(F.array("u", "v")).alias("set_id")).distinct()  # far fewer than in the pairs
    rep = ws.stage(set_hashes(docs, sets.join(ids, "set_id", "left_semi").select("text_key")), "hashes")
    release_shuffles(spark)
    if forest:
        first = ws.stage(exact(likely.groupBy("v").agg(F.min("u").alias("u")), rep, "hashes", alike), "first")
        release_shuffles(spark)
        comp = components(first, ws)
        for end in ("u", "v"):
            likely = likely.join(comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
        rest = likely.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
        links = ws.stage(first.unionByName(exact(rest, rep, "hashes", alike)), "links")
        ws.drop("first")
    else:
        links = ws.stage(exact(likely, rep, "hashes", alike), "links")
    for name in ("hashes", "likely"):
        ws.drop(name)
    release_shuffles(spark)
    return links


def kept(docs: DataFrame) -> DataFrame:
    """doc_id and text_key of the one document that stays of each group, and its set_id and the group's component."""
    spark = docs.sparkSession
    ws = Workspace(spark, "similar")
    rows = ws.stage(signatures(docs), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    sets = ws.stage(rows.groupBy("set_id").agg(F.min(order).alias("least"), *[F.first(c).alias(c) for c in ("fp", *NAMES[2:], "wide")]).select("*", "least.text_key"), "sets")
    ws.drop("signatures")
    lists = ws.stage(lists_of_several(postings(docs, common_shingles(docs))), "lists")
    release_shuffles(spark)
    entries = ws.stage(with_signature(lists, sets), "entries-of-lists")
    ws.drop("lists")
    release_shuffles(spark)
    one = verified(first_links(entries).unionByName(fingerprint_pairs(sets, ws)), sets, docs, forest=True)
    two = verified(other_links(entries, components(one, ws)), sets, docs, forest=False)  # few are left
    ws.drop("entries-of-lists")
    comp = components(one.unionByName(two), ws)
    named = sets.join(comp, sets["set_id"] == comp["node"], "left").select("least", F.coalesce("component", "set_id").alias("component"))
    return named.groupBy("component").agg(F.min("least").alias("least")).select("component", "least.doc_id", "least.text_key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, of the one document that stays of each group."""
    stays = kept(docs).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    rows = docs.select("*")
    return once(rows.join(stays, same(rows, stays), "left_semi"), docs)


def same(rows: DataFrame, found: DataFrame) -> Column:
    return rows["doc_id"].cast("bigint").eqNullSafe(found["kept_id"]) & (F.xxhash64(rows["text"]) == found["kept_key"])


def once(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id and its text, once: of their other columns' values the first as JSON. Only such rows are regrouped."""
    keys = docs.select(F.col("doc_id").cast("bigint").alias("kept_id"), F.xxhash64("text").alias("kept_key"))
    several = Workspace(docs.sparkSession, "repeated").stage(keys.groupBy("kept_id", "kept_key").count().where("count > 1").select("kept_id", "kept_key"), "rows")
    if several.isEmpty():
        return rows
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    again = rows.join(several, same(rows, several), "left_semi")
    key = [F.col("doc_id").alias("kept_id"), F.xxhash64("text").alias("kept_key")]
    one = again.groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return rows.join(several, same(rows, several), "left_anti").unionByName(one.select("row.*"))


def alike(a: bytes, b: bytes, m: int, n: int) -> bool:
    return 9 * len(np.intersect1d(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), assume_unique=True)) >= 4 * (m + n)


def can_be_alike(a: bytes, b: bytes, m: int, n: int) -> bool:
    return 9 * int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum(dtype=np.int64)) <= m + n
