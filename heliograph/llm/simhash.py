"""SimHash near-duplicates through an inverted index on the fingerprints' byte positions.

Two 64-bit fingerprints with at most 4 differing bits agree in at least 4 of their 8 bytes. Each fingerprint is posted under each
choice of 4 byte positions with the bytes there, so such a pair meets in a posting list, and lists stay short (2 ** 32 byte values a
choice) until the fingerprints are many billions. In a list the shared positional bytes of a pair are tallied, pairs below 4 are
dropped, and the rest is verified bit by bit. Equal fingerprints are one entry. Lists link their entries by growing trees, all lists
of a batch in step: each list's next entry is compared with the entries not yet linked. A list's links thus number less
than its entries, and whatever is left out is reachable through them.

Links become components by alternating star contraction on tables in the shared folder. Tables that are joined are written
first, so that the adaptive skew join can split a fingerprint or component that many rows have.

Cases: null or wordless text has fingerprint zero and is linked like any other; texts of any length are read whole; rows that
share a doc_id are linked by their own texts, and component_id is the smallest doc_id reachable; null doc_ids are ignored when
the smallest is sought (null if there is no other); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import Workspace, blocks, byte_view, documents, only, release_shuffles, shuffle_partitions, strings

SHINGLE = 4
SEED = 42
MOST_BITS = 4
LEAST_BYTES = 8 - MOST_BITS
#: Choices of byte positions; a pair of close fingerprints agrees in one of them at least.
COVER = list(combinations(range(8), LEAST_BYTES))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text (rows of UTF-8 bytes)."""
    n = len(offs) - 1
    raw = data.tobytes().translate(LOWER)
    hashes: list[int] = []
    size = np.zeros(n, np.int64)
    digest = xxhash.xxh64_intdigest
    for r in range(n):
        words = raw[offs[r] : offs[r + 1]].split()
        if not words:
            continue
        line = b" ".join(words)
        view = memoryview(line)
        if len(words) <= shingle:
            hashes.append(digest(line, SEED))
            size[r] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        a, b = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
        hashes.extend([digest(view[x:y], SEED) for x, y in zip(a, b)])
        size[r] = len(a)
    return majority(np.array(hashes, np.uint64), size)


def majority(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that over half the hashes of each row have; ``size`` of them belong to it."""
    out = np.zeros(len(size), np.uint64)
    have = np.flatnonzero(size)
    if not len(have):
        return out
    first = (np.cumsum(size) - size)[have]
    for bit in range(64):
        ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), first)
        out[have] |= (2 * ones > size[have].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprint(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of sets of shingle hashes."""
    return majority(np.concatenate([np.zeros(0, np.uint64), *sets]), np.fromiter(map(len, sets), np.int64, len(sets)))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = byte_view(strings(batch, "text"))
            for i, j in blocks(offs):
                fp = fingerprints(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    src = only(docs, "doc_id", "text")
    return src.select(src["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def close_pairs(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes and differ in few enough bits."""
    x = fp[a] ^ fp[b]
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = np.flatnonzero(shared >= LEAST_BYTES)
    return near[np.bitwise_count(x[near]) <= MOST_BITS]


#: By the set of byte positions in which a pair agrees (bit p for position p), the first choice that is in it.
FIRST_CHOICE = np.array([next((k for k, c in enumerate(COVER) if all(m >> p & 1 for p in c)), len(COVER)) for m in range(256)])


def first_cover(x: np.ndarray) -> np.ndarray:
    """The first choice of positions in which a pair agrees, by the pair's differing bits."""
    same = x.view(np.uint8).reshape(-1, 8)[:, ::-1] == 0  # most significant byte first
    return FIRST_CHOICE[(same * (1 << np.arange(8))).sum(1)]


def grown(of: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that join all that is close in each list; ``of`` names the entries' lists, in order."""
    at = np.arange(len(of))
    reached = np.zeros(len(of), bool)  # linked already, not yet compared with the rest
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        size = np.diff(np.append(start, len(of)))
        own = np.repeat(np.arange(len(start)), size)
        rank = np.where(reached, 0, len(at)) + np.arange(len(at))  # reached entries come first
        pivot = np.minimum.reduceat(rank, start) % len(at)
        rest = np.flatnonzero(~reached & (np.arange(len(at)) != pivot[own]))
        near = rest[close_pairs(fp, pivot[own[rest]], rest)]
        one.append(at[pivot[own[near]]])
        two.append(at[near])
        reached[near] = True
        keep = np.ones(len(at), bool)
        keep[pivot] = False
        open_ = np.bincount(own, weights=~reached & keep, minlength=len(start)) > 0  # lists with entries that nothing reached
        some = np.bincount(own, weights=keep, minlength=len(start)) > 1
        keep &= (open_ & some)[own]
        of, fp, at, reached = of[keep], fp[keep], at[keep], reached[keep]
    return np.concatenate(one), np.concatenate(two)


def links(entries: DataFrame) -> DataFrame:
    """Links (u, v) between the fingerprints of the table fp; u and v are fingerprints."""
    n = shuffle_partitions(entries.sparkSession)
    byte = lambda i: F.shiftrightunsigned("fp", 8 * (7 - i)).bitwiseAND(255)
    keys = F.array(*[F.lit(k).cast("bigint") * (1 << 32) + sum(byte(p) * (1 << 8 * j) for j, p in enumerate(choice)) for k, choice in enumerate(COVER)])
    posted = entries.select(F.explode(keys).alias("key"), "fp").repartition(n, "key").sortWithinPartitions("key")

    def lists(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in it:
            k, f = (batch.column(c).to_numpy() for c in ("key", "fp"))
            if not len(k):
                continue
            k, f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            cut = int(np.searchsorted(k, k[-1]))  # the last list may go on in the next batch
            yield k[:cut], f[:cut]
            held_k, held_f = k[cut:], f[cut:]
        yield held_k, held_f

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, f in lists(it):
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(k)))
            several = np.repeat(size > 1, size)
            k, f = k[several], f[several]
            u, v = grown(k, f.view(np.uint64))
            mine = first_cover((f[u] ^ f[v]).view(np.uint64)) == k[u] >> 32  # of a pair's lists, the first one sends its link
            yield pa.RecordBatch.from_arrays([pa.array(f[u][mine]), pa.array(f[v][mine])], names=["u", "v"])

    return posted.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """node and its component's smallest node, for all nodes of the edges, by alternating large-star and small-star steps."""

    def star(df: DataFrame, small: bool) -> DataFrame:
        both = df.select("u", "v") if small else df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u")
        if small:  # u > v here: v and u itself go to the smallest
            out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        else:
            out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u != v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    now = ws.stage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    seen, k = mark(now), 0
    while seen[0]:
        k += 1
        new = ws.stage(star(star(now, False), True), f"edges-{k}")
        mine = mark(new)
        ws.drop(f"edges-{k - 1}")
        now = new
        if mine == seen:
            break
        seen = mine
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each row."""
    ws = Workspace(docs.sparkSession, "simhash")
    table = ws.stage(fingerprint_table(docs), "fingerprints")
    entries = ws.stage(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    edges = ws.stage(links(entries), "links")
    release_shuffles(docs.sparkSession)
    comp = components(edges, ws)
    # the components' smallest node is a fingerprint; what is wanted is the smallest doc_id
    joined = ws.stage(entries.join(comp, entries["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "joined")
    smallest = ws.stage(joined.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = ws.stage(joined.join(smallest, "component").select("fp", "component_id"), "named")
    return table.join(named, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
