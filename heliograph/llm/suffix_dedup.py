"""Exact removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A window is a string of ``LENGTH`` bytes of one document. Every byte under a window that also starts earlier (in a smaller
doc_id, or earlier in the document) is removed; windows are judged on the input.

1. Anchors. The smallest hash of a ``GRAM``-byte gram in a window (leftmost if equal) is its anchor. Windows in a row with one
   anchor make a run, and its text a segment. Equal windows have equal anchors at equal offsets, so they only meet in runs
   whose anchors have equal hashes, and a run's own windows all differ. Of segments that are equal byte by byte each task keeps
   the first; the others are removed whole. The rest is brought together by anchor (a group) with a digest of the segment. Equal
   digests under one anchor make a class, of which all but the first are removed whole; groups of one class are done.
2. Segments that are first of their class, in groups of several classes, get their text. Groups are packed into blocks, segments of
   equal bytes become one, and a block's segments are dealt into shards. Each shard is suffix-sorted and gives the transform over symbols of ``STEP`` bytes.
   The interleave of the shards starts with all suffixes in one interval; each round puts the shards' next symbols, taken
   in the order of the interleave, into buckets, which refines the interleave by one more symbol and marks where the common
   prefix of neighbours ends. After LENGTH / STEP rounds the intervals hold the equal windows of all shards; no
   suffixes are sorted anew. In each interval every window but the first is removed.
3. A hot anchor (a line that very many documents have, each between other words) is split by its windows: each window then is
   a segment with its own hash as anchor, and goes through the same steps; a task sends a window's first occurrence only. A
   group is split if a task has ``CROWD`` runs of it, which then do not go to the group but for one mark, or if it
   has ``WIDE`` runs in all. Splitting changes no result.

Anchors are found by plain hashes, which only bring rows together. Digests are 64 bits of BLAKE2 under a key that is drawn anew for each run
and that no text can be made for; unequal segments of one anchor, length and digest would be taken as equal (2 ** -64 a pair).
Sending every segment's bytes instead exceeds the check tool's disk (see the README). All else is decided by bytes.

Cases: null text is empty; texts shorter than a window lose nothing; texts of any length are read whole. Rows with one doc_id
and one text are one occurrence and get equal results. Texts that share a doc_id are documents of their own, in the
order of their SHA-256. Null doc_ids come before all others. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import BLOCK_BYTES, Workspace, blocks, byte_view, documents, only, ranges, release_shuffles, shuffle_partitions, strings

LENGTH = 100
GRAM = 45
STEP = 5
#: Runs that a task gathers before it reduces them.
ROWS_AT_ONCE = 400_000
#: Symbols of a block and of a shard.
BLOCK_SYMBOLS = 1 << 18
SHARD_SYMBOLS = 1 << 16
#: Runs of one group, in a task and in all, from which on the group is split by its windows.
CROWD, WIDE = 64, 8192
#: Distinct windows of wide groups, and spans, that a task gathers before it sends them on.
WINDOWS_AT_ONCE = 200_000
#: Fixed value: an odd multiplier; grams are hashed as polynomials in it, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
#: Bits of an offset in a text; above them stands the number of a text that shares its doc_id with others.
PLACE = 31
#: Bytes compared at once.
COMPARE = 1 << 22
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
EMPTY = np.zeros(0, np.int64)


class Powers:
    """Powers of BASE and of its inverse, as many as were needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            one = np.ones(1, np.uint64)
            m = max(n, 2 * len(cls.up), BLOCK_BYTES + 1)
            cls.up = np.cumprod(np.concatenate([one, np.full(m - 1, BASE, np.uint64)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([one, np.full(m - 1, pow(BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segment_hash(raw: np.ndarray, start: np.ndarray, size: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """48 bits of a hash over each range of the block."""
    _, down = Powers.get(len(raw) + 1)
    return mixed((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64)) >> np.uint64(16)


def runs(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, start in the block, windows, anchor hash and segment hash of all runs in a block."""
    n, width = len(data), length - gram + 1
    size = np.diff(offs)
    windows = np.maximum(0, size - length + 1)
    if not windows.sum():
        return EMPTY, EMPTY, EMPTY, EMPTY, EMPTY
    up, down = Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    bits = np.uint64(int(n).bit_length())
    least = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    doc = np.repeat(np.arange(len(size)), windows)
    at = ranges(offs[:-1], windows)
    anchor = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(first, len(at)))
    start, anchor, doc = at[first], anchor[first], doc[first]
    seg = segment_hash(data, start, count + length - 1, sums)
    return doc, start, count, h[anchor].view(np.int64), seg.view(np.int64)


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of ranges hold equal bytes."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + COMPARE, side="right")))
        n = size[i:j]
        out[i:j] = np.logical_and.reduceat(data[ranges(a[i:j], n)] == data[ranges(b[i:j], n)], np.cumsum(n) - n)
        i = j
    return out


def reduced(data: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, seg: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose bytes (``size`` of them from ``at`` on) no earlier row has, and rows that repeat an earlier one. Hashes propose,
    bytes decide; rows whose hashes alone are equal stay."""
    order = np.lexsort((start, doc, size, seg, key))
    k, s, n = key[order], seg[order], size[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])]) if len(order) else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    other = (doc[order] != doc[head]) | (start[order] != start[head])
    row, first = order[other], head[other]
    same = equal_bytes(data, at[row], at[first], size[row])
    return np.concatenate([order[new], row[~same]]), row[same]


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, text by text."""
    if not len(doc):
        return EMPTY, EMPTY, EMPTY
    text = start >> PLACE
    order = np.lexsort((start, doc))
    d, x = doc[order], text[order]
    a, b = start[order] - (x << PLACE), stop[order] - (x << PLACE)
    name = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])).astype(np.int64)
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(b + name * far)
    new = np.concatenate([[True], a[1:] + name[1:] * far > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return d[first], a[first] + (x[first] << PLACE), reach[last] - name[first] * far + (x[first] << PLACE)


#: Kinds of rows: a span that is surely removed, a run, a run of a hot group, the mark of a hot group.
SPAN, RUN, HOT, MARK = 0, 1, 2, 3
FOUND = "kind int, pkey bigint, doc_id bigint, start bigint, size int, digest bigint"


def found_batch(kind, key, doc, start, size, digest=0) -> pa.RecordBatch:
    cols = [pa.array(np.broadcast_to(np.int32(kind), len(doc)) if np.ndim(kind) == 0 else kind.astype(np.int32)), pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(np.asarray(size).astype(np.int32)), pa.array(np.broadcast_to(np.int64(digest), len(doc)) if np.ndim(digest) == 0 else digest, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FOUND.split(", ")])


def scattered(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys that deal rows out evenly."""
    return mixed(doc.view(np.uint64) + start.astype(np.uint64)).view(np.int64)


def own_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def numbered(docs: DataFrame, ws: Workspace) -> tuple[DataFrame, bool]:
    """doc_id (null as ``NO_ID``), n, copies and text. Where a doc_id comes in several rows, equal texts are one row with their
    number, and different ones are numbered by n from 1 on; else n is 0. And whether there are such doc_ids."""
    src = only(docs, "doc_id", "text")
    src = src.select(F.coalesce(src["doc_id"].cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a plain literal would be folded out of the joins' keys, and the texts shuffled anew for each join
    none = F.least(F.octet_length("text"), F.lit(0)).cast("bigint")
    alone = src.select("doc_id", none.alias("n"), F.lit(1).cast("bigint").alias("copies"), "text")
    shared = ws.stage(src.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "shared-ids")
    if shared.isEmpty():
        return alone, False
    texts = src.join(shared, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = ws.stage(texts, "shared-texts")
    order = texts.select("doc_id", "sha").repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "sha").sortWithinPartitions("doc_id", "sha")
    order = ws.stage(order.withColumn("at", F.monotonically_increasing_id()), "shared-order")
    sizes = sorted(map(tuple, order.groupBy(F.shiftright("at", 33).alias("part")).count().collect()))  # a row a partition
    before = np.cumsum([0] + [c for _, c in sizes])[:-1].tolist()
    base = docs.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part bigint, before bigint")
    named = order.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(base), "part").select("doc_id", "sha", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("n"))
    several = texts.join(named, ["doc_id", "sha"]).select("doc_id", "n", "copies", "text")
    return alone.join(shared, "doc_id", "left_anti").unionByName(several), True


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs, hot runs and marks, and spans that are surely removed, each task's repeats taken out."""
    secret = secrets.token_bytes(16)

    def digests(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        view, make = memoryview(data.tobytes()), hashlib.blake2b
        return np.frombuffer(b"".join([make(view[a : a + n], digest_size=8, key=secret).digest() for a, n in zip(at.tolist(), size.tolist())]), np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            texts, doc, start, at, count, key, seg = zip(*held)
            data = np.concatenate(texts)
            doc, start, at, count, key, seg = map(np.concatenate, (doc, start, at, count, key, seg))
            first, later = reduced(data, at, count + length - 1, key, seg, doc, start)
            d, a, b = merged(doc[later], start[later], start[later] + count[later] + length - 1)
            yield found_batch(SPAN, scattered(d, a), d, a, b - a)
            keys, which, many = np.unique(key[first], return_inverse=True, return_counts=True)
            hot = many[which] >= CROWD
            normal, crowd, marks = first[~hot], first[hot], keys[many >= CROWD]
            yield found_batch(RUN, key[normal], doc[normal], start[normal], count[normal], digests(data, at[normal], count[normal] + length - 1))
            yield found_batch(HOT, scattered(doc[crowd], start[crowd]), doc[crowd], start[crowd], count[crowd])
            yield found_batch(MARK, marks, np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64))

        for batch in it:
            data, offs = byte_view(strings(batch, "text"))
            ids, number = own_ids(batch), batch.column("n").to_numpy(zero_copy_only=False)
            for i, j in blocks(offs):
                own = offs[i : j + 1] - offs[i]
                doc, at, count, key, seg = runs(data[offs[i] : offs[j]], own, length, gram)
                if len(doc):
                    held.append((data[offs[i] : offs[j]].copy(), ids[i:j][doc], at - own[doc] + (number[i:j][doc] << PLACE), at + size, count, key, seg))
                    n += len(doc)
                    size += int(offs[j] - offs[i])
                if n >= ROWS_AT_ONCE:
                    yield from flush()
                    held, n, size = [], 0, 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, FOUND)


def judge_groups(found: DataFrame, length: int, wide: int) -> DataFrame:
    """Spans to remove, runs that are first of their class in groups of several classes, and hot runs. At most ``wide`` runs of a
    group are held."""
    n = shuffle_partitions(found.sparkSession)
    dealt = found.repartition(n, "pkey").sortWithinPartitions("pkey", F.desc("kind"), "digest", "size", "doc_id", "start")  # a group's marks come first

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot_key = None, None

        def settle(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            """Emit what can be told of whole groups; hold the last one, that may go on, unless it is hot or ``last``."""
            nonlocal held, hot_key
            kind, key = cols[:2]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            hot = (np.add.reduceat(kind == MARK, start, dtype=np.int64) > 0) | (size >= wide)
            if hot_key is not None and key[0] == hot_key:
                hot[0] = True
            if last:
                held = None
            else:
                hot_key = key[-1] if hot[-1] else None
                held = None if hot[-1] else [c[start[-1] :] for c in cols]
                if held is not None:
                    cols, start, size, hot = [c[: start[-1]] for c in cols], start[:-1], size[:-1], hot[:-1]
            if not len(start):
                return
            group = np.repeat(np.arange(len(start)), size)
            rows = np.flatnonzero(cols[0] == RUN)
            group = group[rows]
            _, key, doc, at, many, digest = (c[rows] for c in cols)
            first = np.concatenate([[True], (group[1:] != group[:-1]) | (digest[1:] != digest[:-1]) | (many[1:] != many[:-1])]) if len(rows) else np.zeros(0, bool)
            head = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
            later = (doc != doc[head]) | (at != at[head])
            d, a, b = merged(doc[later], at[later], at[later] + many[later].astype(np.int64) + length - 1)
            yield found_batch(SPAN, np.zeros(len(d), np.int64), d, a, b - a)
            classes = np.bincount(group, weights=first, minlength=len(hot))
            use = np.flatnonzero(first & (hot | (classes > 1))[group])
            yield found_batch(np.where(hot[group[use]], HOT, RUN), key[use], doc[use], at[use], many[use])

        for batch in it:
            cols = [batch.column(c).to_numpy() for c in ("kind", "pkey", "doc_id", "start", "size", "digest")]
            through = (cols[0] == SPAN) | (cols[0] == HOT)
            yield found_batch(*[c[through] for c in cols])
            cols = [c[~through] for c in cols]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if len(cols[0]):
                yield from settle(cols, False)
        if held is not None:
            yield from settle(held, True)

    return dealt.mapInArrow(run, FOUND)


SEGMENT = "pkey bigint, doc_id bigint, start bigint, size int, bytes binary"


def of_texts(texts: DataFrame, rows: DataFrame, *what: str) -> DataFrame:
    """The texts with the list of their own rows."""
    lists = rows.groupBy("doc_id", F.shiftright("start", PLACE).alias("n")).agg(F.collect_list(F.struct(*what)).alias("own"))  # of one document
    return texts.join(lists.hint("shuffle_hash"), ["doc_id", "n"], "left")


def own_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row in the batch of each listed row, and the listed rows' columns."""
    col = batch.column("own")
    has = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    lists = col.take(pa.array(has))
    flat = lists.flatten()
    return has[np.repeat(np.arange(len(has)), np.diff(lists.offsets.to_numpy()))], [flat.field(k).to_numpy() for k in range(flat.type.num_fields)]


def fetch(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs with their segments' bytes; hot ones as single windows, and (bytes null) spans that are surely removed."""

    def out(key, doc, start, size, text) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(np.asarray(size).astype(np.int32)), pa.array(text, pa.binary())], names=[x.split()[0] for x in SEGMENT.split(", ")])

    def send_windows(first: dict[bytes, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(first), 20_000):
            text = list(islice(first, a, a + 20_000))
            doc, start = zip(*islice(first.values(), a, a + 20_000))
            key = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in text]
            yield out(key, doc, start, np.ones(len(text)), text)

    def send_spans(again: list[tuple[int, int]]) -> pa.RecordBatch:
        doc, start = np.array(again, np.int64).reshape(-1, 2).T
        d, a, b = merged(doc, start, start + length)
        return out(scattered(d, a), d, a, b - a, [None] * len(d))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple[int, int]] = {}  # windows of hot groups
        again: list[tuple[int, int]] = []
        for batch in it:
            row, own = own_rows(batch)
            if not len(row):
                continue
            key, start, size, kind = own
            size = size.astype(np.int64)
            data, offs = byte_view(strings(batch, "text"))
            raw, doc = data.tobytes(), own_ids(batch)[row]
            at = offs[row] + (start & ((1 << PLACE) - 1))
            some = np.flatnonzero(kind == RUN)
            for a in range(0, len(some), 20_000):
                b = some[a : a + 20_000]
                text = [raw[x : x + m + length - 1] for x, m in zip(at[b].tolist(), size[b].tolist())]
                yield out(key[b], doc[b], start[b], size[b], text)
            hot = np.flatnonzero(kind == HOT)
            for a in range(0, len(hot), 1_000):
                b = hot[a : a + 1_000]
                run_of = np.repeat(b, size[b])
                for x, d, s in zip(ranges(at[b], size[b]).tolist(), doc[run_of].tolist(), ranges(start[b], size[b]).tolist()):
                    text = raw[x : x + length]
                    old = first.setdefault(text, (d, s))
                    if (d, s) < old:
                        first[text] = (d, s)
                        again.append(old)
                    elif old != (d, s):
                        again.append((d, s))
                if len(first) >= WINDOWS_AT_ONCE:
                    yield from send_windows(first)
                    first = {}
                if len(again) >= WINDOWS_AT_ONCE:
                    yield send_spans(again)
                    again = []
        yield from send_windows(first)
        if again:
            yield send_spans(again)

    return of_texts(texts, wanted, "pkey", "start", "size", "kind").mapInArrow(run, SEGMENT)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a shard in the order of their first ``depth`` symbols (at least), by prefix doubling."""
    n = len(symbols)
    rank, span = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        pair = rank * np.int64(int(rank.max()) + 2)
        pair[: n - span] += rank[span:] + 1
        order = np.argsort(pair)
        p = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], p[1:] != p[:-1]]))
        span *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class Shard:
    """One shard's transform over symbols of ``step`` bytes. Each segment is followed by ``step`` empty suffixes."""

    def __init__(self, names: np.ndarray, first: np.ndarray, size: np.ndarray, step: int, rounds: int):
        n = len(names)
        # place p goes on at p + step; laid out by residue so that this is the next place of a row
        place = np.arange(n)
        seg = np.repeat(np.arange(len(first)), size)
        within = place - first[seg]
        row = np.lexsort((within, within % step, seg))
        order = row[suffix_order(names[row], rounds)]
        self.suffix = order  # places in the order of their suffixes
        before = order - step
        has = within[order] >= step
        self.transform = np.where(has, names[np.where(has, before, 0)], 0)  # the symbol before each suffix, 0 for none


def repeats(segments: list[bytes], step: int, length: int, shard_symbols: int = SHARD_SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the places of all segments laid one after the other (``step`` more for each): the interval of the place's window, the
    segments' first places and their sizes."""
    pad = b"\0" * step
    data = np.frombuffer(pad.join(segments) + pad, np.uint8)
    size = np.fromiter(map(len, segments), np.int64, len(segments)) + step
    first = np.cumsum(size) - size
    n = len(data)
    # symbols: step bytes each (9 bits a byte, 0 past the end), named by their order
    ext = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(step, np.uint64)])
    ends = first + size
    for k in range(step):
        ext[ends - 1 - k] = 0
    word = np.zeros(n, np.uint64)
    for k in range(step):
        word = (word << np.uint64(9)) | ext[k : n + k]
    empty = ranges(ends - step, np.full(len(ends), step))
    word[empty] = 0
    alphabet, names = np.unique(word, return_inverse=True)  # empty suffixes get 0
    del data, ext, word
    shard_of = (np.cumsum(size) - 1) // shard_symbols
    cuts = np.flatnonzero(np.concatenate([[True], shard_of[1:] != shard_of[:-1]]))
    suffix, transform, label = [], [], []
    for s, (i, j) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)])):
        a, b = first[i], ends[j - 1]
        shard = Shard(names[a:b], first[i:j] - a, size[i:j], step, length // step)
        suffix.append(shard.suffix + a)
        transform.append(shard.transform)
        label.append(np.full(b - a, s, np.uint8 if len(cuts) < 256 else np.uint16))
    suffix, transform, inter = np.concatenate(suffix), np.concatenate(transform), np.concatenate(label)
    low = transform.astype(np.uint16)
    high = (transform >> 16).astype(np.uint16) if len(alphabet) > 1 << 16 else None
    interval = np.zeros(n, np.int32)  # of the slots of the interleave
    for _ in range(length // step):
        slots = np.argsort(inter, kind="stable")  # slots of each shard's entries in turn
        sym = np.empty(n, np.uint16)
        sym[slots] = low
        order = np.argsort(sym, kind="stable")
        new = sym[order]
        change = new[1:] != new[:-1]
        if high is not None:
            sym[slots] = high
            by_high = np.argsort(sym[order], kind="stable")
            order = order[by_high]
            h, new = sym[order], new[by_high]
            change = (h[1:] != h[:-1]) | (new[1:] != new[:-1])
        old = interval[order]
        n_empty = len(empty)  # the first bucket: suffixes that end here are alike
        split = change | (old[1:] != old[:-1])
        split[: n_empty - 1] = False
        inter = inter[order]
        interval[0] = 0
        np.cumsum(split, out=interval[1:], dtype=np.int32)
    out = np.empty(n, np.int64)
    out[suffix] = interval[np.argsort(inter, kind="stable")]
    return out, first, size


def removed_windows(segments: list[bytes], windows: np.ndarray, step: int, length: int, shard_symbols: int = SHARD_SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """Segment and place in it of all windows that equal an earlier one; the segments are in the order of their occurrences."""
    interval, first, _ = repeats(segments, step, length, shard_symbols)
    at = ranges(first, windows)
    own = interval[at]
    earliest = np.full(int(own.max()) + 1, -1, np.int64)
    earliest[own[::-1]] = at[::-1]
    hit = at[earliest[own] != at]
    seg = np.searchsorted(first, hit, side="right") - 1
    return seg, hit - first[seg]


def merge_groups(segments: DataFrame, length: int, step: int) -> DataFrame:
    """Spans to remove from the segments, group by group."""
    n = shuffle_partitions(segments.sparkSession)
    dealt = segments.repartition(n, "pkey").sortWithinPartitions("pkey")

    def spans(doc, start, stop) -> pa.RecordBatch:
        d, a, b = merged(doc, start, stop)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array((b - a).astype(np.int32))], names=["doc_id", "start", "size"])

    def distinct(doc, start, size, text) -> tuple[np.ndarray, pa.RecordBatch]:
        """Segments in the order of their occurrences, each text once, and the spans of the others."""
        order = np.lexsort((start, doc))
        first: dict[bytes, int] = {}
        head = np.fromiter((first.setdefault(text[i], i) for i in order.tolist()), np.int64, len(order))
        later = order[(doc[order] != doc[head]) | (start[order] != start[head])]
        return order[head == order], spans(doc[later], start[later], start[later] + size[later] + length - 1)

    def settle(doc, start, size, text) -> Iterator[pa.RecordBatch]:
        order, gone = distinct(doc, start, size, text)
        yield gone
        seg, within = removed_windows([text[i] for i in order], size[order], step, length)
        yield spans(doc[order][seg], start[order][seg] + within, start[order][seg] + within + length)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]  # key, doc, start, size, bytes
        symbols = 0
        for batch in it:
            whole = batch.column("bytes").is_valid()
            gone = batch.filter(pc.invert(whole))
            if gone.num_rows:
                yield gone.select(["doc_id", "start", "size"])
            batch = batch.filter(whole)
            key = batch.column("pkey").to_numpy()
            texts = batch.column("bytes").to_pylist()
            rest = [batch.column(c).to_numpy() for c in ("doc_id", "start", "size")]
            i = 0
            while i < len(key):
                # up to the end of the group in which the block gets full
                sizes = np.cumsum(rest[2][i:] + length)
                j = i + int(np.searchsorted(sizes, BLOCK_SYMBOLS - symbols)) + 1
                if j < len(key):
                    j = int(np.searchsorted(key, key[j - 1], side="right"))
                j = min(j, len(key))
                full = j < len(key)  # at the batch's end the group may go on
                for h, x in zip(held, (key, *rest, texts)):
                    h.append(x[i:j])
                symbols += int((rest[2][i:j] + length).sum())
                i = j
                if full:
                    yield from settle(*[np.concatenate(h).astype(np.int64) for h in held[1:4]], [t for x in held[4] for t in x])
                    held, symbols = [[], [], [], [], []], 0
            if symbols >= BLOCK_SYMBOLS:  # full, but its last group may go on: settle all before that group, reduce that group
                k = np.concatenate(held[0])
                cut = int(np.searchsorted(k, k[-1]))
                d, s, m = (np.concatenate(h).astype(np.int64) for h in held[1:4])
                t = [x for y in held[4] for x in y]
                if cut:
                    yield from settle(d[:cut], s[:cut], m[:cut], t[:cut])
                k, d, s, m, t = k[cut:], d[cut:], s[cut:], m[cut:], t[cut:]
                keep, gone = distinct(d, s, m, t)
                yield gone
                held, symbols = [[k[keep]], [d[keep]], [s[keep]], [m[keep]], [[t[x] for x in keep]]], int((m[keep] + length).sum())
        if symbols:
            yield from settle(*[np.concatenate(h).astype(np.int64) for h in held[1:4]], [t for x in held[4] for t in x])

    return dealt.mapInArrow(run, "doc_id bigint, start bigint, size int")


def cut_out(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """The digests of what is left of each document, and with ``with_text`` the remaining bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = byte_view(strings(batch, "text"))
            raw = memoryview(data.tobytes())
            n = batch.num_rows
            row, (start, length) = own_rows(batch)
            start = start & ((1 << PLACE) - 1)
            size = np.diff(offs)
            d, a, b = merged(row, start, start + length)
            n_spans = np.bincount(d, minlength=n)
            n_removed = np.bincount(d, weights=b - a, minlength=n).astype(np.int64)
            left, k = [], 0
            for r in range(n):
                at, parts = int(offs[r]), []
                for _ in range(n_spans[r]):
                    parts.append(raw[at : offs[r] + a[k]])
                    at = int(offs[r] + b[k])
                    k += 1
                left.append(b"".join([*parts, raw[at : offs[r + 1]]]))
            ids = own_ids(batch)
            cols = [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(size), pa.array(n_removed), pa.array(n_spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()), batch.column("copies")]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "copies"]
            if with_text:
                cols.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, copies bigint" + (", kept binary" if with_text else "")
    return of_texts(texts, spans, "start", "size").mapInArrow(run, schema)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, wide: int = WIDE, with_text: bool = False) -> DataFrame:
    """What is left of each document when repeated strings of ``length`` bytes (a multiple of ``step``) are removed."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix-dedup")
    src, shared = numbered(docs, ws)
    judged = ws.stage(judge_groups(find_runs(src, length, gram), length, wide), "judged")
    release_shuffles(spark)
    texts = src.repartition(shuffle_partitions(spark), "doc_id", "n")
    found = merge_groups(fetch(texts, judged.where(F.col("kind") != SPAN), length), length, step)
    spans = judged.where(F.col("kind") == SPAN).select("doc_id", "start", "size").unionByName(found)
    out = cut_out(texts, spans, with_text)
    if shared:  # a row for each of equal rows
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copy")
    return out.drop("copies")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


#: Documents are cut into pieces first, as finding a place in a long string takes long. Unique doc_ids are presumed.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, c, substr(h, 2 * c + 1, 598) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 200)) AS c FROM d WHERE length(h) >= 200)),
w AS (SELECT doc_id, c + i AS i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, c, h, unnest(range(0, least(200, length(h) // 2 - 99))) AS i FROM part)),
firsts AS (SELECT s, min(struct_pack(d := doc_id, i := i)) AS f FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.i FROM w JOIN firsts ON w.s = firsts.s WHERE struct_pack(d := w.doc_id, i := w.i) > f),
island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM island GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM span),
left_ AS (SELECT d.doc_id, sum(b - a) AS gone, count(*) AS n, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gap JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN left_ USING (doc_id)
"""
