r"""Substring dedup of word windows by compressed FM-indexes of shards.

A window of ``window`` words has an anchor, the shingle of ``SHINGLE`` words in it with the smallest hash (the leftmost of equal ones), so
equal windows share their anchor. Neighbouring windows with one anchor form a piece of the document. Only pieces whose anchor is in
two documents can matter; each distinct one of them goes, once, to the shard of its anchor. Anchors with more than ``CROWD``
distinct pieces are split: of their windows, those in two documents go to the shard of their own digest instead.

A shard is indexed block by block (whole anchors, about ``BLOCK_WORDS`` words): words become numbers, the pieces' words are sorted to the
depth of a window by doubling, and the transform is kept as a wavelet matrix of packed bits with rank directories. The pieces
are then streamed from their right ends by backward search, all in step: a match that is as long as a window reports the
smallest document among its occurrences and is shortened by a word for the next step. Words, not hashes, decide.

What the search reports for a piece holds for all its copies: a window of a document goes if its smallest document is a smaller one.

Cases: null and wordless texts have no words; texts of any length are whole; documents of fewer words than a window keep all; rows that
share a doc_id are documents of their own, and none is smaller than the other (with equal texts too: both stay); a null doc_id counts
as larger than all others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import Workspace, documents, only, release_shuffles, shuffle_partitions, strings

WINDOW, SHINGLE = 50, 8
#: Distinct pieces of an anchor up to which they are indexed together.
CROWD = 512
#: Words that are indexed at once, more only for one anchor.
BLOCK_WORDS = 1 << 19
#: Words of a long document whose anchors are sought at once.
STRETCH_WORDS = 1 << 20
NO_ID = (1 << 63) - 1
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PIECES = "text_key bigint, ord bigint, at int, n int, anchor bigint, digest binary"


# ---- pieces ----


def byte_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (MULTIPLIER, inverse))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def word_starts(joined: bytes) -> np.ndarray:
    """Where the words of a text with single spaces start; one entry more, as if another word followed."""
    return np.concatenate([[0], np.nonzero(np.frombuffer(joined, np.uint8) == 32)[0] + 1, [len(joined) + 1]])


def pieces_of(joined: bytes, starts: np.ndarray, window: int, powers) -> Iterator[tuple[int, int, int]]:
    """(first word, windows, anchor) of each run of windows with one anchor."""
    n = len(starts) - 1
    for a in range(0, n - window + 1, STRETCH_WORDS):
        b = min(n, a + STRETCH_WORDS + window - 1)
        s = starts[a : b + 1] - starts[a]
        raw = np.frombuffer(joined, np.uint8, s[-1] - 1, starts[a])
        up, down = powers(len(raw) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        first, last = s[: b - a - SHINGLE + 1], s[SHINGLE : b - a + 1] - 1
        shingle = mixed((sums[last] - sums[first]) * down[first])
        # the hash above, the place below: the least is the leftmost of equal hashes
        place = np.uint64((1 << 24) - 1)
        least = sliding_least((shingle & ~place) | np.arange(len(shingle), dtype=np.uint64), window - SHINGLE + 1)
        runs = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
        ends = np.append(runs[1:], len(least))
        yield from zip((a + runs).tolist(), (ends - runs).tolist(), shingle[(least[runs] & place).astype(np.int64)].view(np.int64).tolist())


def pieces(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All pieces of ``docs`` (text_key, ord, text) with their anchors and the digests of their words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [byte_powers(1 << 16)]

        def powers(n: int):
            if len(known[0][0]) < n:
                known[0] = byte_powers(2 * n)
            return known[0]

        out: list[tuple] = []
        for batch in it:
            keys, ords = batch.column("text_key").to_pylist(), batch.column("ord").to_pylist()
            for row, text in enumerate(strings(batch, "text")):
                words = text.as_py().encode().split()
                if len(words) < window:
                    continue
                joined = b" ".join(words)
                starts = word_starts(joined)
                for a, n, anchor in pieces_of(joined, starts, window, powers):
                    digest = hashlib.blake2b(joined[starts[a] : starts[a + n + window - 1] - 1], digest_size=16).digest()
                    out.append((keys[row], ords[row], a, n, anchor, digest))
                if len(out) > 50_000:
                    yield batch_of(out, PIECES)
                    out = []
        if out:
            yield batch_of(out, PIECES)

    return docs.mapInArrow(run, PIECES)


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def cut(docs: DataFrame, wanted: DataFrame, window: int, each_window: bool = False) -> DataFrame:
    """The words of wanted pieces (text_key, ord, at, n, digest, shard, last). With ``each_window`` their windows' digests instead."""
    schema = "own binary, digest binary, place int, first bigint, last bigint, text_key bigint, at int" if each_window else "shard bigint, digest binary, n int, first bigint, words binary"
    asked = wanted.groupBy("text_key", "ord").agg(F.collect_list(F.struct("at", "n", "digest", "shard", "last")).alias("asked"))  # of one document, by its words

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in it:
            keys, ords = batch.column("text_key").to_pylist(), batch.column("ord").to_pylist()
            for row, text in enumerate(strings(batch, "text")):
                joined = b" ".join(text.as_py().encode().split())
                starts = word_starts(joined).tolist()
                for p in batch.column("asked")[row].as_py():
                    a, n = p["at"], p["n"]
                    if each_window:
                        out += [(hashlib.blake2b(joined[starts[i] : starts[i + window] - 1], digest_size=16).digest(), p["digest"], i - a, ords[row], p["last"], keys[row], i) for i in range(a, a + n)]
                    else:
                        out.append((p["shard"], p["digest"], n, ords[row], joined[starts[a] : starts[a + n + window - 1] - 1]))
                if len(out) > 20_000:
                    yield batch_of(out, schema)
                    out = []
        if out:
            yield batch_of(out, schema)

    return docs.join(asked, ["text_key", "ord"]).select("text_key", "ord", "text", "asked").mapInArrow(run, schema)


# ---- the index ----


class Wavelet:
    """Ranks of symbols in a sequence, from one packed bitmap and rank directory for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.n_bits = max(1, int(n_symbols - 1).bit_length())
        self.levels, at = [], np.arange(n_symbols)
        starts = np.zeros(n_symbols, np.int64)
        for b in range(self.n_bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            padded = np.zeros(-(-(len(seq) + 1) // 64) * 64, bool)
            padded[: len(seq)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int64)
            zeros = len(seq) - int(bit.sum())
            self.levels.append((b, words, before, zeros))
            starts = self._down(self.levels[-1], at, starts)
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.starts = starts

    @staticmethod
    def _down(level, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        b, words, before, zeros = level
        w = i >> 6
        ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
        return np.where(symbol >> b & 1, zeros + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``i`` of the sequence."""
        for level in self.levels:
            i = self._down(level, symbol, i)
        return i - self.starts[symbol]


class FMIndex:
    """Backward search in a text of pieces, for patterns of up to ``depth`` words. ``text`` has a 0 behind each piece."""

    def __init__(self, text: np.ndarray, n_symbols: int, owner: np.ndarray, depth: int):
        n = len(text)
        ranks, size = [text.astype(np.int64)], 1
        while 2 * size <= depth:
            ranks.append(self._paired(ranks[-1], ranks[-1], size))
            size *= 2
        deep = self._paired(ranks[-1], ranks[-1], depth - size)
        order = np.argsort(deep, kind="stable")
        self.wavelet = Wavelet(text[order - 1], n_symbols)
        counts = np.bincount(text, minlength=n_symbols)
        self.before = np.cumsum(counts) - counts
        #: suffixes that agree in ``depth`` words, and those that agree in one less
        deep = deep[order]
        edges = np.nonzero(np.concatenate([[True], deep[1:] != deep[:-1]]))[0]
        self.block = np.cumsum(np.concatenate([[0], deep[1:] != deep[:-1]]))
        self.least = np.minimum.reduceat(owner[order], edges)
        shorter = self._paired(ranks[-1], ranks[-1], depth - 1 - size)[order] if depth - 1 > size else (ranks[-1] if depth - 1 == size else self._to(text, depth - 1))[order]
        edges = np.nonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))[0]
        of = np.cumsum(np.concatenate([[0], shorter[1:] != shorter[:-1]]))
        self.low, self.high = edges[of], np.append(edges[1:], n)[of]
        self.n, self.depth = n, depth

    @staticmethod
    def _paired(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        """Ranks of ``left`` followed by ``right`` so many places on (0 beyond the end)."""
        if not shift:
            return left
        after = np.concatenate([right[shift:] + 1, np.zeros(min(shift, len(right)), np.int64)])
        return np.unique(left * (int(right.max(initial=0)) + 2) + after, return_inverse=True)[1]

    @classmethod
    def _to(cls, text: np.ndarray, depth: int) -> np.ndarray:
        """Ranks to any depth of 1 or more."""
        have, size = text.astype(np.int64), 1
        while size < depth:
            step = min(size, depth - size)
            have, size = cls._paired(have, have, step), size + step
        return have

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with the symbol, then with what those in ``low .. high`` start with."""
        return self.before[symbol] + self.wavelet.rank(symbol, low), self.before[symbol] + self.wavelet.rank(symbol, high)

    def search(self, text: np.ndarray, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with ``text[at : at + lens]``, for all places at once."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        for t in range(int(lens.max(initial=0))):
            on = np.flatnonzero((lens > t) & (low < high))
            low[on], high[on] = self.step(text[at[on] + lens[on] - 1 - t], low[on], high[on])
        return low, high

    def longest(self, text: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest match of up to ``most`` words from each place on, and its suffixes; by halving, as prefixes of matches match."""
        short, long = np.zeros(len(at), np.int64), most.copy()
        while (short < long).any():
            half = (short + long + 1) // 2
            low, high = self.search(text, at, half)
            short, long = np.where(low < high, half, short), np.where(low < high, long, half - 1)
        return (short, *self.search(text, at, short))

    def streamed(self, text: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the sequences ``text[starts : starts + lens]``, up to ``depth``: for each place the length of the longest
        match from there on, and where it is ``depth`` the smallest owner. All sequences go left in step."""
        statistics, least = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        by = np.argsort(-lens, kind="stable")
        ends, lens = (starts + lens)[by], lens[by]
        low, high, length = np.zeros(len(by), np.int64), np.full(len(by), self.n), np.zeros(len(by), np.int64)
        for t in range(int(lens.max(initial=0))):
            k = int(np.searchsorted(-lens, -t, side="left"))  # those with more than t words
            at = ends[:k] - 1 - t
            low, high = self.step(text[at], low[:k], high[:k])
            length = length[:k] + 1
            lost = np.flatnonzero(low >= high)
            if len(lost):
                length[lost], low[lost], high[lost] = self.longest(text, at[lost], length[lost] - 1)
            statistics[at] = length
            whole = np.flatnonzero(length == self.depth)
            if len(whole):
                least[at[whole]] = self.least[self.block[low[whole]]]
                # the same match without its last word, for the next step
                low[whole], high[whole] = self.low[low[whole]], self.high[low[whole]]
                length[whole] -= 1
        return statistics, least


def indexed(words: list[bytes], n_windows: np.ndarray, first: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """For each piece its runs (first and last window, smallest document), from an index of all of them."""
    split = b" ".join(words).split(b" ")
    number = {w: i for i, w in enumerate(dict.fromkeys(split), 1)}
    lens = n_windows + window - 1
    ends = np.cumsum(lens + 1)
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.fromiter(map(number.__getitem__, split), np.int64, len(split))
    starts = ends - lens - 1
    index = FMIndex(text, len(number) + 1, np.repeat(first, lens + 1), window)
    statistics, least = index.streamed(text, starts, lens)
    out = []
    for a, n in zip(starts.tolist(), n_windows.tolist()):
        whole, doc = statistics[a : a + n] == window, least[a : a + n]
        edges = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])) + 1, [n]]).tolist()
        out.append([(i, j - 1, int(doc[i])) for i, j in zip(edges[:-1], edges[1:]) if whole[i]])
    return out


FOUND = "digest binary, low int, high int, first bigint"


def matched(shards: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Runs of windows (digest of the piece, first and last window, smallest document) from each shard's index."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def settle(rows: list) -> pa.RecordBatch:
            found = indexed([r[4] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), window)
            return batch_of([(rows[i][1], lo, hi, doc) for i, runs in enumerate(found) for lo, hi, doc in runs], FOUND)

        for batch in it:
            for row in zip(*[batch.column(c).to_pylist() for c in ("shard", "digest", "n", "first", "words")]):
                if size >= block_words and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += row[2] + window
        if held:
            yield settle(held)

    dealt = shards.repartition(shuffle_partitions(shards.sparkSession), "shard").sortWithinPartitions("shard", "digest")
    return dealt.select("shard", "digest", "n", "first", "words").mapInArrow(run, FOUND)


# ---- the operator ----


def repeated_windows(docs: DataFrame, ws: Workspace, window: int = WINDOW, crowd: int = CROWD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(text_key, ord, start, stop): stretches of words covered by windows that also start in a smaller document. ``docs`` has text_key,
    ord and text."""
    if window <= SHINGLE:
        raise ValueError(f"a window has more than {SHINGLE} words")
    spark = docs.sparkSession
    every = ws.stage(pieces(docs, window), "pieces")
    anchors = every.groupBy("anchor").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("anchor")
    anchors = ws.stage(anchors, "anchors")  # written, as the adaptive join splits an anchor that many pieces have
    candidates = ws.stage(every.join(anchors, "anchor", "left_semi"), "candidates")
    ws.drop("pieces")
    distinct = candidates.groupBy("digest").agg(F.min(F.struct("ord", "text_key", "at")).alias("at"), F.max("ord").alias("last"), F.first("anchor").alias("anchor"), F.first("n").alias("n"))
    distinct = ws.stage(distinct.select("digest", "last", "anchor", "n", "at.ord", "at.text_key", "at.at"), "distinct")
    counted = ws.stage(distinct.groupBy("anchor").agg(F.count("*").alias("k")), "counted")
    shared = ws.stage(distinct.join(counted, "anchor"), "shared")
    ws.drop("distinct")
    release_shuffles(spark)
    wanted = lambda rows: rows.select("text_key", "ord", "at", "n", "digest", F.col("anchor").alias("shard"), "last")
    asked, crowded = wanted(shared.where(F.col("k") <= crowd)), wanted(shared.where(F.col("k") > crowd))
    split = not crowded.isEmpty()
    if split:
        windows = ws.stage(cut(docs, crowded, window, each_window=True), "windows")
        twice = windows.groupBy("own").agg(F.min(F.struct("first", "text_key", "at")).alias("at"), F.max("last").alias("last")).where("at.first < last")
        asked = asked.unionByName(twice.select("at.text_key", F.col("at.first").alias("ord"), "at.at", F.lit(1).alias("n"), F.col("own").alias("digest"), F.xxhash64("own").alias("shard"), "last"))
    found = ws.stage(matched(cut(docs, asked, window), window, block_words), "found")
    ws.drop("shared")
    release_shuffles(spark)
    if split:  # a crowded piece has what was found for its windows' own digests
        of = found.where("low = 0 AND high = 0").select(F.col("digest").alias("own"), F.col("first").alias("found"))
        found = found.unionByName(windows.join(of, "own").select("digest", F.col("place").alias("low"), F.col("place").alias("high"), F.col("found").alias("first")))
        found = ws.stage(found, "found-all")
    hits = candidates.select("text_key", "ord", "at", "digest").join(found, "digest").where(F.col("first") < F.col("ord"))
    return hits.select("text_key", "ord", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high") + window).alias("stop"))


def keyed(docs: DataFrame) -> DataFrame:
    src = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return src.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("ord"), F.xxhash64("text").alias("text_key"))


KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def without_repeats(docs: DataFrame, ws: Workspace, window: int = WINDOW, crowd: int = CROWD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by single spaces."""
    docs = keyed(docs)
    spans = repeated_windows(docs, ws, window, crowd, block_words).groupBy("text_key", "ord").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    spans = ws.stage(spans, "spans")
    for name in ("candidates", "found"):
        ws.drop(name)
    release_shuffles(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, size = [], 0
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), batch.column("spans")):
                words = text.as_py().encode().split()
                n = len(words)
                if found.is_valid:
                    edge = np.zeros(n + 1, np.int64)
                    flat = found.values.flatten()
                    np.add.at(edge, flat[0].to_numpy(), 1)
                    np.add.at(edge, flat[1].to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                kept = b" ".join(words).decode()
                out.append((doc_id, n, n - len(words), kept))
                size += len(kept)
                if size > 1 << 24:
                    yield batch_of(out, KEPT)
                    out, size = [], 0
            if out:
                yield batch_of(out, KEPT)

    return docs.join(spans, ["text_key", "ord"], "left").select("doc_id", "text", "spans").mapInArrow(run, KEPT)


def op12_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir), Workspace(spark, "fm-dedup"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 50), ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s),
h AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 50)) AS p FROM g JOIN f USING (s) WHERE f.first_doc < g.doc_id)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) AS x ANTI JOIN h USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
