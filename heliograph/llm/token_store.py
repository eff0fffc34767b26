"""Token-id files of directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the low ``BITS`` bits of every id, level 1 the next bits of
those ids that have more, and so on. Each level carries a bitmap of the ids that continue and a rank directory, the number
of set bits before each stretch of ``STRETCH``. Any id is found from its position alone: one chunk, one bit and one rank a
level, without decoding a block.

The store is a Parquet table with a segment a row (``part``, ``segment``, ``base``: ids before it in its part, the
documents' ids and lengths, and the levels). Spark's committed writes make it safe against lost executors; parts follow
each other in ascending doc_id order.

Cases: null text is empty text, which still gets the end id; texts of any length are whole, in one segment; documents that
share a doc_id follow each other in the order of their texts; null doc_ids come first; an empty table gives an empty
store; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.bpe import byte_alphabet
from heliograph.llm.common import BLOCK_BYTES, Workspace, blocks, byte_view, documents, only, ranges, shuffle_partitions, strings

BITS = 8
STRETCH = 512
#: Ids in a segment, more only for one longer document.
SEGMENT_IDS = 1 << 16
END_ID = 2
CACHE_WORDS = 300_000
STORE = "part int, segment int, base bigint, n_ids bigint, doc_ids binary, doc_null binary, doc_lens binary, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"


class Codes:
    """One segment's levels."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self.bitmaps = [np.frombuffer(b, np.uint8) for b in bitmaps]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @staticmethod
    def levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
        left, out = np.asarray(ids, np.uint32), ([], [], [])
        while True:
            more = left >= (1 << BITS)
            bits = np.packbits(more, bitorder="little")
            counts = np.add.reduceat(more, np.arange(0, len(more), STRETCH), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
            out[0].append((left & ((1 << BITS) - 1)).astype(np.uint8).tobytes())
            out[1].append(bits.tobytes())
            out[2].append((np.cumsum(counts) - counts).astype(np.uint32).tobytes())
            if not more.any():
                return out
            left = left[more] >> BITS

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for k, chunk in enumerate(self.chunks):
            value |= int(chunk[i]) << (BITS * k)
            if not self.bitmaps[k][i >> 3] >> (i & 7) & 1:
                break
            first = i // STRETCH * STRETCH >> 3
            part = int(np.bitwise_count(self.bitmaps[k][first : i >> 3]).sum()) + int(self.bitmaps[k][i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(self.ranks[k][i // STRETCH]) + part
        return value

    def all(self) -> np.ndarray:
        """Every id in order."""
        value = self.chunks[-1].astype(np.uint32)
        for chunk, bitmap in zip(self.chunks[-2::-1], self.bitmaps[-2::-1]):
            more = np.unpackbits(bitmap, count=len(chunk), bitorder="little").view(bool)
            out = chunk.astype(np.uint32)
            out[more] |= value << BITS
            value = out
        return value


class WordIds:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and joins nothing across the pieces of its split
    pattern: the ids of a text are those of its pieces in turn. The library's model encodes each distinct piece once; a
    worker remembers the latest of them. Texts with characters other than ``EASY`` go word by word through the whole library."""

    #: Letters that are letters to the tokenizer too, have no decompositions in the text and lower-case one to one.
    EASY = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
    #: Its pieces; what is common is tried first. No two alternatives but the last two begin alike.
    PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\t-\r a-z0-9ß-öø-ÿ]+")

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        alphabet = byte_alphabet()
        self.spread = str.maketrans({c: "".join(alphabet[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x100))})
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.sizes: dict[str, int] = {}  # of pieces that were counted
        self.starts, self.lens, self.pool = (np.zeros(1 << 10, np.int64) for _ in range(3))
        self.n = 0

    def pieces(self, text: str) -> list[str]:
        """Pieces of an easy text; of others the words, marked by a character that no piece has."""
        if self.EASY.fullmatch(text) and not any(x in text for x in self.special):
            return self.PIECES.findall(text.lower())
        return ["\0" + w.decode() for w in text.encode().split()]  # at ASCII white space, all of which is dropped

    def learn(self, pieces: list[str]) -> None:
        tokenize, spread = self.lib.model.tokenize, self.spread
        hard = [p[1:] for p in pieces if p[0] == "\0"]
        easy = [p for p in pieces if p[0] != "\0"]
        number = attrgetter("id")
        ids = [tuple(map(number, tokenize(p if p.isascii() else p.translate(spread)))) for p in easy]
        ids += [e.ids for e in self.lib.encode_batch_fast(hard, add_special_tokens=False)]
        known, lens = len(self.at), np.fromiter(map(len, ids), np.int64, len(ids))
        self.at.update(zip([*easy, *("\0" + w for w in hard)], range(known, known + len(ids))))
        total = int(lens.sum())
        for name, n in (("starts", known + len(ids)), ("lens", known + len(ids)), ("pool", self.n + total)):
            if n > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * n))
        self.lens[known : known + len(ids)] = lens
        self.starts[known : known + len(ids)] = self.n + np.cumsum(lens) - lens
        self.pool[self.n : self.n + total] = np.fromiter(chain.from_iterable(ids), np.int64, total)
        self.n += total

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The known pieces of all texts in turn, their lengths in ids, and the texts' lengths in ids."""
        if len(self.at) > CACHE_WORDS:
            self.reset()
        split = [self.pieces(t.decode()) for t in texts]
        if new := set().union(*split).difference(self.at):
            self.learn(list(new))
        n_pieces = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(n_pieces.sum()))
        lens = self.lens[which]
        upto = np.concatenate([[0], np.cumsum(lens)])
        return which, lens, np.diff(np.concatenate([[0], upto[np.cumsum(n_pieces)]]))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each with the end id, and the texts' lengths in ids."""
        collects = gc.isenabled()
        gc.disable()  # strings and numbers by the million and no cycles among them
        try:
            which, lens, per_text = self.cut(texts)
        finally:
            if collects:
                gc.enable()
        per_text = per_text + 1
        out = np.full(int(per_text.sum()), end, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(per_text) - 1] = False
        out[body] = self.pool[ranges(self.starts[which], lens)]
        return out, per_text

    def count_many(self, texts: list[str]) -> list[int]:
        """The number of ids of each text, without the end id."""
        from heliograph.llm.bpe import sums_of

        if len(self.at) > CACHE_WORDS:
            self.reset()
        return sums_of([self.pieces(t) for t in texts], self.sizes, self._learn_sizes)

    def _learn_sizes(self, pieces: set[str]) -> None:
        if new := pieces.difference(self.at):
            self.learn(list(new))
        self.sizes.update((p, int(self.lens[self.at[p]])) for p in pieces)


_made: dict[str, WordIds] = {}


def write(docs: DataFrame, tokenizer_path: str, ws: Workspace, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The store of the table's documents, written and read again."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the corpus

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(spec.value.encode()).hexdigest()
        coder = _made.get(key) or _made.setdefault(key, WordIds(spec.value))
        part, held, n, number, base = TaskContext.get().partitionId(), [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held])
            chunks, bitmaps, ranks = Codes.levels(ids)
            row = {
                "part": part, "segment": number, "base": base, "n_ids": len(ids),
                "doc_ids": np.concatenate([x[2] for x in held]).astype("<i8").tobytes(), "doc_null": np.concatenate([x[3] for x in held]).astype(np.uint8).tobytes(),
                "doc_lens": np.concatenate([x[1] for x in held]).astype("<i8").tobytes(), "chunks": chunks, "bitmaps": bitmaps, "ranks": ranks,
            }
            kinds = {"part": pa.int32(), "segment": pa.int32(), "base": pa.int64(), "n_ids": pa.int64()} | dict.fromkeys(("doc_ids", "doc_null", "doc_lens"), pa.binary()) | dict.fromkeys(("chunks", "bitmaps", "ranks"), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], names=list(kinds))

        for batch in it:
            data, offs = byte_view(strings(batch, "text"))
            raw = data.tobytes()
            ids_col = batch.column("doc_id")
            null = np.asarray(ids_col.is_null().to_numpy(zero_copy_only=False), bool)
            doc = ids_col.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in blocks(offs, min(BLOCK_BYTES, segment_ids * 4)):
                ids, lens = coder.encode([raw[offs[x] : offs[x + 1]] for x in range(i, j)], end_id)
                held.append((ids, lens, doc[i:j], null[i:j]))
                n += len(ids)
                if n >= segment_ids:
                    yield segment()
                    held, base, number, n = [], base + n, number + 1, 0
        if held:
            yield segment()

    src = only(docs, "doc_id", "text")
    ordered = src.select(src["doc_id"].cast("bigint").alias("doc_id"), "text").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return ws.stage(ordered.mapInArrow(run, STORE), "store")


def ids_before(store: DataFrame) -> list[tuple[int, int]]:
    """Each part with the number of ids in the parts before it."""
    sums = sorted((r[0], r[1]) for r in store.groupBy("part").agg(F.sum("n_ids")).collect())  # a row a part, not a document
    before, at = [], 0
    for part, n in sums:
        before.append((part, at))
        at += n
    return before


def read(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the store alone."""
    offsets = store.sparkSession.createDataFrame(ids_before(store), "part int, before bigint")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in range(batch.num_rows):
                row = {k: batch.column(k)[r].as_py() for k in batch.schema.names}
                ids = Codes(row["chunks"], row["bitmaps"], row["ranks"]).all().astype("<u4")
                lens = np.frombuffer(row["doc_lens"], "<i8")
                ends = np.cumsum(lens)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - lens).tolist(), ends.tolist())]
                null = np.frombuffer(row["doc_null"], np.uint8).astype(bool)
                cols = [pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=null), pa.array(row["before"] + row["base"] + ends - lens), pa.array(lens), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.join(F.broadcast(offsets), "part").drop("segment", "part", "n_ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_at(store: DataFrame, position: int, before: list[tuple[int, int]] | None = None) -> int | None:
    """The id at a position among all ids (None beyond them): one segment's row is fetched, and in it one chunk, bit and rank a
    level are read. ``before`` is :func:`ids_before`, for many accesses."""
    before = ids_before(store) if before is None else before
    k = bisect.bisect_right([b for _, b in before], position) - 1
    if position < 0 or k < 0:
        return None
    part, at = before[k][0], position - before[k][1]
    rows = store.where((F.col("part") == part) & (F.col("base") <= at) & (F.col("base") + F.col("n_ids") > at)).select("base", "chunks", "bitmaps", "ranks").collect()
    return Codes(rows[0].chunks, rows[0].bitmaps, rows[0].ranks).access(at - rows[0].base) if rows else None


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), Workspace(spark, "token-store")))
