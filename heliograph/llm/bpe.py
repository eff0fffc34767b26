"""Byte-level BPE by speculation and verification.

A greedy longest match proposes the tokens of every distinct word. A proposal is the word's BPE encoding exactly if every
token is what BPE makes of its own bytes and every adjacent pair is compatible: no merge across the pair's border would
come before the merges that built the two tokens. Vectorised steps test all adjacent pairs of all new words at once,
walking both tokens' merge histories backwards; only words with a failing pair are merged exactly.

Cases: null text is empty text (no ids; digests of the empty string); texts of any length are encoded whole; equal rows
give equal rows; an empty table gives an empty table; other columns are ignored. Strings of special tokens in a text
become their ids, as the public library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from heliograph.llm.common import documents, only, strings

#: Fixed value: the published split pattern of byte-level BPE vocabularies.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters among which the pattern's classes are short lists, and the pattern over these.
EASY = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
EASY_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Distinct words that a Python worker remembers before it starts anew.
CACHE_WORDS = 300_000
#: Characters of text that are split into words at once.
CHARS_AT_ONCE = 1 << 20
NEVER = 1 << 40
#: Bytes up to which failing words are merged together in rows of a matrix.
SHORT = 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    table = {b: chr(b) for b in plain}
    return [table[b] if b in table else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder for one vocabulary file (its JSON text)."""

    def __init__(self, spec: str):
        tree = json.loads(spec)
        model = tree["model"]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in tree["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for s, i in vocab.items():
            self.token[i] = bytes(to_byte[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.digits = [str(i) for i in range(size)]
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.merged:
                self.merged[x, y] = (r, z)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([(x << 32) | y for x, y in self.merged], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merged.values()], np.int64)[order]
        self.pair_ids = np.array([z for _, z in self.merged.values()], np.int64)[order]
        self.byte_id = [vocab[c] for c in byte_alphabet()]
        self.known = {self.token[i]: i for i in vocab.values() if self._own(i)}
        self.matcher = ahocorasick.Automaton()
        for t, i in self.known.items():
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.words = regex.compile(WORD_PATTERN)
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.sizes: dict[str, int] = {}  # of words that were counted

    def _own(self, i: int) -> bool:
        """Is token ``i`` what BPE makes of its own bytes? Worked out for all tokens at once."""
        if not hasattr(self, "own"):
            built = np.flatnonzero(self.rank >= 0)
            fits = np.ones(len(self.rank), bool)
            fits[built] = self.compatible(self.left[built], self.right[built], self.rank[built])
            own = fits.copy()
            for t in built[np.argsort(self.rank[built])]:
                own[t] = fits[t] and own[self.left[t]] and own[self.right[t]]
            self.own = own
        return bool(self.own[i])

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each adjacent pair: does no merge across its border come first? ``until`` leaves out merges from that rank on."""
        a, b = a.copy(), b.copy()
        end_a = np.full(len(a), NEVER) if until is None else until.copy()
        end_b = np.full(len(a), NEVER) if until is None else until - 1
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        while len(at):
            m = self.lookup(a, b)[0]
            ra, rb = self.rank[a], self.rank[b]
            bad = (m < end_a) & (m <= end_b) & (m > ra) & (m > rb) & (m < NEVER)
            ok[at[bad]] = False
            go = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, end_a, end_b, ra, rb, at = a[go], b[go], end_a[go], end_b[go], ra[go], rb[go], at[go]
            undo_b = rb >= ra  # equal merges run from the left, so backwards the right one goes first
            end_b, b = np.where(undo_b, rb, end_b), np.where(undo_b, self.left[b], b)
            end_a, a = np.where(undo_b, end_a, ra), np.where(undo_b, a, self.right[a])
        return ok

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: tokens, and their words."""
        # one more character, which is in no token, stands between words
        found = list(self.matcher.iter_long("\u0100".join([w.decode("latin-1") for w in words])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        return pairs[:, 1], np.searchsorted(np.cumsum(lens + 1) - 1, pairs[:, 0], side="right")

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair (NEVER if there is none), and what it makes."""
        if not len(self.pair_keys):
            return np.full(a.shape, NEVER), np.zeros(a.shape, np.int64)
        key = (a << 32) | b
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[k] == key
        return np.where(hit, self.pair_ranks[k], NEVER), self.pair_ids[k]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words, a merge a word and round."""
        out: list = [None] * len(words)
        for longest in (8, 16, SHORT):
            which = [i for i, w in enumerate(words) if out[i] is None and len(w) <= longest]
            if not which:
                continue
            n = np.array([len(words[i]) for i in which])
            ids = np.asarray(self.byte_id)[np.frombuffer(b"".join(words[i].ljust(longest, b"\0") for i in which), np.uint8).reshape(-1, longest)]
            rank, made = self.lookup(ids[:, :-1], ids[:, 1:])
            rank[np.arange(longest - 1) >= (n - 1)[:, None]] = NEVER
            live = np.arange(len(which))
            while True:
                best = rank[live].argmin(1)
                go = rank[live, best] < NEVER
                live, best = live[go], best[go]
                if not len(live):
                    break
                ids[live, best] = made[live, best]
                place = np.arange(longest - 1)
                shift = np.minimum(place + (place > best[:, None]), longest - 2)
                keep = np.arange(longest)
                ids[live] = np.take_along_axis(ids[live], np.minimum(keep + (keep > best[:, None]), longest - 1), 1)
                rank[live], made[live] = np.take_along_axis(rank[live], shift, 1), np.take_along_axis(made[live], shift, 1)
                n[live] -= 1
                rank[live, n[live] - 1] = NEVER
                for at in (best - 1, best):
                    ok = np.flatnonzero((at >= 0) & (at < n[live] - 1))
                    r, c = live[ok], at[ok]
                    rank[r, c], made[r, c] = self.lookup(ids[r, c], ids[r, c + 1])
            for i, row, k in zip(which, ids.tolist(), n.tolist()):
                out[i] = row[:k]
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = self.merge(w)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of a long word: the lowest rank first, from the left, with a heap over a linked list."""
        ids = [self.byte_id[c] for c in word]
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merged[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merged]
        heap = [(r, i, z, p) for r, z, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, p = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j], nxt[i] = z, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] < n and (q := (ids[x], ids[nxt[x]])) in self.merged:
                    r, z2 = self.merged[q]
                    heapq.heappush(heap, (r, x, z2, q))
        return [t for t in ids if t >= 0]

    def learn(self, words: Iterable[str]) -> None:
        """Put the encodings of new distinct words into the cache."""
        words = list(words)
        raw = [w.encode() for w in words]
        flat, owner = self.propose(raw)
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        wrong = np.bincount(owner, weights=self.size[flat], minlength=len(raw)) != lens  # not covered: cannot be, but would show here
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        wrong[owner[pairs[~self.compatible(flat[pairs], flat[pairs + 1])]]] = True
        ends = np.cumsum(np.bincount(owner, minlength=len(raw))).tolist()
        ids = flat.tolist()
        self.cache.update(zip(words, [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends)]))
        failing = np.flatnonzero(wrong).tolist()
        self.cache.update(zip([words[i] for i in failing], map(tuple, self.merge_many([raw[i] for i in failing]))))

    def pieces(self, text: str) -> list[str]:
        return self.words.findall(text)

    def cut(self, texts: list[str]) -> list[list[tuple[int, list[str]]]]:
        """Each text's parts, (special id or -1, words) in order; all words are in the cache then."""
        parts: list[list[tuple[int, list[str]]]] = []
        new: set[str] = set()
        for t in texts:
            own = []
            for s in self.splitter.split(t) if self.splitter and any(x in t for x in self.special) else (t,):
                if s in self.special:
                    own.append((self.special[s], []))
                elif s:
                    own.append((-1, self.pieces(s)))
                    new.update(own[-1][1])
            parts.append(own)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new.difference_update(self.cache)
        if new:
            self.learn(new)
        return parts

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        get = self.cache.__getitem__
        return [list(chain.from_iterable([i] if i >= 0 else chain.from_iterable(map(get, w)) for i, w in own)) for own in self.cut(texts)]

    def count_many(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.sizes.clear()
        split, extra = [], []
        for t in texts:
            parts = self.splitter.split(t) if self.splitter and any(x in t for x in self.special) else [t]
            words = [w for s in parts if s not in self.special for w in self.words_of(s)] if len(parts) > 1 else self.words_of(t)
            split.append(words)
            extra.append(sum(s in self.special for s in parts) if len(parts) > 1 else 0)
        return [n + k for n, k in zip(sums_of(split, self.sizes, self._learn_sizes), extra)]

    def words_of(self, text: str) -> list[str]:
        """:meth:`pieces`, by the shorter pattern where that is the same."""
        return EASY_WORDS.findall(text) if EASY.fullmatch(text) else self.pieces(text)

    def _learn_sizes(self, words: set[str]) -> None:
        if new := words.difference(self.cache):
            self.learn(new)
        self.sizes.update((w, len(self.cache[w])) for w in words)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


def sums_of(split: list[list[str]], sizes: dict[str, int], learn) -> list[int]:
    """The sum of the sizes of each text's pieces. The pieces of texts that have unknown ones are learned together."""
    get, out, late = sizes.__getitem__, [], []
    for k, pieces in enumerate(split):
        try:
            out.append(sum(map(get, pieces)))
        except KeyError:
            out.append(0)
            late.append(k)
    if late:
        learn(set().union(*[split[k] for k in late]).difference(sizes))
        for k in late:
            out[k] = sum(map(get, split[k]))
    return out


_made: dict[str, ByteBPE] = {}


def encoder(spec: str) -> ByteBPE:
    """The worker's encoder for a vocabulary, made once."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made[key] = ByteBPE(spec)
    return _made[key]


def batches_of(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """Consecutive texts of at most ``most`` characters in all, or one longer text."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > most:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; with ``with_ids`` also the ids and the decoded text."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the corpus

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for batch in it:
            done = 0
            for texts in batches_of(strings(batch, "text").to_pylist()):
                ids = bpe.encode_many(texts)
                back = [bpe.decode(x) for x in ids]
                cols = [
                    batch.column("doc_id").slice(done, len(texts)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(bpe.digits.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
                    names += ["ids", "decoded"]
                done += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    src = only(docs, "doc_id", "text")
    return src.select(src["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
