"""Quality rules: base rules on words, and a linear-chain conditional random field over a document's lines.

Viterbi decoding marks each line as content or boilerplate. A document is kept if it passes the base rules and at least
``MIN_SHARE`` of its words stand in content lines.

Documents are labelled, lines are not: a line's label is latent. Fitting starts with the document's label on each line, but
lines that come back between different neighbours (``REPEATS`` such places in the sample, so copied documents do not count) are
boilerplate whatever their document, and are remembered as a feature. Then the field is fitted piece by piece (lines by
themselves, then pairs of neighbours) and lines that it contradicts by ``SURE`` change their label, except that the least of a bad
document's lines stays boilerplate; this is done ``TURNS`` times. So a document's lines get mixed labels, and the scores of
neighbours are learnt from real changes.

The field is fitted on at most ``SAMPLE`` labelled documents of either quality with at most ``MOST_LINES`` lines each (those with
the smallest hashes of doc_id, and of the text where documents share one). All else covers whole texts of all documents.

Cases: null text has no words and fails; an empty text, too; texts of any length are read whole; equal rows give equal rows;
a document with several labels counts with each; null labels are left out; without labels of both kinds every line
is content; an empty table gives an empty table; other columns are ignored. Ties in decoding go to content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import blocks, byte_view, documents, only, strings

MIN_WORDS = 20
WINDOW = 8
MIN_SHARE = 0.5
#: Labelled documents of each quality that the field is fitted on, at most.
SAMPLE = 1000
#: Lines of a document that is fitted on, at most.
MOST_LINES = 500
ROUNDS = 150
#: Places of a line, with different neighbours, from which on it is boilerplate; log-odds that change a line's label; how often.
REPEATS, SURE, TURNS = 3, 2.0, 3
#: Characters that count as symbols, and cut points of the line features.
SYMBOLS = b"#*$%&|<>"
CUTS = {"words": (1, 2, 3, 5, 8, 13, 21, 40), "mean": (2.5, 3.5, 4.5, 5.5, 6.5, 8), "symbols": (0.001, 0.02, 0.08, 0.2), "upper": (0.001, 0.1, 0.3, 0.6), "digits": (0.001, 0.05, 0.2), "marks": (0.001, 0.05, 0.15), "short": (0.001, 0.1, 0.25, 0.4), "same": (0.001, 0.2, 0.5)}
LICENCE = re.compile(rb"licen[cs]ed? under|licence,|copyright|all rights reserved|cookie|https?://", re.I)
N_FEATURES = 1 + sum(len(c) + 1 for c in CUTS.values()) + 4
#: The columns of a line's features; that of known lines comes first after the cut points.
KNOWN, KNOWN_FEATURE, WIDTH = 1 + len(CUTS), N_FEATURES - 4, len(CUTS) + 5
_BYTE = {
    "space": np.isin(np.arange(256), [32, *range(9, 14)]),
    "symbol": np.isin(np.arange(256), list(SYMBOLS)),
    "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digit": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "mark": np.isin(np.arange(256), list(b"!?;:{}[]()=\"_/\\~^")),
    "point": (np.arange(256) & 0xC0) != 0x80,
}


def base_counts(texts: list[bytes]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    out = np.zeros((len(texts), 5), np.int64)
    codes: dict[bytes, int] = {}
    flat: list[int] = []
    for r, t in enumerate(texts):
        words = t.split()
        flat.extend([codes.setdefault(w, len(codes)) for w in words])
        lines = [x for x in t.split(b"\n") if x.strip()]
        a = np.frombuffer(t, np.uint8)
        out[r, :4] = len(words), np.count_nonzero(_BYTE["point"][a] & ~_BYTE["space"][a]), np.count_nonzero(_BYTE["symbol"][a]), len(lines) - len(set(lines))
    out[:, 4] = repeated(np.array(flat, np.int64), out[:, 0])
    return out


def repeated(codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each document, its words in windows of ``WINDOW`` words that it has twice or more."""
    n = len(codes)
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(lens)), lens)
    inside = np.arange(n) + WINDOW <= ends[doc] if n else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(len(lens), np.int64)
    # pairs of equal halves, doubled until they span a window, name each window exactly
    name = np.append(codes, np.full(WINDOW, -1))
    span = 1
    while span < WINDOW:
        _, name = np.unique(name[:-span] * (int(name.max()) + 2) + name[span:] + 1, return_inverse=True)
        span *= 2
    _, which, many = np.unique(doc[at] * (int(name.max()) + 1) + name[at], return_inverse=True, return_counts=True)
    hit = at[many[which] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return np.bincount(doc, weights=np.cumsum(cover)[:n] > 0, minlength=len(lens)).astype(np.int64)


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(line.split()))


def line_features(texts: list[bytes], known: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Active features of each line with a word (a column a group), its words, the lines' documents and their hashes. ``known``
    are hashes of lines that are known to come back."""
    lines, doc, again = [], [], []
    for r, t in enumerate(texts):
        seen: set[bytes] = set()
        for x in t.split(b"\n"):
            if x.strip():
                lines.append(x)
                doc.append(r)
                again.append(x in seen)
                seen.add(x)
    n = len(lines)
    if not n:
        return np.zeros((0, WIDTH), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    size = np.fromiter(map(len, lines), np.int64, n) + 1
    first = np.cumsum(size) - size
    total = lambda flags: np.add.reduceat(flags, first, dtype=np.int64)
    space = _BYTE["space"][data]
    begins = ~space & np.concatenate([[True], space[:-1]])
    at = np.flatnonzero(begins)
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    chars = np.concatenate([[0], np.cumsum(_BYTE["point"][data])])
    word_len = chars[ends] - chars[at]
    word_line = np.searchsorted(first, at, side="right") - 1
    words = np.bincount(word_line, minlength=n)
    letters = np.maximum(1, np.bincount(word_line, weights=word_len, minlength=n))
    values = {
        "words": words, "mean": letters / words, "symbols": total(_BYTE["symbol"][data]) / letters, "upper": total(_BYTE["upper"][data]) / letters,
        "digits": total(_BYTE["digit"][data]) / letters, "marks": total(_BYTE["mark"][data]) / letters, "short": np.bincount(word_line, weights=word_len <= 3, minlength=n) / words,
        "same": 1 - np.fromiter((len(set(x.split())) for x in lines), np.int64, n) / words,
    }
    cols, base = [np.zeros(n, np.int64)], 1
    for name, cuts in CUTS.items():
        cols.append(base + np.searchsorted(cuts, values[name], side="right"))
        base += len(cuts) + 1
    own = np.fromiter(map(line_hash, lines), np.uint64, n)
    for flags in (np.fromiter((h in known for h in own.tolist()), bool, n), np.array(again), np.fromiter((LICENCE.search(x) is not None for x in lines), bool, n), np.fromiter((x.rstrip()[-1:] in b".!?" for x in lines), bool, n)):
        cols.append(np.where(flags, base, N_FEATURES))  # the last weight is always zero
        base += 1
    return np.stack(cols, 1).astype(np.int32), words, np.array(doc, np.int64), own


def neighbours(doc: np.ndarray, values: np.ndarray, none) -> tuple[np.ndarray, np.ndarray]:
    """For each line the value of the line before and after it in its document."""
    same = doc[1:] == doc[:-1]
    before, after = np.full(len(doc), none, values.dtype), np.full(len(doc), none, values.dtype)
    before[1:][same], after[:-1][same] = values[:-1][same], values[1:][same]
    return before, after


def coming_back(doc: np.ndarray, own: np.ndarray) -> frozenset[int]:
    """Hashes of lines that stand in ``REPEATS`` places with different neighbours."""
    if not len(doc):
        return frozenset()
    before, after = neighbours(doc, own, 0)
    places = np.unique(np.stack([own, before, after], 1), axis=0)
    line, n = np.unique(places[:, 0], return_counts=True)
    return frozenset(line[n >= REPEATS].tolist())


class LineField:
    """Two states (0 boilerplate, 1 content); ``weights`` score content by feature, ``pairs`` score neighbours; ``known`` are hashes of
    lines that come back."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray, known: frozenset[int] = frozenset()):
        self.weights, self.pairs, self.known = weights, pairs, known

    @classmethod
    def fit(cls, feats: np.ndarray, doc: np.ndarray, content: np.ndarray, known: frozenset[int] = frozenset(), fixed: np.ndarray | None = None) -> LineField:
        """The field of documents with lines of latent labels. ``content`` is the documents' label on each line, ``fixed`` marks
        lines that are boilerplate in any case."""
        if not len(doc) or content.all() or not content.any():
            w = np.zeros(N_FEATURES + 1)
            w[0] = 1.0
            return cls(w, np.zeros((2, 2)))
        fixed = np.zeros(len(doc), bool) if fixed is None else fixed
        y = content & ~fixed
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for turn in range(TURNS):
            out = cls.fit_lines(feats, doc, y, known)
            score = out.weights[feats].sum(1)
            label = np.where(score >= SURE, True, np.where(score <= -SURE, False, y)) & ~fixed
            worst = np.minimum.reduceat(score, start)
            bad = ~content & (score == np.repeat(worst, np.diff(np.append(start, len(doc)))))
            label &= ~bad
            if (label == y).all():
                break
            y = label
        return out

    @classmethod
    def fit_lines(cls, feats: np.ndarray, doc: np.ndarray, y: np.ndarray, known: frozenset[int]) -> LineField:
        """Piecewise training on labelled lines, with Gaussian priors, by gradient steps on all lines at once: first the lines' own
        scores, as neighbours would explain them away in documents that are alike all through; then the neighbours' scores, by the
        pseudo-likelihood of each line given its own score and its neighbours."""
        n = len(doc)
        w, t = np.zeros(N_FEATURES + 1), np.zeros((2, 2))

        def climb(v: np.ndarray, gradient) -> None:
            s1, s2 = np.zeros_like(v), np.zeros_like(v)
            for k in range(1, ROUNDS + 1):
                g = gradient()
                s1 += 0.1 * (g - s1)
                s2 += 0.01 * (g * g - s2)
                v += 0.1 * (s1 / (1 - 0.9**k)) / (np.sqrt(s2 / (1 - 0.99**k)) + 1e-9)

        def of_lines() -> np.ndarray:
            miss = y - 1 / (1 + np.exp(-w[feats].sum(1)))
            g = np.bincount(feats.ravel(), weights=np.repeat(miss, feats.shape[1]), minlength=N_FEATURES + 1) / n - 1e-4 * w
            g[N_FEATURES] = 0
            return g

        climb(w, of_lines)
        own = w[feats].sum(1)
        before, after = neighbours(doc, y.astype(np.int64), 2)
        left, right = ([np.flatnonzero(side == a) for a in (0, 1)] for side in (before, after))

        def of_pairs() -> np.ndarray:
            odds = own.copy()
            for a in (0, 1):
                odds[left[a]] += t[a, 1] - t[a, 0]
                odds[right[a]] += t[1, a] - t[0, a]
            miss = y - 1 / (1 + np.exp(-odds))
            g = -1e-3 * t
            for a in (0, 1):
                on_left, on_right = miss[left[a]].sum() / n, miss[right[a]].sum() / n
                g[a] += [-on_left, on_left]
                g[:, a] += [-on_right, on_right]
            return g

        climb(t, of_pairs)
        return cls(w, t, known)

    def decode(self, feats: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Viterbi: is each line content? Chains run over whole documents."""
        if not len(doc):
            return np.zeros(0, bool)
        e, t = self.weights[feats].sum(1), self.pairs
        new = np.concatenate([[True], doc[1:] != doc[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(doc)))
        order = np.argsort(-size, kind="stable")  # at step k only the first chains still run
        start, size = start[order], size[order]
        back = np.zeros((len(doc), 2), bool)
        best = np.zeros((len(start), 2))
        best[:, 1] = e[start]
        running = [int(np.searchsorted(-size, -k, side="left")) for k in range(int(size[0]))]
        for k in range(1, int(size[0])):
            r = running[k]
            prev, at = best[:r], start[:r] + k
            from1 = prev[:, 1:] + t[1] >= prev[:, :1] + t[0]
            back[at] = from1
            best[:r] = np.where(from1, prev[:, 1:] + t[1], prev[:, :1] + t[0])
            best[:r, 1] += e[at]
        out = np.zeros(len(doc), bool)
        state = best[:, 1] >= best[:, 0]
        for k in range(int(size[0]) - 1, -1, -1):
            r = running[k]
            at = start[:r] + k
            out[at] = state[:r]
            state[:r] = back[at, state[:r].astype(int)]
        return out


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = MOST_LINES) -> LineField:
    """The field of a labelled sample; line features of at most ``2 * sample`` documents of at most ``most_lines`` lines reach the driver."""
    lab = only(labels, "doc_id", "quality").where("doc_id IS NOT NULL")
    order = (F.xxhash64("doc_id"), "doc_id")
    parts = [lab.where(F.col("quality") == q).distinct().orderBy(*order).limit(sample) for q in (0, 1)]
    chosen = parts[0].unionByName(parts[1])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = byte_view(strings(batch, "text"))
            raw, q = data.tobytes(), batch.column("quality").to_numpy(zero_copy_only=False)
            for r in range(batch.num_rows):
                text = raw[offs[r] : offs[r + 1]]
                feats, _, _, own = line_features([text])
                if 0 < len(own) <= most_lines:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(r, 1), pa.array([int(q[r])], pa.int32()), pa.array([line_hash(text) >> 1], pa.int64()), pa.array([feats.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())], names=["doc_id", "quality", "text_hash", "feats", "lines"])

    src = only(docs, "doc_id", "text")
    src = src.select(src["doc_id"].cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # chosen: at most 2 * sample rows
    found = src.mapInArrow(run, "doc_id bigint, quality int, text_hash bigint, feats binary, lines binary")
    rows = [r for q in (0, 1) for r in found.where(F.col("quality") == q).dropDuplicates(["text_hash"]).orderBy(*order, "text_hash").limit(sample).collect()]
    lines = [np.frombuffer(r.lines, np.uint64) for r in rows]
    doc = np.repeat(np.arange(len(rows)), list(map(len, lines)))
    own = np.concatenate([np.zeros(0, np.uint64), *lines])
    feats = np.concatenate([np.zeros((0, WIDTH), np.int32), *[np.frombuffer(r.feats, np.int32).reshape(-1, WIDTH) for r in rows]])
    known = coming_back(doc, own)
    back = np.fromiter((h in known for h in own.tolist()), bool, len(own))
    feats[:, KNOWN] = np.where(back, KNOWN_FEATURE, N_FEATURES)
    content = np.array([r.quality == 1 for r in rows], bool)[doc] if rows else np.zeros(0, bool)
    return LineField.fit(feats, doc, content, known, back)


def verdict(texts: list[bytes], crf: LineField) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The base counts of each text, whether they fail, and the share of words in content lines."""
    base = base_counts(texts)
    feats, words, doc, _ = line_features(texts, crf.known)
    content = np.bincount(doc, weights=words * crf.decode(feats, doc), minlength=len(texts))
    return base, (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > 30 * base[:, 0]), content / np.maximum(1, base[:, 0])


def judge(docs: DataFrame, field: LineField, min_share: float = MIN_SHARE) -> DataFrame:
    """The base counts, base_failed, kept and content_share of each document."""
    field = (field.weights, field.pairs, field.known)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = LineField(*field)
        for batch in it:
            data, offs = byte_view(strings(batch, "text"))
            raw = data.tobytes()
            for i, j in blocks(offs):
                base, failed, share = verdict([raw[offs[x] : offs[x + 1]] for x in range(i, j)], crf)
                cols = [batch.column("doc_id").slice(i, j - i), *[pa.array(base[:, k]) for k in range(5)], pa.array(failed), pa.array(~failed & (share >= min_share)), pa.array(share)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in OUT])

    src = only(docs, "doc_id", "text")
    return src.select(src["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, ", ".join(OUT))


def keep(docs: DataFrame, field: LineField, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows, with all their columns, of documents that are kept."""
    field = (field.weights, field.pairs, field.known)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = LineField(*field)
        for batch in it:
            data, offs = byte_view(strings(batch, "text"))
            raw = data.tobytes()
            good = np.zeros(batch.num_rows, bool)
            for i, j in blocks(offs):
                _, failed, share = verdict([raw[offs[x] : offs[x + 1]] for x in range(i, j)], crf)
                good[i:j] = ~failed & (share >= min_share)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


OUT = ["doc_id bigint", "n_words bigint", "word_chars bigint", "n_symbols bigint", "n_dup_lines bigint", "n_repeat_words bigint", "base_failed boolean", "kept boolean", "content_share double"]


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
