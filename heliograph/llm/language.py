"""Language mixtures: expectation-maximisation over spans of a document.

Each language has a multinomial over hashed letter trigrams. A document is a mixture of languages, each of its spans of
``SPAN`` trigrams drawn from one; expectation-maximisation estimates the proportions. The set of languages starts with
the best one and grows by the language that gains most, as long as the gain in log-likelihood exceeds half the logarithm
of the document's spans, times ``PENALTY``. The language with the largest proportion is the prediction, that proportion
its score.

The multinomials are fitted on a sample of the learnable rows (text and lang present, crc32 of doc_id modulo 4 other than 2): all
of a language with at most ``SAMPLE`` of them, else each by a hash of its doc_id at the rate SAMPLE / rows, so about
``SAMPLE`` documents a language. All values of lang are learned; with more than ``LANGUAGES`` of them, whose table would be too large for a
worker, there is an error. Predictions read whole texts of all documents, never lang, source or doc_id.

Cases: null text or text without a letter gives `und` with score 0; so does any text if nothing was learned; texts of any
length are read whole; equal texts give equal rows; null doc_ids have held_out null; an empty table gives an empty table;
other columns are ignored. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import documents, only, strings

BINS = 1 << 15
SPAN = 24
SAMPLE = 2000
#: Values of lang beyond which there is an error: each takes 128 KB of a worker's table.
LANGUAGES = 1024
ROUNDS = 12
PENALTY = 2.0
#: Set of languages per document at most is the number learned; a gain below this (nats) never counts.
LEAST_GAIN = 1e-6
UNKNOWN = "und"
CHARS_AT_ONCE = 1 << 19
LETTER = regex.compile(r"\p{L}")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all letter trigrams of the texts (words are padded by a blank; other characters count as one), and trigrams a text."""
    lower = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, lower), np.int64, len(lower))
    blank = (points < 0x61) | ((points > 0x7A) & (points < 0xAA))
    points = np.where(blank, np.uint32(32), points)
    a, b, c = points[:-2].astype(np.uint64), points[1:-1].astype(np.uint64), points[2:].astype(np.uint64)
    h = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)
    bins = ((h ^ (h >> np.uint64(9))) % np.uint64(BINS)).astype(np.int64)
    use = ~(blank[:-2] & blank[1:-1])
    ends = np.cumsum(lens)
    for e in (ends[:-1] - 1, ends[:-1] - 2):  # trigrams across two texts
        use[e[e >= 0]] = False
    at = np.flatnonzero(use)
    doc = np.searchsorted(ends, at, side="right")
    return bins[at], np.bincount(doc, minlength=len(texts))


def learnable(docs: DataFrame) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    return only(docs, "doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder != 2))


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages and their log-probabilities, a row a bin. The driver gets a row a language and bin."""
    spark = docs.sparkSession
    rows = learnable(docs)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"there are more than {LANGUAGES} values of lang")
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BINS, 0), np.float32)
    rates = spark.createDataFrame([(x, min(1.0, sample / counts[x])) for x in langs], "lang string, rate double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(rates), "lang").where(unit < F.col("rate")).select("text", "lang")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in it:
            texts, lang = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for t, x in zip(texts, lang):
                if x not in total:
                    total[x] = np.zeros(BINS, np.int64)
                total[x] += np.bincount(trigrams([t])[0], minlength=BINS)
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bin", "n"])

    table = np.full((BINS, len(langs)), 0.05)
    place = {x: i for i, x in enumerate(langs)}
    for r in chosen.mapInArrow(run, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        table[r.bin, place[r.lang]] += r.n
    return langs, np.log(table / table.sum(0)).astype(np.float32)


class Mixture:
    """Proportions for many documents at once, from the log-likelihoods of their spans."""

    def __init__(self, spans: np.ndarray, doc: np.ndarray, n_docs: int):
        self.top = spans.max(1, keepdims=True) if spans.size else np.zeros((len(spans), 1))
        self.like = np.exp(np.maximum(spans - self.top, -60.0))
        self.doc, self.n_docs = doc, n_docs
        self.first = np.searchsorted(doc, np.arange(n_docs))
        self.size = np.bincount(doc, minlength=n_docs)

    def total(self, values: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, np.cumsum(size) - size, axis=0)

    def run(self, who: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For documents ``who``, each with its allowed languages: proportions and log-likelihood."""
        from heliograph.llm.common import ranges

        size = self.size[who]
        rows = ranges(self.first[who], size)
        like, owner = self.like[rows], np.repeat(np.arange(len(who)), size)
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            r = like * share[owner]
            r /= r.sum(1, keepdims=True)
            share = self.total(r, rows, size) / size[:, None]
        fit = np.log((like * share[owner]).sum(1)) + self.top[rows, 0]
        return share, self.total(fit, rows, size)

    def infer(self) -> np.ndarray:
        """Proportions of each document (all zero without spans)."""
        n_lang = self.like.shape[1]
        out = np.zeros((self.n_docs, n_lang))
        who = np.flatnonzero(self.size)
        if not len(who) or not n_lang:
            return out
        size = self.size[who]
        single = self.total((np.log(self.like) + self.top)[ranges_of(self.first[who], size)], None, size)
        allowed = np.zeros((len(who), n_lang))
        allowed[np.arange(len(who)), single.argmax(1)] = 1
        out[who] = allowed
        best = single.max(1)
        price = np.maximum(PENALTY * 0.5 * np.log(np.maximum(2, size)), LEAST_GAIN)
        # what any mixture could gain at most: each span in its own best language
        bound = self.total(self.top[ranges_of(self.first[who], size), 0], None, size)
        live = np.flatnonzero(bound - best > price)
        while len(live):
            gain, new_share, pick = np.full(len(live), -np.inf), np.zeros((len(live), n_lang)), np.full(len(live), -1)
            for k in range(n_lang):
                may = np.flatnonzero(allowed[live, k] == 0)
                if len(may):
                    a = allowed[live[may]].copy()
                    a[:, k] = 1
                    share, fit = self.run(who[live[may]], a)
                    better = fit > gain[may]
                    gain[may] = np.where(better, fit, gain[may])
                    new_share[may[better]], pick[may[better]] = share[better], k
            ok = gain - best[live] > price[live]
            go = live[ok]
            allowed[go, pick[ok]] = 1
            best[go], out[who[go]] = gain[ok], new_share[ok]
            live = go[allowed[go].sum(1) < n_lang]
        return out


def ranges_of(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    from heliograph.llm.common import ranges

    return ranges(first, size)


def mixtures(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The language proportions of each text."""
    bins, n = trigrams(texts)
    spans = np.maximum(1, n // SPAN) * (n > 0)  # a text's last span takes the rest
    doc_of = np.repeat(np.arange(len(texts)), spans)
    within = np.arange(len(doc_of)) - np.repeat(np.cumsum(spans) - spans, spans)
    starts = (np.cumsum(n) - n)[doc_of] + within * SPAN
    if not len(starts):
        return np.zeros((len(texts), table.shape[1]))
    return Mixture(np.add.reduceat(table[bins], starts, axis=0).astype(np.float64), doc_of, len(texts)).infer()


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], with_mixture: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, and with ``with_mixture`` all proportions as a map."""
    from heliograph.llm.bpe import batches_of

    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BINS rows of LANGUAGES numbers at most, whatever the corpus

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            done = 0
            for texts in batches_of(strings(batch, "text").to_pylist(), CHARS_AT_ONCE):
                letters = [LETTER.search(t) is not None for t in texts]
                share = mixtures(texts, shared.value)
                best = share.argmax(1) if langs else np.zeros(len(texts), int)
                sure = [x and bool(langs) and share[i].any() for i, x in enumerate(letters)]
                cols = [
                    batch.column("doc_id").slice(done, len(texts)),
                    batch.column("held_out").slice(done, len(texts)),
                    pa.array([langs[best[i]] if x else UNKNOWN for i, x in enumerate(sure)], pa.string()),
                    pa.array([min(1.0, float(share[i, best[i]])) if x else 0.0 for i, x in enumerate(sure)], pa.float64()),
                ]
                names = ["doc_id", "held_out", "lang_pred", "score"]
                if with_mixture:
                    cols.append(pa.array([[(langs[k], float(v)) for k, v in enumerate(row) if v > 0] if sure[i] else [] for i, row in enumerate(share)], pa.map_(pa.string(), pa.float64())))
                    names.append("mixture")
                done += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    src = only(docs, "doc_id", "text")
    src = src.select(src["doc_id"].cast("bigint").alias("doc_id"), (F.crc32(src["doc_id"].cast("string")) % 4 == 2).alias("held_out"), "text")
    return src.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double" + (", mixture map<string,double>" if with_mixture else ""))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
