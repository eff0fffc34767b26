"""Token-count rollups that are maintained by signed deltas.

A batch is a table of changes (kind, doc_id, source, lang, tokenizer_version, n_tokens, old_tokens): an ``insert`` adds a document and its
tokens, a ``delete`` takes them away, a ``revise`` adds the new count less the old one. A batch is reduced to one additive row a
source, language and tokenizer version (partial sums before the shuffle, so no hot source gathers in a task).

Commits are idempotent. A batch is written to a hidden folder; then a claim, a file with the hash of its rows that one writer alone can
create, binds the batch's name to these rows; then the folder is moved, in one step, to a name made of hashes of the batch's name and
of its rows. Sending it again finds the name; sending other rows under a claimed name raises before anything is moved, so
what a commit answered with True never changes. Of writers with equal rows one gets True, as a move that comes second lands inside the
first one's folder and is taken away. A writer that dies behind its claim leaves the name to the same rows; :meth:`Rollup.release`
frees it for others.

:meth:`Rollup.compact` folds committed batches into one table, which lists all batches that were ever folded into it. A batch or
fold that another fold lists whole does not count, so folding may break off after any step, and what it left is removed by
the next one. The totals are the sums over what counts.

Cases: null sources, languages and versions are groups of their own; null counts count as zero; unknown kinds raise;
repeated rows each count; an empty batch commits and adds nothing; totals of no batch are an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import Workspace, claim_text, claimed_text, documents, only, read_text, strings, write_text

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("n_docs", "n_tokens")
CHANGES = ("kind", "doc_id", *KEYS, "n_tokens", "old_tokens")
#: Texts whose counts a task remembers.
KNOWN_TEXTS = 100_000
DELTA = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"


def delta(changes: DataFrame) -> DataFrame:
    """The additive row of each group that a batch touches."""
    kind = F.col("kind")
    sign = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null")))))
    new, old = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    tokens = F.when(kind == "revise", new - old).when(kind == "delete", -new).otherwise(new)
    rows = only(changes, *CHANGES).select(*[F.col(k).cast("string").alias(k) for k in KEYS], sign.cast("bigint").alias("n_docs"), tokens.cast("bigint").alias("n_tokens"))
    return rows.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS])


class OtherContents(ValueError):
    pass


class Rollup:
    """A rollup in a folder that all executors see."""

    NAMES = "_names"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # one call each, so that tests can break off after any of them

    def _move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(f"{self.path}/{old}"), self._path(f"{self.path}/{new}")) and not self._fs.exists(self._path(f"{self.path}/{new}")):
            raise OSError(f"{old} can't be moved to {new}")

    def _remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(DELTA).parquet(f"{self.path}/{name}")

    def _write_names(self, folder: str, names: frozenset[str]) -> None:
        write_text(self.spark, f"{self.path}/{folder}/{self.NAMES}", "\n".join(sorted(names)))

    def _stored(self) -> dict[str, frozenset[str]]:
        """All batches and folds that were moved to their names, each with the batches in it."""
        if not self._fs.exists(self._path(self.path)):
            return {}
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        out = {n: frozenset([n]) for n in found if n.startswith("batch-")}
        for n in found:
            if n.startswith("fold-"):
                out[n] = frozenset(read_text(self.spark, f"{self.path}/{n}/{self.NAMES}").split())
        return out

    def _counting(self) -> dict[str, frozenset[str]]:
        """What counts: batches and folds that no other fold lists whole."""
        found = self._stored()
        out: dict[str, frozenset[str]] = {}
        for name, own in sorted(found.items(), key=lambda x: (-len(x[1]), not x[0].startswith("fold-"), x[0])):
            if any(own <= other for other in out.values()):
                continue
            if any(own & other for other in out.values()):
                raise RuntimeError(f"{name} overlaps another fold in {self.path}")
            out[name] = own
        return out

    def _key(self, batch: str) -> str:
        return f"batch-{hashlib.sha256(batch.encode()).hexdigest()[:24]}"

    def _committed_as(self, batch: str) -> list[str]:
        key = self._key(batch)
        return sorted({b for own in self._counting().values() for b in own if b.startswith(key)})

    def committed(self, batch: str) -> bool:
        return bool(self._committed_as(batch))

    def _claim(self, key: str) -> str:
        return f"{self.path}/_claims/{key}"

    def _claimed(self, key: str, rows: str) -> str:
        """The hash of the rows that the name is bound to, ours if no other writer was first."""
        return rows if claim_text(self.spark, self._claim(key), rows) else claimed_text(self.spark, self._claim(key))

    def release(self, batch: str) -> bool:
        """Free a name whose writer died between its claim and its move; False if the batch was committed or nobody claimed it."""
        claim = self._claim(self._key(batch))
        return not self.committed(batch) and self._fs.exists(self._path(claim)) and self._fs.delete(self._path(claim), False)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before. Other changes under a claimed name raise."""
        hidden, key = f"_{uuid.uuid4().hex}", self._key(batch)
        try:
            rows = digest(self._write(delta(changes), hidden))
            name = f"{key}-{rows}"
            old = self._committed_as(batch)
            if (old or [f"{key}-{self._claimed(key, rows)}"]) != [name]:
                raise OtherContents(f"batch {batch!r} was committed or claimed with other rows")
            if old:
                return False
            self._move(hidden, name)
            second = f"{name}/{hidden}"
            if self._fs.exists(self._path(f"{self.path}/{second}")):
                self._remove(second)
                return False
            return True
        finally:
            self._remove(hidden)

    def totals(self) -> DataFrame:
        """n_docs and n_tokens of each source, language and tokenizer version that was ever counted."""
        found = [f"{self.path}/{n}" for n in self._counting()]
        rows = self.spark.read.schema(DELTA).parquet(*found) if found else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in SUMS])

    def compact(self) -> None:
        """Fold all that counts into one table. Nothing changes until its one move; then what it replaces is removed."""
        self._clean()
        found = self._counting()
        if len(found) < 2:
            return
        names = frozenset().union(*found.values())
        hidden = f"_{uuid.uuid4().hex}"
        self._write(self.totals(), hidden)
        self._write_names(hidden, names)
        self._move(hidden, f"fold-{hashlib.sha256(' '.join(sorted(names)).encode()).hexdigest()[:24]}")
        self._clean()

    def _clean(self) -> None:
        """Remove what does not count any more."""
        for n in sorted(set(self._stored()) - set(self._counting())):
            self._remove(n)


def digest(rows: DataFrame) -> str:
    """A hash of a small additive table's rows, whatever their order. Its rows are those of groups that changed; only one hash a task
    reaches the driver."""
    one = F.sha2(F.to_json(F.struct(*KEYS, *SUMS), {"ignoreNullFields": "false"}), 256)
    part = [F.conv(F.substring(one, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    sums = rows.agg(F.count("*"), *[F.coalesce(F.sum(p), F.lit(0)) for p in part]).first()
    return hashlib.sha256(repr(tuple(sums)).encode()).hexdigest()[:24]


def counted(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, a hash of the text, and the number of tokens by each tokenizer (a file by its version's name)."""
    from heliograph.llm.bpe import batches_of

    specs = {}
    for name, path in tokenizers.items():
        with open(path, encoding="utf-8") as f:
            specs[name] = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(specs)  # vocabulary files, whatever the corpus

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {k: counter(v) for k, v in shared.value.items()}
        known: dict[str | None, tuple[int, ...]] = {}  # counts of the task's latest texts, of which copies are not encoded again
        for batch in it:
            texts, keys = strings(batch, "text").to_pylist(), batch.column("text_key").to_pylist()
            if len(known) > KNOWN_TEXTS:
                known.clear()
            new = {k: t for k, t in zip(keys, texts) if k not in known}
            names = iter(new)
            for some in batches_of(list(new.values())):
                counts = zip(*[c.count_many(some) for c in made.values()])
                known.update(zip(islice(names, len(some)), counts))
            n = zip(*map(known.__getitem__, keys))
            keep = [batch.column(c) for c in ("doc_id", "source", "lang", "text_key")]
            yield pa.RecordBatch.from_arrays([*keep, *[pa.array(x, pa.int64()) for x in (n if keys else [[]] * len(made))]], names=["doc_id", "source", "lang", "text_key", *made])

    src = only(docs, "doc_id", "source", "lang", "text")
    src = src.select(src["doc_id"].cast("bigint").alias("doc_id"), src["source"].cast("string").alias("source"), src["lang"].cast("string").alias("lang"), "text", F.sha2("text", 256).alias("text_key"))
    return src.mapInArrow(run, "doc_id bigint, source string, lang string, text_key string, " + ", ".join(f"`{k}` bigint" for k in tokenizers))


def counter(spec: str):
    """A counter of tokens for a vocabulary file; byte-level files go to our own encoder, others through the library."""
    import json

    from heliograph.llm import bpe, token_store

    if json.loads(spec)["normalizer"] is None:
        return bpe.encoder(spec)
    key = hashlib.sha256(spec.encode()).hexdigest()
    return token_store._made.get(key) or token_store._made.setdefault(key, token_store.WordIds(spec))


def changes(table: DataFrame, kind: str, version: str, count: str | None = None, old: str | None = None) -> DataFrame:
    """A batch of changes of one kind from a table of counts."""
    n = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("bigint")
    return table.select(F.lit(kind).alias("kind"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), n(count).alias("n_tokens"), n(old).alias("old_tokens"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: every document is inserted under the byte-level vocabulary with a provisional count (its
    characters); those counts are revised to tokens; every document is inserted under the word vocabulary; of
    documents with one text all but the one with the smallest doc_id are deleted. The second batch is sent twice."""
    import public_tokenizers

    ws = Workspace(spark, "token-rollup")
    one, two = "byte_bpe_50k", "word_bpe_49k"
    counts = ws.stage(counted(documents(spark, sf_dir).select("*"), {one: public_tokenizers.path(f"{one}.json"), two: public_tokenizers.path(f"{two}.json")}), "counts")
    lengths = only(documents(spark, sf_dir), "doc_id", "source", "lang", "n_chars")
    rollup = Rollup(spark, f"{ws.path}/rollup")
    rollup.commit("load", changes(lengths, "insert", one, "n_chars"))
    # additive: the old count leaves and the new one comes, from two tables that need not be joined
    recount = changes(counts, "revise", one, one).unionByName(changes(lengths, "revise", one, None, "n_chars"))
    rollup.commit("recount", recount)
    rollup.commit("recount", recount)
    rollup.commit("second vocabulary", changes(counts, "insert", two, two))
    # a written table, so that the adaptive skew join can split a text that many documents have
    several = counts.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first = ws.stage(several.select("text_key", "first_id"), "first")
    copies = counts.join(first, "text_key").where("doc_id > first_id")
    rollup.commit("delete copies", changes(copies, "delete", one, one).unionByName(changes(copies, "delete", two, two)))
    return rollup.totals()
