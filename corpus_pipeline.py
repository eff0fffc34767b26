"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, pseudonyms, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Between
stages the documents are written as Parquet to the shared folder and read again. Decisions are joined to the documents by
doc_id (null-safe) and a hash of the text, so rows that share a doc_id are decided by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import bpe, decontam, pii, quality, similar
from heliograph.llm.common import Workspace, documents

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go. The field learns from labelled documents of this input."""
    field = quality.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash candidates, and all others that have a Jaccard similarity of 0.8 of their five-word shingles or more, are linked after
    exact verification. Of each group one document stays: that with the smallest doc_id, nulls last."""
    return similar.near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits_only=True).select(F.col("doc_id").alias("hit_id"), "text_key").distinct()
    same = docs["doc_id"].eqNullSafe(found["hit_id"]) & (F.xxhash64(docs["text"]) == found["text_key"])
    return docs.join(found, same, "left_anti")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts get pseudonyms; n_chars follows the text."""
    return pii.replace_text(docs, key_file=pii.own_key_file(spark)).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' digests of each document."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.stage(docs, name.replace(" ", "-"))
            if k:
                ws.drop(STAGES[k - 1][0].replace(" ", "-"))
    return docs
