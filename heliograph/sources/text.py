"""Rows of csv texts: physical lines numbered in each file, marks of missing values, and types."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.operators.columns import TYPES, quoted, resolve
from heliograph.sources.web import is_web, web_lines, whole_lines

#: What users of dataframe libraries have for missing values in csv files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|Infinity|INF)\s*$"
LINES = "value string, path string, start bigint, k bigint"


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of files in any store that Spark reads, with file, split and the line's number in its split."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in it:  # a task has its splits one after the other, each in order
            places = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()))
            k = []
            for place in places:
                n = n + 1 if place == at else 0
                at = place
                k.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k, pa.int64())], names=["value", "path", "start", "k"])

    text = spark.read.option("recursiveFileLookup", True).text(paths)
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).mapInArrow(run, LINES)


def numbered(lines: DataFrame) -> DataFrame:
    """value, path and ``line``: the physical line's number in its file. Only lengths of splits are summed, and a file that is not
    split needs none of them."""
    sizes = lines.groupBy("path", "start").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("path", "start", F.coalesce(before, F.lit(0)).alias("base"))
    return lines.join(base, ["path", "start"]).select("value", "path", (F.col("base") + F.col("k")).alias("line"))


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first lines of a file, of one of a folder's files."""
    if is_web(path):
        return [line.decode("utf-8", "replace") for line in islice(whole_lines(path), n)]
    return [r.value for r in spark.read.option("recursiveFileLookup", True).text(path).take(n)]


def csv_by_lines(spark: SparkSession, paths: list[str], skiprows: list[int] | None, header: bool) -> DataFrame:
    """All columns as strings. Each file has its own numbers of lines: its ``skiprows`` go, and the first line left is its header."""
    skip = sorted({int(r) for r in skiprows or [] if int(r) >= 0})
    top = next(i for i in range(len(skip) + 1) if i not in set(skip))
    head = first_lines(spark, paths[0], top + 1)
    if len(head) <= top:
        raise ValueError(f"{paths[0]} has no line left")
    fields = next(csv.reader([head[top]]))
    names = fields if header else [f"_c{i}" for i in range(len(fields))]
    here, there = [p for p in paths if not is_web(p)], [p for p in paths if is_web(p)]
    sources = [file_lines(spark, here)] * bool(here) + [web_lines(spark, there)] * bool(there)
    lines = sources[0] if len(sources) == 1 else sources[0].unionByName(sources[1])
    gone = [*skip, *([top] if header else [])]
    # what is left out is null before it is parsed, so that no filter pushed down meets a header's words as values
    if gone == [0]:  # a first line is the first of the split that starts its file
        lines = lines.withColumn("value", F.when((F.col("start") > 0) | (F.col("k") > 0), F.col("value")))
    elif gone:
        lines = numbered(lines).withColumn("value", F.when(~F.col("line").isin(gone), F.col("value")))
    schema = ", ".join(f"{quoted(n)} string" for n in names)
    rows = lines.where(F.col("value").isNotNull() & (F.trim("value") != "")).select(F.from_csv("value", schema, {"escape": '"'}).alias("r"))
    return rows.select(*[F.col(f"r.{quoted(n)}") for n in names])


def typed(raw: DataFrame, dtypes: dict[str, str] | None = None) -> DataFrame:
    """Strings as values: marks of missing ones are null, columns with a type given are read as that, and the others' types (bigint, double,
    boolean, string) are found in one pass over them."""
    given = {c: TYPES.get(t, t) for c, t in (dtypes or {}).items() if resolve(raw, c)}
    value = {c: F.when(~F.col(quoted(c)).isin(*MISSING), F.col(quoted(c))) for c in raw.columns}
    unknown = [c for c in raw.columns if c not in given]
    if unknown:
        tests = {
            "bigint": lambda v: v.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(v).try_cast("bigint").isNotNull(),
            "double": lambda v: v.rlike(NUMBER),
            "boolean": lambda v: F.lower(v).isin("true", "false"),
        }
        found = raw.agg(*[F.bool_and(F.when(value[c].isNotNull(), test(value[c]))).alias(f"{i} {kind}") for i, c in enumerate(unknown) for kind, test in tests.items()]).first()
        for i, c in enumerate(unknown):
            given[c] = next((kind for kind in tests if found[f"{i} {kind}"]), "string")
    cast = lambda c: value[c] if given[c] == "string" else F.trim(value[c]).cast(given[c])
    return raw.select(*[cast(c).alias(c) for c in raw.columns])
