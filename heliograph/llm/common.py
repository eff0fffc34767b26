"""What the training-data operators share: the shared folder, Arrow views and packing of rows into blocks."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a new folder of this machine if all
    executors are on it (tests), else an error."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("heliograph.shared.dir", None)
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="heliograph-")
            spark.conf.set("heliograph.shared.dir", root)
    return root.rstrip("/")


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def claim_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that only its owner can read, unless it exists: of several writers one gets True. On a plain file system by an
    exclusive open; elsewhere by the store's creation without overwriting."""
    fs, p = _file(spark, path)
    if fs.getUri().getScheme() == "file":
        local = Path(p.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        return True
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    try:
        fs.setPermission(p, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def claimed_text(spark: SparkSession, path: str, wait_s: float = 10.0) -> str:
    """What a claim says; its writer may still be at it."""
    end = time.monotonic() + wait_s
    while not (text := read_text(spark, path)) and time.monotonic() < end:
        time.sleep(0.05)
    return text


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Workspace:
    """Tables that a job writes to the shared folder to cut its lineage; each one survives a lost executor. Results are lazy and read
    them, so the folder goes when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        fs, p = _file(spark, self.path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as written and read again."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps; it acts when the driver's JVM collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with empty strings for nulls."""
    return pc.fill_null(batch.column(name), "")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and where each row starts (one entry more than rows)."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``start .. start + len``."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; others of the input, whatever their names, are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
