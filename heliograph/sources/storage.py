"""Paths in any store that Spark reads: existence, small text files, and the layout of a catalogue."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Tasks that list a tree's folders, at most.
LISTINGS = 48


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old one or the new one: by one move over it where the store has that; stores without
    such a move show a file only when it is complete."""
    jvm, hidden = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}"
    fs, target = file_system(spark, path)
    if fs.getUri().getScheme() == "file":  # whose connector deletes before it moves
        local = Path(target.toUri().getPath())
        (local.parent / f".{local.name}.crc").unlink(missing_ok=True)
        new = local.with_name(f"{local.name}.{uuid.uuid4().hex}")
        new.write_text(text, encoding="utf-8")
        new.replace(local)
        return
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    except Py4JJavaError as e:
        if "UnsupportedFileSystemException" not in str(e.java_exception.toString()):
            raise
        write_text(spark, path, text)
        return
    write_text(spark, hidden, text)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(hidden), target, how)


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times of change (ms) of what is in a folder; none if there is no such folder."""
    fs, p = file_system(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[None]:
    """Folders of many partitions are listed by so few tasks; by default each folder is a task, which sends the driver more than the names."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name, None)
    spark.conf.set(name, min(LISTINGS, int(before)) if before else LISTINGS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def directory_of(order: int, pix: int) -> str:
    """Where a partition's files are, below its tree."""
    return f"Norder={order}/Dir={pix // 10000 * 10000}/Npix={pix}"


def partition_of(path: str) -> tuple[int, int]:
    """Order and pixel in a partition's path."""
    m = re.search(r"Norder=?(\d+)/(?:Dir=?\d+/)?Npix=?(\d+)", path)
    if not m:
        raise ValueError(f"{path} names no partition")
    return int(m[1]), int(m[2])


def arrow_uri(uri: str) -> str:
    """A path as Hadoop writes it, as pyarrow reads it."""
    return re.sub("^file:/+", "file:///", uri).replace("s3a://", "s3://", 1)


def set_storage_options(spark: SparkSession, path: str, options: dict[str, str] | None) -> None:
    """Pass a store's options to its Hadoop connector. For abfs(s) paths account_name, tenant_id, client_id and
    client_secret are needed and set up OAuth; other options are set as they are named."""
    if not options:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if path.startswith(("abfs://", "abfss://")):
        missing = [k for k in ("account_name", "tenant_id", "client_id", "client_secret") if k not in options]
        if missing:
            raise ValueError(f"storage options lack {', '.join(missing)}")
        host = f"{options['account_name']}.dfs.core.windows.net"
        for k, v in {
            "account.auth.type": "OAuth",
            "account.oauth.provider.type": "org.apache.hadoop.fs.azurebfs.oauth2.ClientCredsTokenProvider",
            "account.oauth2.client.id": options["client_id"],
            "account.oauth2.client.secret": options["client_secret"],
            "account.oauth2.client.endpoint": f"https://login.microsoftonline.com/{options['tenant_id']}/oauth2/token",
        }.items():
            conf.set(f"fs.azure.{k}.{host}", v)
    else:
        for k, v in options.items():
            conf.set(k, str(v))
