"""Lines of text files behind http(s) addresses, as a data source that plans a partition a file or a range of its bytes."""

from __future__ import annotations

import http.client
import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition where the server gives ranges of a file that is not compressed.
SPLIT_BYTES = 64 << 20
CHUNK_BYTES, BATCH_LINES = 1 << 20, 20_000
ATTEMPTS, PAUSE_S, TIMEOUT_S = 5, 0.2, 60.0


def is_web(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def stat(url: str) -> tuple[int | None, bool, str]:
    """Length (None if the server does not tell), whether ranges are served, and a mark that changes with the content."""
    with tried(lambda: urlopen(Request(url, method="HEAD"), timeout=TIMEOUT_S)) as answer:
        h = answer.headers
        length = int(h["Content-Length"]) if h["Content-Length"] else None
        return length, h.get("Accept-Ranges", "").lower() == "bytes", h["ETag"] or h["Last-Modified"] or ""


def tried(action, attempts: int = ATTEMPTS):
    """The action's result; connections that break and errors of the server are tried again, after longer and longer pauses."""
    for k in range(attempts):
        try:
            return action()
        except HTTPError as e:
            if e.code < 500 and e.code not in (408, 429) or k == attempts - 1:
                raise
        except (URLError, http.client.HTTPException, OSError):
            if k == attempts - 1:
                raise
        time.sleep(PAUSE_S * 2**k)


@dataclass
class Range(InputPartition):
    url: str
    start: int
    stop: int | None  # None for a whole file, whose length may be unknown
    length: int | None
    ranges: bool


def received(part: Range) -> Iterator[bytes]:
    """The bytes from just before the range to the file's end, whole or not at all: a broken or short answer is asked for
    again from where it stopped."""
    at, failed = max(part.start - 1, 0), 0
    while True:
        before = at
        try:
            ask = Request(part.url, headers={"Range": f"bytes={at}-"} if at and part.ranges else {})
            with urlopen(ask, timeout=TIMEOUT_S) as answer:
                left = at if at and answer.status != 206 else 0  # a server that starts anew
                while left and (data := answer.read(min(left, CHUNK_BYTES))):
                    left -= len(data)
                while data := answer.read(CHUNK_BYTES):
                    at += len(data)
                    yield data
            if part.length is None or at >= part.length:
                return
            raise http.client.IncompleteRead(b"", part.length - at)
        except HTTPError as e:
            if e.code < 500 and e.code not in (408, 429):
                raise
            error: Exception = e
        except (URLError, http.client.HTTPException, OSError) as e:
            error = e
        failed = 1 if at > before else failed + 1  # an answer that brought bytes on is progress
        if failed >= ATTEMPTS:
            raise OSError(f"{part.url} could not be read beyond byte {at} of {part.length}") from error
        time.sleep(PAUSE_S * 2**failed)


def read_range(url: str, start: int, stop: int) -> bytes:
    """The bytes from ``start`` to before ``stop``, from a server with ranges."""

    def ask() -> bytes:
        with urlopen(Request(url, headers={"Range": f"bytes={start}-{stop - 1}"}), timeout=TIMEOUT_S) as answer:
            data = answer.read(stop if answer.status != 206 else stop - start)
        data = data[start:] if answer.status != 206 else data
        if len(data) < stop - start:
            raise http.client.IncompleteRead(data, stop - start - len(data))
        return data

    return tried(ask)


def unzipped(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file, of one member or several."""
    member, fresh = zlib.decompressobj(31), True
    for data in chunks:
        while data:
            fresh = False
            yield member.decompress(data)
            data = member.unused_data
            if member.eof:
                member, fresh = zlib.decompressobj(31), True
                data = data.lstrip(b"\0")  # padding
    if not fresh:
        raise OSError("a gzip file is cut off")


def lines(chunks: Iterator[bytes], part: Range) -> Iterator[bytes]:
    """Lines that start in the range; \\n and \\r\\n end a line."""
    stop = part.stop
    at, held, skip = max(part.start - 1, 0), b"", part.start > 0
    for data in chunks:
        held += data
        *whole, held = held.split(b"\n")
        for line in whole:
            start, at = at, at + len(line) + 1
            if skip:
                skip = False  # the end of a line that starts before the range
            elif stop is not None and start >= stop:
                return
            else:
                yield line.removesuffix(b"\r")
        if stop is not None and at >= stop and not skip:
            return
    if held and not skip and (stop is None or at < stop):
        yield held.removesuffix(b"\r")


def whole_lines(url: str) -> Iterator[bytes]:
    length, ranges, _ = stat(url)
    part = Range(url, 0, None, length, ranges)
    chunks = received(part)
    return lines(unzipped(chunks) if url.endswith(".gz") else chunks, part)


class WebLines(DataSource):
    """``heliograph_web_lines``: value, path, start (of the partition in its file) and k (the line's number in the partition)."""

    @classmethod
    def name(cls) -> str:
        return "heliograph_web_lines"

    def schema(self) -> str:
        return "value string, path string, start bigint, k bigint"

    def reader(self, schema) -> DataSourceReader:
        return WebLinesReader(json.loads(self.options["urls"]), int(self.options.get("split_bytes", SPLIT_BYTES)))


class WebLinesReader(DataSourceReader):
    def __init__(self, urls: list[str], split_bytes: int):
        self.urls, self.split_bytes = urls, split_bytes

    def partitions(self) -> list[Range]:
        found = []
        for url in self.urls:
            length, ranges, _ = stat(url)
            if length is None or not ranges or url.endswith(".gz"):
                found.append(Range(url, 0, None, length, ranges))
            else:
                found += [Range(url, a, min(a + self.split_bytes, length), length, True) for a in range(0, length, self.split_bytes)]
        return found

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        chunks = received(part)
        held, k = [], 0

        def batch() -> pa.RecordBatch:
            n = len(held)
            cols = [pa.array(held, pa.string()), pa.repeat(part.url, n), pa.repeat(pa.scalar(part.start, pa.int64()), n), pa.array(range(k - n, k), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["value", "path", "start", "k"])

        for line in lines(unzipped(chunks) if part.url.endswith(".gz") else chunks, part):
            held.append(line.decode("utf-8", "replace"))
            k += 1
            if len(held) >= BATCH_LINES:
                yield batch()
                held = []
        if held:
            yield batch()


def web_lines(spark: SparkSession, urls: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(WebLines)
    return spark.read.format("heliograph_web_lines").option("urls", json.dumps(urls)).option("split_bytes", str(split_bytes)).load()
