"""FITS binary tables: read by ranges of rows, written from tasks, one file or a folder of them; sky maps in such tables.

Reading plans from header blocks alone. A partition is a range of rows of one file, read in chunks, so a file's size does not matter.
Files are opened where pyarrow has their store (plain files, hdfs, s3, gs) or by ranges over http(s). In other stores Spark's
binary source hands over a file at a time, which must then be under 2 GB.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from heliograph.operators.columns import quoted
from heliograph.sources import storage
from heliograph.sources.web import is_web, read_range, stat

BLOCK, CARD = 2880, 80
#: Big-endian numpy types and SQL types of the format's codes.
CODES = {"L": ("S1", "boolean"), "B": ("u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}


Fetch = Callable[[int, int], bytes]
SPLIT_BYTES, CHUNK_BYTES = 128 << 20, 8 << 20


def header(fetch: Fetch, at: int) -> tuple[dict, int]:
    """The cards of the header at a place, and where its data starts."""
    cards: dict = {}
    while True:
        block = fetch(at, BLOCK).decode("ascii", "replace")
        if len(block) < BLOCK:
            raise ValueError("the FITS header is cut off")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD]
            name = card[:8].strip()
            if name == "END":
                return cards, at
            if card[8:10] == "= ":
                m = re.match(r"\s*(?:'((?:[^']|'')*)'|([^/]*))", card[10:])
                raw = m[1].replace("''", "'").rstrip() if m[1] is not None else m[2].strip()
                cards[name] = raw if m[1] is not None else {"T": True, "F": False}.get(raw, raw)


@dataclass
class Layout:
    """The first binary table of a file: columns (name, code, repeat, offset, scale, zero, null), bytes a row, rows, start, cards."""

    cols: list[tuple]
    width: int
    rows: int
    start: int
    cards: dict


def layout(fetch: Fetch, size: int) -> Layout:
    """From the headers alone; data before the table is passed over."""
    at = 0
    while at < size:
        cards, at = header(fetch, at)
        number = lambda k, d=0: int(cards.get(k, d))
        if cards.get("XTENSION") == "BINTABLE":
            cols, off = [], 0
            for i in range(1, number("TFIELDS") + 1):
                m = re.fullmatch(r"(\d*)([A-Z])(.*)", cards[f"TFORM{i}"])
                if m[2] not in CODES:
                    raise ValueError(f"FITS columns of format {cards[f'TFORM{i}']} are not supported")
                n = int(m[1] or 1)
                cols.append((cards.get(f"TTYPE{i}", f"col{i}"), m[2], n, off, float(cards.get(f"TSCAL{i}", 1)), float(cards.get(f"TZERO{i}", 0)), cards.get(f"TNULL{i}")))
                off += n * (1 if m[2] == "A" else np.dtype(CODES[m[2]][0]).itemsize)
            if off != number("NAXIS1"):
                raise ValueError("the FITS columns do not fill a row")
            if at + off * number("NAXIS2") > size:
                raise ValueError("the FITS table is cut off")
            return Layout(cols, off, number("NAXIS2"), at, cards)
        length = abs(number("BITPIX", 8)) // 8 * number("GCOUNT", 1) if number("NAXIS") else 0
        for i in range(1, number("NAXIS") + 1):
            length *= number(f"NAXIS{i}")
        length += number("PCOUNT") if number("NAXIS") else 0
        at += -(-length // BLOCK) * BLOCK
    raise ValueError("the FITS file has no binary table")


def table(data: bytes) -> Layout:
    return layout(lambda at, n: data[at : at + n], len(data))


def sql_type(col: tuple) -> str:
    name, code, n, _, scale, zero, _ = col
    kind = CODES[code][1]
    if code in "BIJK" and (scale, zero) != (1, 0):
        kind = "double" if scale != 1 or zero % 1 else "bigint"
    return kind if code == "A" or n == 1 else f"array<{kind}>"


def arrow_column(col: tuple, raw: np.ndarray) -> pa.Array:
    name, code, n, off, scale, zero, null = col
    width = n if code == "A" else n * np.dtype(CODES[code][0]).itemsize
    body = np.ascontiguousarray(raw[:, off : off + width])
    if code == "A":
        return pa.array([b.split(b"\0")[0].decode("utf-8", "replace").rstrip() for b in body.view(f"S{n}").ravel().tolist()] if n else [""] * len(raw), pa.string())
    v = body.view(CODES[code][0])
    if code == "L":
        values, mask = v == b"T", (v != b"T") & (v != b"F")
    else:
        mask = v == int(null) if null is not None and code in "BIJK" else np.zeros(v.shape, bool)
        v = v.astype(v.dtype.newbyteorder("="))
        values = v.astype(np.int16) if code == "B" else v
        if (scale, zero) != (1, 0) and code in "BIJK":
            values = v * scale + zero if sql_type(col).removeprefix("array<").startswith("double") else v.astype(np.int64) + np.int64(zero)
        elif (scale, zero) != (1, 0):
            values = (v * scale + zero).astype(v.dtype)
    if n == 1:
        return pa.array(values.ravel(), mask=mask.ravel())
    flat = pa.array(values.ravel(), mask=mask.ravel())
    return pa.ListArray.from_arrays(np.arange(0, len(raw) * n + 1, n, dtype=np.int32), flat)


def opened(uri: str) -> tuple[Fetch, int] | None:
    """Access by place and the size of a file; None in a store that only Spark reads."""
    if is_web(uri):
        length, ranges, _ = stat(uri)
        if length is None or not ranges:
            raise ValueError(f"the server of {uri} gives no ranges")
        return (lambda at, n: read_range(uri, at, min(at + n, length))), length
    try:
        fs, path = pafs.FileSystem.from_uri(storage.arrow_uri(uri))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    f = fs.open_input_file(path)
    return (lambda at, n: f.read_at(n, at)), f.size()


def batch_of(cols: list[tuple], raw: np.ndarray, row: str | None = None, first: int = 0) -> pa.RecordBatch:
    arrays = [arrow_column(c, raw) for c in cols] + [pa.array(np.arange(first, first + len(raw)))] * bool(row)
    return pa.RecordBatch.from_arrays(arrays, names=[c[0] for c in cols] + [row] * bool(row))


@dataclass
class Rows(InputPartition):
    uri: str
    at: int
    first: int
    n: int
    width: int
    cols: list[tuple]  # its own marks of missing numbers


class FitsTables(DataSource):
    """``heliograph_fits``: the rows of files' first binary tables."""

    @classmethod
    def name(cls) -> str:
        return "heliograph_fits"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return FitsReader(json.loads(o["uris"]), json.loads(o["all_columns"]), json.loads(o["wanted"]), o.get("row_column"), int(o["split_bytes"]))


class FitsReader(DataSourceReader):
    def __init__(self, uris: list[str], all_columns: list, wanted: list[int], row: str | None, split_bytes: int):
        self.uris, self.all, self.wanted, self.row, self.split_bytes = uris, [tuple(c) for c in all_columns], wanted, row, split_bytes

    def partitions(self) -> list[Rows]:
        def of(uri: str) -> list[Rows]:
            own = layout(*opened(uri))
            if [c[:6] for c in own.cols] != [c[:6] for c in self.all]:
                raise ValueError(f"{uri} differs from {self.uris[0]} in its columns")
            step = max(1, self.split_bytes // max(1, own.width))
            return [Rows(uri, own.start + a * own.width, a, min(step, own.rows - a), own.width, [own.cols[i] for i in self.wanted]) for a in range(0, own.rows, step)]

        with ThreadPoolExecutor(16) as pool:
            return [r for rows in pool.map(of, self.uris) for r in rows]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file has rows
            return
        fetch, _ = opened(part.uri)
        step = max(1, CHUNK_BYTES // max(1, part.width))
        for a in range(0, part.n, step):
            n = min(step, part.n - a)
            data = fetch(part.at + a * part.width, n * part.width)
            if len(data) < n * part.width:
                raise OSError(f"{part.uri} is cut off")
            yield batch_of(part.cols, np.frombuffer(data, np.uint8).reshape(n, part.width), self.row, part.first + a)


def files_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files behind paths, folders and patterns."""
    found = []
    for path in paths:
        if is_web(path):
            found.append(path)
            continue
        fs, p = storage.file_system(spark, path)
        statuses = fs.globStatus(p)
        if not statuses:
            raise FileNotFoundError(path)
        for s in statuses:
            inner = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
            found += [str(x.getPath()) for x in inner if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(", ".join(paths))
    return found


def read_fits(spark: SparkSession, paths: list[str], columns: list[str] | None = None, row_column: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of the files' first binary tables; the files have the same columns. Only ``columns`` are decoded; ``row_column`` names a
    column for the row's number in its file."""
    uris = files_of(spark, paths)
    access = opened(uris[0])
    if access is None:
        if row_column:
            raise ValueError(f"{uris[0]} is in a store without ranges, so rows have no numbers")
        found = whole_files(spark, uris)
        return found.select(*[quoted(c) for c in columns]) if columns else found
    cols = layout(*access).cols
    names = [c[0] for c in cols]
    if missing := [c for c in columns or [] if c not in names]:
        raise ValueError(f"there is no column {', '.join(missing)}")
    wanted = [names.index(c) for c in columns] if columns else list(range(len(cols)))
    schema = ", ".join([f"{quoted(cols[i][0])} {sql_type(cols[i])}" for i in wanted] + ([f"{quoted(row_column)} bigint"] if row_column else []))
    spark.dataSource.register(FitsTables)
    reader = spark.read.format("heliograph_fits").option("uris", json.dumps(uris)).option("all_columns", json.dumps(cols)).option("wanted", json.dumps(wanted)).option("schema", schema).option("split_bytes", str(split_bytes))
    return (reader.option("row_column", row_column) if row_column else reader).load()


def whole_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").load(uris)

    def names(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(table(x.as_py()).cols) for x in batch.column("content")])], names=["columns"])

    # a file's header is read where the file is; only the columns' layout reaches the driver
    cols = [tuple(c) for c in json.loads(files.select("content").limit(1).mapInArrow(names, "columns string").first()["columns"])]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                data = batch.column("content")[i].as_py()
                own = table(data)
                if [c[:6] for c in own.cols] != [c[:6] for c in cols]:
                    raise ValueError("the FITS files differ in their columns")
                raw = np.frombuffer(data, np.uint8, own.rows * own.width, own.start).reshape(own.rows, own.width)
                for a in range(0, own.rows, 100_000):
                    yield batch_of(own.cols, raw[a : a + 100_000])

    return files.select("content").mapInArrow(run, ", ".join(f"{quoted(c[0])} {sql_type(c)}" for c in cols))


# ---- writing ----

#: The format's codes and big-endian numpy types of SQL types.
WRITTEN = {"boolean": ("L", "S1"), "tinyint": ("I", ">i2"), "smallint": ("I", ">i2"), "int": ("J", ">i4"), "bigint": ("K", ">i8"), "float": ("E", ">f4"), "double": ("D", ">f8"), "string": ("A", "S")}
WRITE_BYTES = 4 << 20
#: Bytes of a file in a folder of them; a task holds so much.
FILE_BYTES = 64 << 20


def card(name: str, value) -> bytes:
    text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'" if isinstance(value, str) else f"{'T' if value is True else 'F' if value is False else value:>20}"
    return f"{name:<8}= {text}".ljust(CARD).encode()


def header_bytes(cards: list[tuple[str, object]]) -> bytes:
    raw = b"".join(card(*c) for c in cards) + b"END".ljust(CARD)
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def encoded(column: pa.Array, code: str, n: int, null: int | None) -> np.ndarray:
    """A row of bytes for each value."""
    rows = len(column)
    if code == "A":
        return np.array([(v or "").encode() for v in column.to_pylist()], f"S{max(1, n)}").view(np.uint8).reshape(rows, -1)[:, :n]
    if pa.types.is_list(column.type):
        column = column.flatten()
    kind = next(k for c, k in WRITTEN.values() if c == code)
    if code == "L":
        mask = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
        values = np.where(mask, b"\0", np.where(column.fill_null(False).to_numpy(zero_copy_only=False), b"T", b"F")).astype("S1")
    else:
        values = column.fill_null(float("nan") if code in "ED" else null if null is not None else 0).to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(rows, -1)


def planned(df: DataFrame) -> tuple[int, list[tuple], list[tuple[str, object]], int]:
    """Rows, the columns' (code, repeat, null), their cards and bytes a row of a table for a frame."""
    cols, facts = [], []
    for i, (name, kind) in enumerate(df.dtypes):
        inner = kind.removeprefix("array<").removesuffix(">")
        if inner not in WRITTEN or kind.startswith("array<") and inner == "string":
            raise ValueError(f"column {name} of type {kind} has no format in FITS tables")
        c = F.col(quoted(name))
        size = F.octet_length(c) if kind == "string" else F.size(c) if kind != inner else F.lit(1)
        v = F.explode(c) if kind != inner else c
        facts += [F.min(size).alias(f"low{i}"), F.max(size).alias(f"high{i}"), F.count_if(c.isNull()).alias(f"gone{i}")]
        if WRITTEN[inner][0] in "IJK":
            least = F.array_min(c) if kind != inner else c
            nulls = F.count_if(F.exists(c, lambda x: x.isNull())) if kind != inner else F.count_if(c.isNull())
            facts += [F.min(least).alias(f"least{i}"), nulls.alias(f"nulls{i}")]
        cols.append((name, inner, kind != inner, v))
    seen = df.agg(F.count("*").alias("rows"), *facts).first()
    plan, head = [], []
    for i, (name, inner, many, _) in enumerate(cols):
        code, form = WRITTEN[inner]
        n = int((seen[f"high{i}"] or 0) if inner == "string" or many else 1)
        if many and seen["rows"] and (seen[f"low{i}"] != seen[f"high{i}"] or seen[f"gone{i}"]):
            raise ValueError(f"the arrays of column {name} differ in length")
        null = None
        if code in "IJK" and seen[f"nulls{i}"]:
            null = -(1 << 8 * np.dtype(form).itemsize - 1)
            if seen[f"least{i}"] == null:
                raise ValueError(f"column {name} has nulls and no number to spare for them")
        plan.append((code, n, null))
        head += [(f"TTYPE{i + 1}", name), (f"TFORM{i + 1}", f"{n}{code}")] + [(f"TNULL{i + 1}", null)] * (null is not None)
    width = sum(n * (1 if code == "A" else np.dtype(next(k for c, k in WRITTEN.values() if c == code)).itemsize) for code, n, _ in plan)
    return seen["rows"], plan, head, width


def headers(n_cols: int, head: list[tuple[str, object]], width: int, rows: int, cards: dict[str, object] | None = None) -> tuple[bytes, bytes]:
    first = header_bytes([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)])
    second = header_bytes([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", n_cols), *head, *(cards or {}).items()])
    return first, second


def bodies(batch: pa.RecordBatch, plan: list[tuple], width: int, most: int = WRITE_BYTES) -> Iterator[np.ndarray]:
    """The rows' bytes, a few MB at a time."""
    step = max(1, most // max(1, width))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        yield np.concatenate([encoded(part.column(i), *p) for i, p in enumerate(plan)], axis=1)


def write_fits(df: DataFrame, path: str, cards: dict[str, object] | None = None) -> int:
    """One file with the rows in the frame's order, its bytes made in tasks; the driver only hands blocks of a few MB on. Arrays of a
    column have one length. Null numbers get a number that the column does not have (TNULL), NaN for fractions, no text for
    strings. Returns the number of rows."""
    spark = df.sparkSession
    n_rows, plan, head, width = planned(df)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in it:
            for body in bodies(batch, plan, width):
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([body.tobytes()], pa.binary())], names=["task", "number", "bytes"])
                number += 1

    hidden = f"{path}.{uuid.uuid4().hex}"
    df.mapInArrow(run, "task int, number int, bytes binary").write.parquet(f"{hidden}.blocks")
    blocks = spark.read.parquet(f"{hidden}.blocks").orderBy("task", "number")
    first, second = headers(len(plan), head, width, n_rows, cards)
    fs, target = storage.file_system(spark, path)
    local = Path(target.toUri().getPath()) if fs.getUri().getScheme() == "file" else None
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(hidden)
    out = local.with_name(hidden.rpartition("/")[2]).open("wb") if local else fs.create(new, False)
    written = 0
    try:
        for piece in (first, second):
            out.write(piece if local else bytearray(piece))
        for r in blocks.toLocalIterator():  # a few MB a row, some rows at a time
            out.write(r["bytes"])
            written += len(r["bytes"])
        out.write(bytearray(-written % BLOCK))
    finally:
        out.close()
        storage.delete(spark, f"{hidden}.blocks")
    if written != width * n_rows:
        storage.delete(spark, hidden)
        raise OSError(f"{written} bytes were written instead of {width * n_rows}; did the rows change meanwhile?")
    if local:
        local.with_name(hidden.rpartition("/")[2]).replace(local)
    else:
        fs.delete(target, False)
        fs.rename(new, target)
    return n_rows


def write_fits_files(df: DataFrame, folder: str, cards: dict[str, object] | None = None, file_bytes: int = FILE_BYTES) -> int:
    """A new folder of FITS files with the rows, each written whole by a task where pyarrow has the store, as it is read again; only their names
    reach the driver, which moves them from a hidden folder when all are there, so a task that ran twice or broke off leaves nothing. Elsewhere
    one file by way of the driver. Returns the number of rows."""
    spark = df.sparkSession
    fs, target = storage.file_system(spark, folder)
    if fs.exists(target):
        raise FileExistsError(folder)
    hidden = f"{fs.makeQualified(target)}/_{uuid.uuid4().hex}"
    try:
        pafs.FileSystem.from_uri(storage.arrow_uri(hidden))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return write_fits(df, f"{folder}/part-00000-00000.fits", cards)
    n_rows, plan, head, width = planned(df)
    most = max(1, file_bytes // max(1, width))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(storage.arrow_uri(hidden))
        held: list[np.ndarray] = []
        number = 0

        def written() -> pa.RecordBatch:
            n = sum(map(len, held))
            name = f"part-{TaskContext.get().partitionId():05d}-{number:05d}-{uuid.uuid4().hex}.fits"
            with store.open_output_stream(f"{path}/{name}") as out:
                for piece in (*headers(len(plan), head, width, n, cards), *(b.tobytes() for b in held), bytes(-n * width % BLOCK)):
                    out.write(piece)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

        for batch in it:
            for body in bodies(batch, plan, width, min(WRITE_BYTES, file_bytes)):
                held.append(body)
                if sum(map(len, held)) >= most:
                    yield written()
                    number += 1
        if held:
            yield written()

    Path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(Path_(hidden))
    try:
        files = df.mapInArrow(run, "name string, n bigint").collect()  # a row a file
        if sum(r["n"] for r in files) != n_rows:
            raise OSError(f"{sum(r['n'] for r in files)} rows were written instead of {n_rows}; did the rows change meanwhile?")
        if not files:  # one without rows has the columns
            out = fs.create(Path_(f"{hidden}/part-00000-00000.fits"), False)
            out.write(bytearray(b"".join(headers(len(plan), head, width, 0, cards))))
            out.close()
        for name in [r["name"] for r in files] or ["part-00000-00000.fits"]:
            if not fs.rename(Path_(f"{hidden}/{name}"), Path_(f"{folder.rstrip('/')}/{name}")):
                raise OSError(f"{name} could not be moved to {folder}")
    finally:
        storage.delete(spark, hidden)
    return n_rows


# ---- maps ----

MAP_ROW = 1024


def write_map(counts: DataFrame, order: int, path: str) -> None:
    """All pixels of an order with the counts of (pix, n), 0 for the others, as a map of the whole sky in the published form: rows of
    up to 1,024 pixels, NESTED. Its size depends on the order alone."""
    spark = counts.sparkSession
    npix, wide = 12 << 2 * order, min(MAP_ROW, 1 << 2 * order)
    some = counts.groupBy((F.col("pix") / wide).cast("bigint").alias("row")).agg(F.collect_list(F.struct((F.col("pix") % wide).cast("int").alias("at"), F.col("n").cast("bigint").alias("n"))).alias("cells"))
    rows = spark.range(npix // wide).join(some, F.col("id") == F.col("row"), "left").select("id", "cells")

    def dense(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = np.zeros((batch.num_rows, wide), np.int64)
            cells = batch.column("cells")
            flat = cells.flatten()
            size = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out[np.repeat(np.arange(batch.num_rows), size), flat.field("at").to_numpy()] = flat.field("n").to_numpy()
            values = pa.ListArray.from_arrays(np.arange(0, out.size + 1, wide, dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), values], names=["id", "N"])

    full = rows.mapInArrow(dense, "id bigint, N array<bigint>").orderBy("id").select("N")
    write_fits(full, path, {"PIXTYPE": "HEALPIX", "ORDERING": "NESTED", "NSIDE": 1 << order, "FIRSTPIX": 0, "LASTPIX": npix - 1, "INDXSCHM": "IMPLICIT", "OBJECT": "FULLSKY"})


def read_map(spark: SparkSession, path: str, ordering: str | None = None) -> tuple[DataFrame, int]:
    """(pix, n) of the pixels above 0 and the order of a map of the whole sky. ``ordering`` says what a header says wrongly, as some
    writers name maps in the nested scheme RING."""
    access = opened(files_of(spark, [path])[0])
    if access is None:
        raise ValueError(f"{path} is in a store without ranges")
    own = layout(*access)
    if own.cards.get("PIXTYPE") != "HEALPIX" or own.cards.get("INDXSCHM", "IMPLICIT") != "IMPLICIT":
        raise ValueError(f"{path} is no map of the whole sky")
    if (ordering or own.cards.get("ORDERING", "")) != "NESTED":
        raise ValueError(f"{path} is not in the nested scheme")
    order, name = int(own.cards["NSIDE"]).bit_length() - 1, own.cols[0][0]
    wide = own.cols[0][2]
    if own.rows * wide != 12 << 2 * order:
        raise ValueError(f"{path} has {own.rows * wide} pixels, not all of order {order}")
    rows = read_fits(spark, [path], [name], "__row")
    value = F.col(quoted(name)) if wide > 1 else F.array(F.col(quoted(name)))
    cells = rows.select("__row", F.posexplode(value).alias("at", "n"))
    return cells.where("n > 0").select((F.col("__row") * wide + F.col("at")).alias("pix"), F.col("n").cast("bigint").alias("n")), order
