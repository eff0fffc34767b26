"""Cross-match where the data lies: each split reads the files of two partitions of which one contains the other, and the second's margin
rows, so no row of either catalogue is shuffled.

A split is a tile of the sky: the finer of the two partitions, or a pixel in it where these have many rows. It streams the first side's rows
of its tile and holds the second side's rows of the tile's declinations, with the margin.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from heliograph.functions import healpix as hp
from heliograph.operators.margin import degrees_apart
from heliograph.operators.partitioning import ID_ORDER, RANK_BITS
from heliograph.sources import storage

#: Rows of a side beyond which a tile is split, rows of the first side in a batch, and pairs that are compared in step.
SPLIT_ROWS, BATCH, PAIRS = 2_000_000, 50_000, 2_000_000

Part = tuple[int, int]


def tree_files(spark: SparkSession, path: str) -> dict[Part, list[str]]:
    """The files of each partition of a tree."""
    found: dict[Part, list[str]] = {}
    with storage.few_listings(spark):  # by tasks; the store's own recursive listing asks a process for each file's owner on plain file systems
        files = spark.read.parquet(path).inputFiles()
    for x in files:
        if "/Norder=" in x:
            found.setdefault(storage.partition_of(x), []).append(x)
    return found


def opened(files: list[str]) -> ds.Dataset:
    """Parquet files in a store that pyarrow opens."""
    fs = pafs.FileSystem.from_uri(storage.arrow_uri(files[0]))[0]
    return ds.dataset([pafs.FileSystem.from_uri(storage.arrow_uri(f))[1] for f in files], format="parquet", filesystem=fs)


def pairs_of(one: list[Part], two: list[Part]) -> tuple[list[tuple[Part, Part]], list[Part]]:
    """Pairs of partitions of which one contains the other, and the first side's partitions that the second side doesn't cover."""
    firsts, seconds = set(one), set(two)
    inside: dict[Part, list[Part]] = {}
    for o, p in two:
        for up in range(o):
            if (above := (up, p >> 2 * (o - up))) in firsts:
                inside.setdefault(above, []).append((o, p))
    pairs, open_ = [], []
    for o, p in one:
        around = [a for a in ((up, p >> 2 * (o - up)) for up in range(o + 1)) if a in seconds]
        found = around or inside.get((o, p), [])
        pairs += [((o, p), q) for q in found]
        if not around and sum(4.0 ** (o - q[0]) for q in found) < 1:
            open_.append((o, p))
    return pairs, open_


def tiles_of(pair: tuple[Part, Part], rows: tuple[int, int]) -> list[Part]:
    """The tiles of a pair with so many rows in its partitions."""
    o, p = max(pair)
    most = max(n * 4.0 ** (q[0] - o) for q, n in zip(pair, rows))
    deeper = min(max(0, ID_ORDER - o), max(0, math.ceil(math.log(max(most, 1) / SPLIT_ROWS, 4))))
    return [(o + deeper, (p << 2 * deeper) + k) for k in range(1 << 2 * deeper)]


@dataclass
class Split(InputPartition):
    tile: Part
    whole: bool  # the tile is the first side's partition
    first: list[str]
    second: list[str]
    hips: Part


class LocalMatch(DataSource):
    """``heliograph_match``: pairs of near rows of two catalogues."""

    @classmethod
    def name(cls) -> str:
        return "heliograph_match"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def reader(self, schema) -> DataSourceReader:
        return LocalMatchReader(json.loads(self.options["plan"]), schema)


class Zones:
    """Positions in order of declination zones and right ascension, for the nearest ones to others."""

    def __init__(self, ra: np.ndarray, dec: np.ndarray, rank: np.ndarray, distance: float):
        self.distance, self.height = distance, max(distance, 1e-3) * 1.000001
        zone, turn = np.floor((dec + 90) / self.height), ra % 360
        self.order = np.lexsort((turn, zone))
        self.ra, self.dec, self.rank = (v[self.order] for v in (ra, dec, rank))
        self.key = zone[self.order] * 720 + turn[self.order]

    def windows(self, ra: np.ndarray, dec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches (from, to) of the order that hold all in reach: nine for each position."""
        d, far = self.distance, np.abs(dec) + self.distance
        wide = np.where(far >= 89.999, 180.0, np.degrees(np.arcsin(np.minimum(1.0, np.sin(np.radians(min(d, 90.0))) / np.maximum(np.cos(np.radians(dec)), 1e-12)))) * 1.000001 + 1e-6)
        zone, turn, lo, hi = np.floor((dec + 90) / self.height), ra % 360, [], []
        for dz in (-1, 0, 1):
            for shift in (-360, 0, 360):
                a = np.where(wide >= 180, 0.0, np.maximum(turn - wide + shift, 0.0))
                b = np.where(wide >= 180, 360.0 if shift == 0 else -1.0, np.minimum(turn + wide + shift, 360.0))
                s, e = np.searchsorted(self.key, (zone + dz) * 720 + a, "left"), np.searchsorted(self.key, (zone + dz) * 720 + b, "right")
                lo.append(s)
                hi.append(np.where(a <= b, np.maximum(s, e), s))
        return np.stack(lo, 1), np.stack(hi, 1)

    def nearest(self, ra: np.ndarray, dec: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which, which of the positions here, distance) of the ``n`` nearest, ties by rank, in bounded steps."""
        lo, hi = self.windows(ra, dec)
        step = np.cumsum((hi - lo).sum(1)) // PAIRS
        for k in np.unique(step):
            a, b = np.searchsorted(step, k, "left"), np.searchsorted(step, k, "right")
            s, size = lo[a:b].ravel(), (hi[a:b] - lo[a:b]).ravel()
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
            who = np.repeat(np.repeat(np.arange(a, b), 9), size)
            away = degrees_apart(ra[who], dec[who], self.ra[at], self.dec[at])
            near = away < self.distance
            who, at, away = who[near], at[near], away[near]
            by = np.lexsort((self.rank[at], away, who))
            who, at, away = who[by], at[by], away[by]
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
            keep = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)])) < n
            yield who[keep], self.order[at[keep]], away[keep]


class LocalMatchReader(DataSourceReader):
    def __init__(self, plan: dict, schema: StructType):
        self.plan, self.schema = plan, schema

    def __getstate__(self) -> dict:
        """Tasks get their own split only."""
        return {"plan": {k: v for k, v in self.plan.items() if k != "splits"}, "schema": self.schema}

    def partitions(self) -> list[Split]:
        return [Split(tuple(t), w, a, b, tuple(h)) for t, w, a, b, h in self.plan["splits"]]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no splits
            return
        plan, wanted = self.plan, to_arrow_schema(self.schema)
        (ra1, dec1, _), (ra2, dec2, id2) = plan["keys"]
        n, d = plan["n"], plan["distance"]
        o, p = part.tile
        _, decs = hp.boundaries(o, p)  # the extremes are in corners
        band = (pc.field(dec2) >= float(decs.min()) - d - 1e-6) & (pc.field(dec2) <= float(decs.max()) + d + 1e-6)
        second = opened(part.second).to_table(columns=list(dict.fromkeys([*plan["columns"][1], ra2, dec2, id2])), filter=band)
        if not second.num_rows:
            return
        position = lambda t, c: t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        rank = pc.rank(second.column(id2), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        zones = Zones(position(second, ra2), position(second, dec2), rank, d)
        shift = 2 * (ID_ORDER - o) + RANK_BITS
        own = None if part.whole else (pc.field("_ID") >= p << shift) & (pc.field("_ID") < (p + 1) << shift)
        columns = list(dict.fromkeys([*plan["columns"][0], ra1, dec1]))
        for batch in opened(part.first).to_batches(columns=columns, filter=own, batch_size=BATCH):
            if not batch.num_rows:
                continue
            one = pa.Table.from_batches([batch])
            for i, j, away in zones.nearest(position(one, ra1), position(one, dec1), n):
                if not len(i):
                    continue
                a, b = one.take(pa.array(i)), second.take(pa.array(j))
                found = [*[a.column(c) for c in plan["columns"][0]], *[b.column(c) for c in plan["columns"][1]], pa.repeat(pa.scalar(part.hips[0]), len(i)), pa.repeat(pa.scalar(part.hips[1]), len(i)), pa.array(away)]
                yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(found, wanted)], schema=wanted).combine_chunks().to_batches()


def local_match(spark: SparkSession, splits: list, columns: tuple[list[str], list[str]], keys: tuple, schema: StructType, n: int, distance: float) -> DataFrame:
    """The rows of ``schema``: both sides' columns, hips_k, hips_pix and _DIST. ``keys`` are each side's columns of position and id."""
    plan = {"splits": splits, "columns": columns, "keys": keys, "n": n, "distance": distance}
    spark.dataSource.register(LocalMatch)
    return spark.read.format("heliograph_match").option("plan", json.dumps(plan)).option("schema", schema.json()).load()
