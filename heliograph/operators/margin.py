"""Margin rows: rows outside a partition whose distance from its border is the margin at most.

Tiles near a border name the partitions that their rows may be in the margin of, so rows meet these on equal tiles. A task then measures
each such pair: the border is halved where it may come within the margin, by the greatest distance that a stretch can have from its middle,
and stretches as short as a fifth of the margin are narrowed by golden sections until the distance is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from heliograph.functions import healpix as hp
from heliograph.operators.columns import quoted
from heliograph.operators.partitioning import ID_ORDER, small, with_pixel

#: Orders that a partition's tiles are deeper than itself at most, and pairs that are measured in step.
DEEPER, STEP = 5, 100_000
#: No edge's points are farther apart than so many degrees an edge of order 0 (87.1 by sampling).
SPEED = 90.0


def steps_of(order: int, margin: float) -> int:
    """Points an edge."""
    return max(4, math.ceil(2 * hp.reach(order) / (margin / 5)))


def border_at(order: int, pix: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the border is at ``u`` edges from the northern corner by west, south and east."""
    x, y, f = hp.pix2xyf(order, pix)
    side, t = np.floor(u).astype(np.int64) % 4, u - np.floor(u)
    return hp.xyf2ang(order, x + np.choose(side, [1 - t, 0 * t, t, 0 * t + 1]), y + np.choose(side, [0 * t + 1, 1 - t, 0 * t, t]), f)


def degrees_apart(ra1, dec1, ra2, dec2) -> np.ndarray:
    a1, d1, a2, d2 = map(np.radians, (ra1, dec1, ra2, dec2))
    h = np.sin((d1 - d2) / 2) ** 2 + np.cos(d1) * np.cos(d2) * np.sin((a1 - a2) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1.0, h))))


def least_distance(order: int, pix: np.ndarray, ra: np.ndarray, dec: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance of each position from the stretch ``low .. high`` of a pixel's border, which has one minimum."""
    golden = (math.sqrt(5) - 1) / 2
    away = lambda u: degrees_apart(ra, dec, *border_at(order, pix, u))
    a, b = high - golden * (high - low), low + golden * (high - low)
    da, db = away(a), away(b)
    least = np.minimum(away(low), away(high))
    for _ in range(50):
        left = da < db
        low, high = np.where(left, low, a), np.where(left, b, high)
        a, b = high - golden * (high - low), low + golden * (high - low)
        da, db = np.where(left, away(a), db), np.where(left, da, away(b))
        least = np.minimum(least, np.minimum(da, db))
    return least


def stretches(order: int, margin: float) -> int:
    """Stretches of an edge, a power of 2, that are no longer than a fifth of the margin."""
    return 1 << max(1, math.ceil(math.log2(steps_of(order, margin))))


def near_border(order: int, pix: np.ndarray, ra: np.ndarray, dec: np.ndarray, margin: float) -> np.ndarray:
    """Which positions are within the margin of the border of the pixel beside them."""
    found = np.zeros(len(pix), bool)
    n, parts = stretches(order, margin), 2  # of an edge
    who, at = np.repeat(np.arange(len(pix)), 8), np.tile(np.arange(8) / 2, len(pix))
    while True:
        # no point of a stretch is farther from its middle than half of what an edge can be long
        half, span = 1 / (2 * parts), SPEED / (1 << order) / (2 * parts)
        away = degrees_apart(ra[who], dec[who], *border_at(order, pix[who], at + half))
        found[who[away <= margin]] = True
        on = ~found[who] & (away <= margin + span)
        who, at = who[on], at[on]
        if parts >= n or not len(who):
            break
        parts *= 2
        who, at = np.repeat(who, 2), (at[:, None] + np.array([0, half])).ravel()
    if len(who):
        found[who[least_distance(order, pix[who], ra[who], dec[who], at, at + 1 / parts) <= margin]] = True
    return found


def tile_order(order: int, margin: float) -> int:
    """The order of the tiles about a partition of an order: about the margin wide."""
    fits = next((o for o in range(ID_ORDER + 1) if hp.resolution(o) <= 1.2 * margin), ID_ORDER)
    return min(fits, order + DEEPER)


def border_tiles(order: int, pix: int, margin: float) -> np.ndarray:
    """The tiles that may hold rows outside a pixel within the margin of its border (a superset)."""
    deep = tile_order(order, margin)
    steps = max(4, math.ceil(2 * hp.reach(order) / hp.reach(deep)))
    edge, half = hp.ang2vec(*hp.boundaries(order, pix, steps)), hp.reach(order) / steps
    tiles = np.arange(12)
    for o in range(deep + 1):
        centres = hp.ang2vec(*hp.pix2ang(o, tiles))
        reach = margin + hp.reach(o) + half
        least = np.concatenate([np.linalg.norm(centres[k : k + 256, None] - edge, axis=-1).min(1) for k in range(0, len(tiles), 256)])
        tiles = tiles[np.degrees(2 * np.arcsin(np.minimum(1, least / 2))) <= reach * 1.0001 + 1e-9]
        if o < deep:
            tiles = (tiles[:, None] * 4 + np.arange(4)).ravel()
    return tiles[tiles >> 2 * (deep - order) != pix] if deep >= order else tiles


def tiles_of_margins(parts: DataFrame, n_parts: int, margin: float) -> DataFrame:
    """(__to, __tp, __near): each tile near a border with the partitions (__mo, __mp) whose margin it may hold rows of."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for o, p in zip(batch.column("Norder").to_pylist(), batch.column("Npix").to_pylist()):
                tiles = border_tiles(o, p, margin)
                fill = lambda v, t: pa.array(np.full(len(tiles), v), t)
                yield pa.RecordBatch.from_arrays([fill(tile_order(o, margin), pa.int32()), pa.array(tiles, pa.int64()), fill(o, pa.int32()), fill(p, pa.int64())], names=["__to", "__tp", "__mo", "__mp"])

    dealt = parts.select(F.col("Norder").cast("int").alias("Norder"), F.col("Npix").cast("bigint").alias("Npix")).repartition(max(1, min(200, n_parts // 32)), "Norder", "Npix")
    tiles = dealt.mapInArrow(run, "__to int, __tp bigint, __mo int, __mp bigint")
    return tiles.groupBy("__to", "__tp").agg(F.collect_list(F.struct("__mo", "__mp")).alias("__near"))


def within(pairs: DataFrame, margin: float) -> DataFrame:
    """The rows (with __ra, __dec, their partition and __near), once for each of the other partitions of __near that they are within the margin
    of, which Norder, Npix and Dir then name."""
    hidden = ("__ra", "__dec", "__near")
    renamed = ("Norder", "Npix", "Dir")
    own = [f for f in pairs.schema.fields if f.name not in (*hidden, *renamed)]
    schema = StructType([*own, StructField("Norder", IntegerType()), StructField("Npix", LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for first in range(0, whole.num_rows, 10_000):
                batch = whole.slice(first, 10_000)
                column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
                near = batch.column("__near")
                who = np.repeat(np.arange(batch.num_rows), near.value_lengths().to_numpy(zero_copy_only=False))
                flat = near.flatten()
                order, pix = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__mo", "__mp"))
                other = (order != column("Norder")[who]) | (pix != column("Npix")[who])
                who, order, pix = who[other], order[other], pix[other]
                a, d = column("__ra"), column("__dec")
                keep = np.zeros(len(who), bool)
                for o in np.unique(order).tolist():
                    some = np.flatnonzero(order == o)
                    for k in range(0, len(some), STEP):
                        w = some[k : k + STEP]
                        keep[w] = near_border(o, pix[w], a[who[w]], d[who[w]], margin)
                rows = batch.select([f.name for f in own]).take(pa.array(who[keep]))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(order[keep].astype(np.int32)), pa.array(pix[keep])], names=[f.name for f in schema])

    return pairs.mapInArrow(run, schema)


def margin_rows(rows: DataFrame, parts: DataFrame, orders: list[int], margin: float, ra: str, dec: str, stage) -> DataFrame:
    """Rows (with Norder and Npix of their own partition, and their spatial id) as many times as there are other partitions within
    the margin; Norder, Npix and Dir then name that partition. Rows stay where they are while the table of tiles can be broadcast; else
    both go by tiles, once. The table grows with the partitions' borders."""
    if margin <= 0:
        raise ValueError("the margin must be positive")
    tiles = stage(tiles_of_margins(parts, parts.count(), margin), "tiles")
    n_tiles = tiles.count()
    placed = with_pixel(rows.withColumns({"__ra": F.col(quoted(ra)).cast("double"), "__dec": F.col(quoted(dec)).cast("double")}), ID_ORDER, "__ra", "__dec", "__pix")
    deep = sorted({tile_order(o, margin) for o in orders})
    placed = placed.withColumn("__o", F.explode(F.array(*[F.lit(o) for o in deep]))) if len(deep) > 1 else placed.withColumn("__o", F.lit(deep[0]))
    at = F.expr(f"shiftright(__pix, 2 * ({ID_ORDER} - __o))")
    pairs = placed.withColumn("__p", at).join(small(tiles, n_tiles), (F.col("__o") == F.col("__to")) & (F.col("__p") == F.col("__tp")))
    out = within(pairs.drop("__pix", "__o", "__p", "__to", "__tp"), margin)
    return out.withColumn("Npix", F.col("Npix").cast("int")).withColumn("Dir", (F.floor(F.col("Npix") / 10000) * 10000).cast("int"))
