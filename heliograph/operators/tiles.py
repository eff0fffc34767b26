"""Coverages: parts of the sky as disjoint ranges of pixels, with union, intersection and difference.

A coverage is a table (lo, hi) of half-open ranges of pixels of order 14, the pixels of spatial ids. In normal form no range crosses
a border of a pixel of order 5 (a chunk) and none touch each other within one, so equal parts of the sky are equal tables, and every
operation works on chunks apart: the positions in a chunk are summed before they are shuffled, and there are few of them however many
ranges or cones there were.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from heliograph.functions import healpix as hp
from heliograph.functions.geometry import gc_dist
from heliograph.operators.columns import quoted
from heliograph.operators.partitioning import ID_ORDER, RANK_BITS, small, with_pixel

CHUNK_ORDER = 5
#: Pixels of a chunk, as bits.
CHUNK_BITS = 2 * (ID_ORDER - CHUNK_ORDER)
#: Tiles that a worker seeks in step, by estimate.
STEP = 500_000
#: The coarsest cells in which rows and cones meet, and by how many orders the pixels that tell a cone's cells are finer than these.
COARSEST, FINER = 2, 2


def with_valid_cones(cones: DataFrame, ra: str, dec: str, radius: str) -> DataFrame:
    a, d, r = (F.col(quoted(c)).cast("double") for c in (ra, dec, radius))
    return cones.where((F.abs(a) < float("inf")) & d.between(-90, 90) & (r >= 0) & ~F.isnan(r))


def in_steps(radius: np.ndarray, deepest: np.ndarray) -> list[slice]:
    """Stretches of cones whose tiles are sought in step."""
    # the border of a disc crosses about so many pixels
    cost = 64 + 8 * np.sin(np.radians(np.minimum(radius, 90))) * 2.0**deepest
    step = (np.cumsum(cost) // STEP).astype(np.int64)
    return [slice(int(lo), int(hi)) for lo, hi in zip(*(np.searchsorted(step, np.unique(step), side=s) for s in ("left", "right")))]


def cone_tiles(cones: DataFrame, ra: str, dec: str, radius: str, order: int | None = None, inclusive: bool = False) -> DataFrame:
    """The rows, one a cone, with each tile (t_order, t_pix, t_inside) of its disc. Tiles go down to ``order``, or by default to pixels
    of about a third of the cone's radius. Cones with a null, NaN or negative radius, or no valid centre, have none."""
    if order is not None and not 0 <= order <= ID_ORDER:
        raise ValueError(f"order must be between 0 and {ID_ORDER}")
    cones = with_valid_cones(cones, ra, dec, radius)
    schema = StructType([*cones.schema.fields, StructField("t_order", IntegerType()), StructField("t_pix", LongType()), StructField("t_inside", BooleanType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, d, r = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (ra, dec, radius))
            deepest = hp.order_for(r) if order is None else np.full(len(r), order)
            for part in in_steps(r, deepest):
                who, o, pix, inside = hp.disc_tiles(a[part], d[part], r[part], deepest[part], inclusive)
                for k in range(0, len(who), STEP):
                    s = slice(k, k + STEP)
                    own = batch.take(pa.array(who[s] + part.start))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(o[s]), pa.array(pix[s]), pa.array(inside[s])], schema=pa.schema([*own.schema, ("t_order", pa.int32()), ("t_pix", pa.int64()), ("t_inside", pa.bool_())]))

    return cones.mapInArrow(run, schema)


def tile_ranges(tiles: DataFrame, order: str = "t_order", pix: str = "t_pix") -> DataFrame:
    """(lo, hi) of pixels of any orders up to 14, as they are: not in normal form."""
    at = lambda p: F.expr(f"shiftleft({p}, CAST(2 * ({ID_ORDER} - {order}) AS INT))")
    return tiles.select(at(f"CAST({pix} AS BIGINT)").alias("lo"), at(f"(CAST({pix} AS BIGINT) + 1)").alias("hi"))


def combined(coverages: list[DataFrame], rule: Callable[..., Column]) -> DataFrame:
    """Where ``rule`` of being in each of the coverages holds, in normal form. The coverages need not be; the rule must be false outside
    all of them."""
    names = [f"__d{k}" for k in range(len(coverages))]
    events = None
    for k, cov in enumerate(coverages):
        cut = cov.where("hi > lo").withColumn("__c", F.explode(F.expr(f"sequence(shiftright(lo, {CHUNK_BITS}), shiftright(hi - 1, {CHUNK_BITS}))")))
        ends = F.array(F.struct(F.expr(f"greatest(lo, shiftleft(__c, {CHUNK_BITS}))").alias("at"), F.lit(1).alias("d")), F.struct(F.expr(f"least(hi, shiftleft(__c + 1, {CHUNK_BITS}))").alias("at"), F.lit(-1).alias("d")))
        own = cut.select("__c", F.explode(ends).alias("__e")).select("__c", F.col("__e.at").alias("at"), *[(F.col("__e.d") if j == k else F.lit(0)).alias(n) for j, n in enumerate(names)])
        events = own if events is None else events.unionByName(own)
    by = Window.partitionBy("__c").orderBy("at")
    sums = events.groupBy("__c", "at").agg(*[F.sum(n).alias(n) for n in names])
    held = sums.select("__c", "at", rule(*[F.sum(n).over(by) > 0 for n in names]).alias("__in"))
    turns = held.withColumn("__was", F.lag("__in", 1, False).over(by)).where("__in <> __was")
    return turns.select("__in", F.col("at").alias("lo"), F.lead("at").over(by).alias("hi")).where("__in").select("lo", "hi")


def union(*coverages: DataFrame) -> DataFrame:
    """Also the normal form of one."""
    first, *more = coverages
    for c in more:
        first = first.select("lo", "hi").unionByName(c.select("lo", "hi"))
    return combined([first], lambda a: a)


def intersection(one: DataFrame, two: DataFrame) -> DataFrame:
    return combined([one, two], lambda a, b: a & b)


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    return combined([one, two], lambda a, b: a & ~b)


def tiles_of(coverage: DataFrame) -> DataFrame:
    """(Norder, Npix): the fewest pixels of orders 5 to 14 that make up a coverage in normal form."""
    levels = range(ID_ORDER - CHUNK_ORDER + 1)
    # at each level the whole pixels of a range; those in whole pixels of the next level belong to that one
    ends = {k: (f"shiftright(lo + {(1 << 2 * k) - 1}, {2 * k})", f"shiftright(hi, {2 * k})") for k in [*levels, len(levels)]}
    runs = []
    for k in levels:
        (a, b), (ua, ub) = ends[k], ends[k + 1]
        top = "false" if k == levels[-1] else f"{ua} < {ub}"
        before = f"named_struct('o', {ID_ORDER - k}, 'a', {a}, 'b', CASE WHEN {top} THEN 4 * {ua} ELSE {b} END)"
        runs += [before, f"named_struct('o', {ID_ORDER - k}, 'a', CASE WHEN {top} THEN 4 * {ub} ELSE {b} END, 'b', {b})"]
    rows = coverage.select(F.explode(F.expr(f"filter(array({', '.join(runs)}), r -> r.a < r.b)")).alias("r"))
    return rows.select(F.col("r.o").alias("Norder"), F.explode(F.expr("sequence(r.a, r.b - 1)")).alias("Npix"))


def area(coverage: DataFrame) -> DataFrame:
    """(area): square degrees."""
    return coverage.agg((F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)) * F.lit(hp.pixel_area(ID_ORDER))).alias("area"))


def with_tiles_above(df: DataFrame, orders: list[int], ra: str, dec: str) -> DataFrame:
    """Each row once for each of the orders, with its pixel (r_order, r_pix)."""
    rows = with_pixel(df, ID_ORDER, ra, dec, "__pix")
    rows = rows.select("*", F.explode(F.array(*[F.lit(int(o)) for o in orders])).alias("r_order"))
    return rows.withColumn("r_pix", F.expr(f"shiftright(__pix, 2 * ({ID_ORDER} - r_order))")).drop("__pix")


def rows_within(df: DataFrame, coverage: DataFrame, n_tiles: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """The rows in a coverage in normal form. Its ``n_tiles`` tiles are looked up by equal keys, and stay with the rows while they can be
    broadcast; tiles are disjoint, so a row meets one at most."""
    tiles = tiles_of(coverage).withColumnsRenamed({"Norder": "r_order", "Npix": "r_pix"})
    rows = with_tiles_above(df, list(range(CHUNK_ORDER, ID_ORDER + 1)), ra, dec)
    return rows.join(small(tiles, n_tiles), ["r_order", "r_pix"], "left_semi").select(*[F.col(quoted(c)) for c in df.columns])


def cone_cells(cones: DataFrame, orders: list[int], ra: str, dec: str, radius: str) -> DataFrame:
    """The rows, one a cone, with each cell (t_cell, see :func:`cell`) that its disc may touch. A cone's cells are of one order: the finest of ``orders``
    whose pixels are as wide as its radius, or else the coarsest. Cones without a valid centre or radius have none, as in :func:`cone_tiles`."""
    cones = with_valid_cones(cones, ra, dec, radius)
    schema = StructType([*cones.schema.fields, StructField("t_cell", LongType())])
    orders = np.array(sorted(orders), np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, d, r = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (ra, dec, radius))
            own = orders[np.maximum(np.searchsorted(orders, finest_as_wide(r), side="right") - 1, 0)]
            for s in in_steps(r, own + FINER):
                who, o, pix, _ = hp.disc_tiles(a[s], d[s], r[s], own[s] + FINER, inclusive=True)
                # what touches is told by finer pixels; wider ones inside the disc are all their pixels of the cone's order
                up = o.astype(np.int64) - own[s][who]
                n = 1 << 2 * np.maximum(-up, 0)
                first = np.where(up < 0, pix * n, pix >> 2 * np.maximum(up, 0))
                who, pix = np.repeat(who, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who, at = np.unique(np.stack([who, pix + (4 << 2 * own[s][who])]), axis=1)
                for k in range(0, len(who), STEP):
                    rows = batch.take(pa.array(who[k : k + STEP] + s.start))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at[k : k + STEP])], schema=pa.schema([*rows.schema, ("t_cell", pa.int64())]))

    return cones.mapInArrow(run, schema)


def cell(order: int, pix: str) -> Column:
    """One number for a pixel and its order, from the pixel of order 14 in it."""
    return F.expr(f"shiftright({pix}, {2 * (ID_ORDER - order)}) + CAST({4 << 2 * order} AS BIGINT)")


def rows_of_cones(df: DataFrame, cones: DataFrame, orders: list[int], ra: str, dec: str, cone_ra: str, cone_dec: str, radius: str) -> DataFrame:
    """Each row with each of the cones that it is in: nearer than the cone's radius; with _DIST. Names of the two sides must differ. Meeting
    is on equal cells about as wide as the cones, so that a row is shuffled once for each of the few ``orders`` of cells (:func:`tile_orders`), and a cone
    to the few cells it touches; cells of one order are disjoint, and the distance decides."""
    orders = sorted(orders) or [COARSEST]  # without orders there are no cones
    cells = cone_cells(cones, orders, cone_ra, cone_dec, radius)
    rows = with_pixel(df, ID_ORDER, ra, dec, "__pix")
    at = [cell(int(o), "__pix") for o in orders]
    rows = rows.withColumn("r_cell", F.explode(F.array(*at)) if len(at) > 1 else at[0]).drop("__pix")
    # neither side is broadcast: both are many times what they look like from the tables they are made from
    pairs = rows.join(cells.hint("merge"), F.col("r_cell") == F.col("t_cell"))
    pairs = pairs.withColumn("_DIST", gc_dist(quoted(ra), quoted(dec), quoted(cone_ra), quoted(cone_dec)))
    # the difference in declination is no more than the distance, and quickly told
    level = F.abs(F.col(quoted(dec)) - F.col(quoted(cone_dec))) <= F.col(quoted(radius)) + F.lit(1e-6)
    return pairs.where(level & (F.col("_DIST") < F.col(quoted(radius)))).drop("r_cell", "t_cell")


def tile_orders(cones: DataFrame, radius: str) -> list[int]:
    """The orders of cells for these cones: from pixels about as wide as the widest cone's radius, by twos, to those as wide as the narrowest's.
    Wide cones have cells of order 2, so that their rows still go to many tasks."""
    least, most = cones.where((F.col(quoted(radius)) >= 0) & ~F.isnan(F.col(quoted(radius)).cast("double"))).agg(F.min(quoted(radius)), F.max(quoted(radius))).first()
    if most is None:
        return []
    nearest = next((o for o in range(COARSEST, ID_ORDER) if hp.resolution(o) <= float(most) * 2**0.5), ID_ORDER)
    return list(range(nearest, max(nearest, int(finest_as_wide(float(least)))) + 1, 2))


def finest_as_wide(radius) -> np.ndarray:
    """The finest order, 14 at most, whose pixels are as wide as the radius; 0 if none are."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log2(hp.resolution(0) / np.asarray(radius, float))), 0, ID_ORDER).astype(np.int64)


#: Ranges of a filter on spatial ids at most; more are joined across the narrowest gaps.
RANGES = 64


def id_ranges(ra: float, dec: float, radius: float) -> list[tuple[int, int]]:
    """Half-open ranges of spatial ids that hold all rows of a cone."""
    if not radius >= 0:
        return []
    one = lambda v: np.array([v], float)
    _, o, pix, _ = hp.disc_tiles(one(ra), one(dec), one(radius), hp.order_for([radius]), inclusive=True)
    shift = 2 * (ID_ORDER - o.astype(np.int64)) + RANK_BITS
    lo, hi = (np.sort(v << shift) for v in (pix, pix + 1))
    gaps = lo[1:] - hi[:-1]
    cut = np.flatnonzero(gaps > 0)
    if len(cut) >= RANGES:
        cut = np.sort(cut[np.argsort(gaps[cut])[-(RANGES - 1) :]])
    return list(zip(lo[np.r_[0, cut + 1]].tolist(), hi[np.r_[cut, len(hi) - 1]].tolist())) if len(lo) else []


def id_filter(ranges: list[tuple[int, int]], key: str = "_ID") -> Column:
    """A filter that is pushed to the scan, where row groups and pages of files in the order of ids are skipped by it."""
    cond = F.lit(False)
    for lo, hi in ranges:
        cond = cond | ((F.col(key) >= lo) & (F.col(key) < hi))
    return cond
