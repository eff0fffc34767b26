"""k nearest neighbours within a distance, as an equi-join on cells of declination zones.

The sky is cut into zones of two to four distances, and each zone into bins of right ascension that are at least as wide
as two points so far apart as a zone is high can be there. Rows of one side have one cell, rows of the other are copied to the
cells that their circle of reach can touch, so every pair in reach meets in exactly one cell. Ranks are by great-circle distance, ties by the second
side's id.

Where far more rows are in reach than neighbours are wanted, each row of the first side gets a radius of its own: a pixel with ``n`` rows of the
second side has ``n`` neighbours of all that is in it no farther than it is wide. Rows of one radius are matched by cells of its size, so the pairs
that are compared grow with the rows, not with the distance.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.functions.geometry import gc_dist
from heliograph.functions.stages import apply
from heliograph.operators import partitioning as pt
from heliograph.operators.columns import quoted

#: Degrees that a zone is high at least.
LEAST_HEIGHT = 1e-3
#: More than the bins of any zone.
BINS = 1 << 22


def zone_height(distance: float) -> float:
    return min(180.0, max(LEAST_HEIGHT, distance * 1.000001 + 1e-9))


def n_zones(height: float) -> int:
    return math.ceil(180.0 / height)


def bin_stages(height: float, zone: str, ra: str, p: str) -> list[dict[str, str]]:
    """``{p}n`` and ``{p}b``: a zone's number of bins, and the bin of a right ascension."""
    h = f"CAST('{height!r}' AS DOUBLE)"
    edge = f"least(90e0, greatest(abs({zone} * {h} - 90e0), abs(({zone} + 1) * {h} - 90e0)))"
    return [
        {f"{p}e": edge},
        {f"{p}w": f"CASE WHEN {p}e + {h} >= 89.999e0 THEN 360e0 ELSE degrees(asin(sin(radians({h})) / cos(radians({p}e)))) * 1.000001e0 END"},
        {f"{p}n": f"CASE WHEN {p}w > 120e0 THEN CAST(1 AS BIGINT) ELSE CAST(floor(360e0 / {p}w) AS BIGINT) END"},
        {f"{p}b": f"least({p}n - 1, CAST(floor(((({ra} % 360e0) + 360e0) % 360e0) / 360e0 * {p}n) AS BIGINT))"},
    ]


def zone_sql(height: float, dec: str) -> str:
    return f"least(CAST({n_zones(height) - 1} AS BIGINT), CAST(floor(({dec} + 90e0) / CAST('{height!r}' AS DOUBLE)) AS BIGINT))"


def with_cell(df: DataFrame, height: float, ra: str, dec: str, cell: str = "__cell") -> DataFrame:
    stages = [{"__z": zone_sql(height, quoted(dec))}, *bin_stages(height, "__z", quoted(ra), "__z"), {cell: f"__z * {BINS} + __zb"}]
    return apply(df, stages, [cell])


def with_cells_in_reach(df: DataFrame, height: float, distance: float, ra: str, dec: str, cell: str = "__cell") -> DataFrame:
    """Each row once for each cell that may hold rows within the distance. Cells are higher and wider than twice the distance, so most
    rows have one, and those near a border two or four."""
    own = [F.col(quoted(c)) for c in df.columns]
    d = F.lit(float(distance) * 1.000001 + 1e-9)
    last = F.lit(n_zones(height) - 1).cast("bigint")
    zone = lambda dec_: F.least(last, F.floor((dec_ + 90.0) / F.lit(height)).cast("bigint"))
    low, high = zone(F.greatest(F.lit(-90.0), F.col(quoted(dec)) - d)), zone(F.least(F.lit(90.0), F.col(quoted(dec)) + d))
    rows = df.select(*own, F.explode(F.sequence(low, high)).alias("__z"))
    rows = apply(rows, bin_stages(height, "__z", quoted(ra), "__z"), ["__zn", "__zb"])
    # the widest that a point in reach can be apart in right ascension: at the farthest declination that both can have
    far = F.abs(F.col(quoted(dec))) + d
    reach = F.when(far >= 89.999, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(d)) / F.cos(F.radians(F.col(quoted(dec))))))) * 1.000001 + 1e-9)
    turn = F.pmod(F.col(quoted(ra)), F.lit(360.0))
    place = lambda a: F.floor(a / 360.0 * F.col("__zn")).cast("bigint")
    first, stop = place(turn - reach), place(turn + reach)
    bins = F.when((F.col("__zn") == 1) | (stop - first + 1 >= F.col("__zn")), F.sequence(F.lit(0).cast("bigint"), F.col("__zn") - 1)).otherwise(F.transform(F.sequence(first, stop), lambda b: F.pmod(b, F.col("__zn"))))
    return rows.select(*own, "__z", F.explode(bins).alias("__k")).select(*own, (F.col("__z") * BINS + F.col("__k")).alias(cell))


#: Heights of a cell in distances, at most and least: higher ones copy fewer rows (2.25 and 4 times) and compare more pairs.
CELL, LEAST_CELL = 4.0, 2.0
#: Rows of the first side in a square of the distance from which on comparing costs more than copying.
CROWDED = 25.0


def cell_height(distance: float, density: float | None = None) -> float:
    """Degrees that cells are high, for so many rows of the first side a square degree (where they are; unknown: few)."""
    crowded = density is not None and density * distance * distance > CROWDED
    return zone_height(distance * (LEAST_CELL if crowded else CELL))


#: Rows in reach, for each neighbour that is wanted, up to which all are compared.
IN_REACH = 32
#: Orders between the levels of radii, from the deepest on.
LEVELS = (0, 1, 2, 4, 6, 8, 10, 12, 14)


def levels_of(one: DataFrame, two: DataFrame, n: int, distance: float, at1: tuple[str, str], at2: tuple[str, str]) -> tuple[DataFrame, dict[int, int], int] | None:
    """(pix, level) of the pixels of the deepest order with rows of ``one``, how many of its rows each level has, and that order; or None where
    few rows are in reach. A level is the deepest order whose pixel there has ``n`` rows of ``two``, -1 where there is none."""
    wide = next((o for o in range(pt.ID_ORDER) if hp.resolution(o) <= 2 * distance), pt.ID_ORDER)  # about as much as is in reach
    total, squares = pt.density(two, wide, *at2).agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    if not total or squares / total <= IN_REACH * n:
        return None
    deepest = min(pt.ID_ORDER, wide + math.ceil(math.log(squares / total / n, 4)))
    orders = [o for o in (deepest - k for k in LEVELS) if o >= 0 and radius_of(o) < distance]
    if not orders:
        return None
    up = lambda df, *own: df.select(F.explode(F.array(*map(F.lit, orders))).alias("__o"), "pix", *own).withColumn("__q", F.expr(f"shiftright(pix, 2 * ({deepest} - __o))"))
    full = up(pt.density(two, deepest, *at2), "n").groupBy("__o", "__q").agg(F.sum("n").alias("n")).where(F.col("n") >= n).select("__o", "__q")
    own = pt.density(one, deepest, *at1)
    best = up(own).join(full.hint("merge"), ["__o", "__q"], "left_semi").groupBy("pix").agg(F.max("__o").alias("level"))
    levels = own.join(best.hint("merge"), "pix", "left").select("pix", F.coalesce("level", F.lit(-1)).alias("level"), "n")
    rows = {r.level: r.n for r in levels.groupBy("level").agg(F.sum("n").alias("n")).collect()}  # a row a level
    return (levels.select("pix", "level"), rows, deepest) if rows else None


def radius_of(order: int) -> float:
    """Degrees that no two points of a pixel are apart."""
    return 2 * hp.reach(order)


def cross_match(one: DataFrame, two: DataFrame, n: int, distance: float, key: str, other_key: str, pair_condition=None, coords=(("ra1", "dec1"), ("ra2", "dec2")), same=(), density: float | None = None) -> DataFrame:
    """For each row of ``one`` its ``n`` nearest of ``two`` nearer than ``distance``, with _DIST. ``key`` is unique in
    ``one``; ``other_key`` settles ties. Column names of the sides must differ. ``same`` names pairs of columns that
    must be equal, too. ``density`` is about how many rows of ``one`` a square degree has, if known."""
    if n < 1:
        raise ValueError("n_neighbors must be 1 or more")
    (ra1, dec1), (ra2, dec2) = coords
    levels = None if same or pair_condition is not None else levels_of(one, two, n, distance, coords[0], coords[1])
    if levels is None:
        pairs = pairs_in_reach(one, two, cell_height(distance, density), distance, coords, same)
    else:
        found, rows, deepest = levels
        levelled = pt.with_pixel(one, deepest, ra1, dec1, "__pix1").join(found.withColumnRenamed("pix", "__pix1").hint("merge"), "__pix1")
        pairs = None
        for level, n_rows in sorted(rows.items()):
            own = levelled.where(F.col("level") == level).select(*[F.col(quoted(c)) for c in one.columns])
            radius = distance if level < 0 else radius_of(level)
            some = pairs_in_reach(own, two, cell_height(radius), radius, coords, (), n_rows)
            pairs = some if pairs is None else pairs.unionByName(some)
    if pair_condition is not None:
        pairs = pairs.where(pair_condition)
    by = Window.partitionBy(key).orderBy("_DIST", other_key)
    return pairs.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= n).drop("__rank")


def pairs_in_reach(one: DataFrame, two: DataFrame, height: float, distance: float, coords, same=(), n_rows: int | None = None) -> DataFrame:
    """All pairs nearer than the distance, with _DIST. The copies of the second side are never broadcast, as they are more than they look;
    ``n_rows`` of the first side are, if known to be few."""
    (ra1, dec1), (ra2, dec2) = coords
    left = with_cell(one, height, ra1, dec1).withColumnRenamed("__cell", "__cell1")
    on = F.col("__cell1") == F.col("__cell")
    for a, b in same:
        on = on & (F.col(a) == F.col(b))
    right = with_cells_in_reach(two, height, distance, ra2, dec2)
    left, right = (F.broadcast(left), right) if n_rows is not None and n_rows <= pt.BROADCAST_ROWS else (left, right.hint("merge"))
    pairs = left.join(right, on).drop("__cell", "__cell1")
    return pairs.withColumn("_DIST", gc_dist(quoted(ra1), quoted(dec1), quoted(ra2), quoted(dec2))).where(F.col("_DIST") < distance)
