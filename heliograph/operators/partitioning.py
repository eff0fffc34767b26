"""Density maps, the adaptive partition map, and rows' partitions and spatial ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.functions.stages import apply
from heliograph.operators.columns import quoted

#: Rows of a partition or cell table up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
ID_ORDER, RANK_BITS = 14, 31
#: Rows that one task ranks at most, if the threshold is no higher, and about how many ranges there are of fewer rows.
RANGE_ROWS, RANGES = 1_000_000, 256


class BadCoordinates(ValueError):
    pass


def valid_coordinates(ra: str, dec: str):
    a, d = F.col(quoted(ra)), F.col(quoted(dec))
    return a.isNotNull() & d.isNotNull() & ~F.isnan(a.cast("double")) & ~F.isnan(d.cast("double")) & d.between(-90, 90) & (F.abs(a) < float("inf"))


def checked(df: DataFrame, ra: str, dec: str, on_bad: str = "fail") -> DataFrame:
    """Rows with valid coordinates; bad ones are counted and rejected, or dropped. They are counted by an aggregate: a filter would go below
    the projection that coordinates are made in and make them anew for each of its conditions, in this pass and all later ones."""
    if on_bad not in ("fail", "drop"):
        raise ValueError("on_bad is 'fail' or 'drop'")
    good = F.coalesce(valid_coordinates(ra, dec), F.lit(False))
    if on_bad == "drop":
        return df.where(good)
    if n := df.agg(F.count_if(~good)).first()[0]:
        raise BadCoordinates(f"{n} rows have null, NaN or impossible coordinates")
    return df


def with_pixel(df: DataFrame, order: int, ra: str, dec: str, out: str = "pix") -> DataFrame:
    return apply(df, hp.ang2pix_stages(order, f"CAST({quoted(ra)} AS DOUBLE)", f"CAST({quoted(dec)} AS DOUBLE)", out), [out])


def density(df: DataFrame, order: int, ra: str, dec: str) -> DataFrame:
    """(pix, n) of the pixels with rows."""
    return with_pixel(df.select(quoted(ra), quoted(dec)), order, ra, dec).groupBy("pix").agg(F.count("*").alias("n"))


def rebinned(dens: DataFrame, order: int, coarser: int) -> DataFrame:
    if coarser > order:
        raise ValueError("a density map can only be made coarser")
    return dens.groupBy(F.shiftright("pix", 2 * (order - coarser)).alias("pix")).agg(F.sum("n").alias("n"))


def partition_map(dens: DataFrame, order: int, threshold: int, allow_overflow: bool = False) -> DataFrame:
    """(Norder, Npix, n): the coarsest pixels with fewer rows than the threshold that cover all rows. Counts never grow
    with the order, so a pixel is stored if it is below the threshold and its parent is not."""
    if not allow_overflow and (n := dens.where(F.col("n") >= threshold).count()):
        raise ValueError(f"{n} pixels of order {order} have {threshold} rows or more; take a higher order or threshold")
    up = dens.select(F.explode(F.sequence(F.lit(0), F.lit(order))).alias("Norder"), "pix", "n")
    up = up.groupBy("Norder", F.expr(f"shiftright(pix, 2 * ({order} - Norder))").alias("Npix")).agg(F.sum("n").alias("n"))
    low = (F.col("n") < threshold) | (F.lit(allow_overflow) & (F.col("Norder") == order))
    full = up.where(F.col("n") >= threshold).select((F.col("Norder") + 1).alias("Norder"), F.col("Npix").alias("parent"))
    stored = up.where(low).withColumn("parent", F.shiftright("Npix", 2)).join(full, ["Norder", "parent"], "left_semi").select("Norder", "Npix", "n")
    return up.where(low & (F.col("Norder") == 0)).select("Norder", "Npix", "n").unionByName(stored)


def cell_partitions(dens: DataFrame, parts: DataFrame, order: int) -> DataFrame:
    """(pix, Norder, Npix) of each pixel of the density map."""
    cells = dens.select("pix", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("Norder")).withColumn("Npix", F.expr(f"shiftright(pix, 2 * ({order} - Norder))"))
    return cells.join(parts.select("Norder", "Npix"), ["Norder", "Npix"]).select("pix", "Norder", "Npix")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows for a join: broadcast, or never, as what it is made from may look smaller than it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def assigned(df: DataFrame, cells: DataFrame, n_cells: int, order: int, ra: str, dec: str) -> DataFrame:
    """Rows with the Norder, Npix and Dir of their partition."""
    rows = with_pixel(df, order, ra, dec, "__pix")
    found = rows.join(small(cells.withColumnRenamed("pix", "__pix"), n_cells), "__pix").drop("__pix")
    return found.withColumn("Npix", F.col("Npix").cast("int")).withColumn("Dir", (F.floor(F.col("Npix") / 10000) * 10000).cast("int"))


def in_partitions(df: DataFrame, parts: DataFrame, n_parts: int, orders: list[int], order: int, ra: str, dec: str, keep_all: bool = False) -> DataFrame:
    """Rows with the Norder, Npix and Dir of their partition. Partitions do not overlap, so a row's ancestors are looked up in the
    map, one order after the other; the rows stay where they are while the map can be broadcast. Rows in none are left out, or
    with ``keep_all`` have nulls."""
    return looked_up(with_pixel(df, order, ra, dec, "__pix"), parts, n_parts, orders, order, keep_all)


def looked_up(rows: DataFrame, parts: DataFrame, n_parts: int, orders: list[int], order: int, keep_all: bool = False) -> DataFrame:
    """:func:`in_partitions` for rows with their pixel of the order, ``__pix``."""
    found = []
    for o in orders:
        own = parts.where(F.col("Norder") == o).select(F.col("Npix").cast("bigint").alias(f"__npix{o}"))
        rows = rows.join(small(own, n_parts), F.expr(f"shiftright(__pix, {2 * (order - o)})") == F.col(f"__npix{o}"), "left")
        found.append(f"__npix{o}")
    where = F.coalesce(*[F.when(F.col(c).isNotNull(), o) for c, o in zip(found, orders)]) if orders else F.lit(None)
    pix = F.coalesce(*[F.col(c) for c in found]) if orders else F.lit(None)
    rows = rows.withColumns({"Norder": where.cast("int"), "Npix": pix.cast("int")})
    rows = rows if keep_all else rows.where("Norder IS NOT NULL")
    return rows.drop("__pix", *found).withColumn("Dir", (F.floor(F.col("Npix") / 10000) * 10000).cast("int"))


def with_spatial_id(df: DataFrame, ra: str, dec: str, tie: str | None = None, out: str = "_ID", within: list[str] | None = None) -> DataFrame:
    """A unique id in NEST order: the order-14 pixel, then the rank in it by (ra, dec, tie). ``within`` names columns that
    all rows of a pixel share; the rows are then dealt by these, which serves a layout by them too."""
    by = Window.partitionBy(*(within or []), "__p").orderBy(F.col(quoted(ra)), F.col(quoted(dec)), *([F.col(quoted(tie))] if tie else []))
    rows = with_pixel(df, ID_ORDER, ra, dec, "__p")
    rows = (rows.repartition(*within) if within else rows).withColumn("__r", F.row_number().over(by).cast("bigint") - 1)
    return rows.withColumn(out, F.shiftleft("__p", RANK_BITS).bitwiseOR(F.col("__r"))).drop("__p", "__r")


def pixel_of_id(key: str, order: int) -> Column:
    """The pixel in a spatial id, of order 14 or a coarser one."""
    return F.shiftright(key, RANK_BITS + 2 * (ID_ORDER - order))


def range_rows(n_rows: int, threshold: int) -> int:
    """Rows of a range: the threshold's, more where the ranges of so many rows would be too many, but no more than a task can rank."""
    return max(threshold, min(RANGE_ROWS, n_rows // RANGES))


def crowded_ids(rows: DataFrame, n_rows: int, block_rows: int, ra: str, dec: str, stage, tie: str | None = None, out: str = "_ID") -> tuple[DataFrame, int]:
    """The ids of :func:`with_spatial_id` for rows of which any number may share a pixel, a position or all values: the rows are sorted
    into ranges of about ``block_rows``, ranked in each, and ranks go on from the ranges before. ``stage`` writes a table and reads it
    again; a row's place in the first one's files is the last key, so repeated rows part too. Returns the rows, dealt by ranges, and
    the number of these."""
    blocks = max(1, -(-n_rows // block_rows))
    fixed = stage(with_pixel(rows, ID_ORDER, ra, dec, "__p"), "crowded")
    place = fixed.metadataColumn("_metadata")
    fixed = fixed.withColumns({"__file": place["file_name"], "__row": place["row_index"]})
    by = [F.col(c) for c in ("__p", quoted(ra), quoted(dec), *([quoted(tie)] if tie else []), "__file", "__row")]
    ranges = stage(fixed.repartitionByRange(blocks, *by).withColumn("__block", F.spark_partition_id()), "ranges")
    # a pixel of several ranges is the first of each but one, so there are no more offsets than ranges
    earlier = Window.partitionBy("__p").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("__block", "__p").count().withColumn("__offset", F.sum("count").over(earlier)).where("__offset IS NOT NULL").drop("count")
    rank = F.row_number().over(Window.partitionBy("__block", "__p").orderBy(*by[1:])).cast("bigint") - 1
    ranked = ranges.repartition(blocks, "__block").withColumn("__r", rank).join(small(offsets, blocks), ["__block", "__p"], "left")
    ids = F.shiftleft("__p", RANK_BITS).bitwiseOR(F.col("__r") + F.coalesce("__offset", F.lit(0)))
    return ranked.withColumn(out, ids).drop("__p", "__r", "__offset", "__block", "__file", "__row"), blocks


def sort_key(order: str = "Norder", pix: str = "Npix"):
    """Pixels of all orders in NEST order."""
    return F.expr(f"shiftleft(CAST({pix} AS BIGINT), 2 * (20 - {order}))")


def partition_pairs(one: DataFrame, other: DataFrame, deepest: int = 20) -> DataFrame:
    """Pairs of partitions of which one contains the other, with the finer of the two (the first if equal). Each side is
    joined by its ancestors, so the join is on equal keys."""
    a = one.select(F.col("Norder").alias("o1"), F.col("Npix").cast("bigint").alias("p1"))
    b = other.select(F.col("Norder").alias("o2"), F.col("Npix").cast("bigint").alias("p2"))
    up = lambda df, o, p: df.select("*", F.explode(F.sequence(F.lit(0), F.col(o))).alias("ao")).withColumn("ap", F.expr(f"shiftright({p}, 2 * ({o} - ao))"))
    inside = up(a, "o1", "p1").join(b, (F.col("ao") == F.col("o2")) & (F.col("ap") == F.col("p2")))
    around = up(b, "o2", "p2").where("ao < o2").join(a, (F.col("ao") == F.col("o1")) & (F.col("ap") == F.col("p1")))
    finer = F.col("o2") > F.col("o1")
    pairs = inside.select("o1", "p1", "o2", "p2").unionByName(around.select("o1", "p1", "o2", "p2"))
    return pairs.withColumn("hips_k", F.when(finer, F.col("o2")).otherwise(F.col("o1"))).withColumn("hips_pix", F.when(finer, F.col("p2")).otherwise(F.col("p1")))
