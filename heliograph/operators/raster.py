"""Maps of the whole sky as rasters in Mollweide's projection: a row a point of the image (i from the left, j from the top), with right
ascension 0 in the middle and growing to the left. Points outside the ellipse have no row.

The projection is inverted in closed form for the image's points, so a map of any order is looked up by equal pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.functions.geometry import gc_dist
from heliograph.functions.stages import Stage, apply
from heliograph.operators.partitioning import in_partitions, with_pixel


def mollweide_stages(width: int, height: int, ra: str = "ra", dec: str = "dec", p: str = "mo") -> list[Stage]:
    """The position of the image's point (i, j); ``{p}_in``: the point is on the sky."""
    return [
        {f"{p}_x": f"(2 * i + 1) / {width}e0 - 1e0", f"{p}_y": f"1e0 - (2 * j + 1) / {height}e0"},
        {f"{p}_in": f"{p}_x * {p}_x + {p}_y * {p}_y <= 1e0", f"{p}_t": f"asin({p}_y)", f"{p}_c": f"sqrt(1e0 - {p}_y * {p}_y)"},
        {ra: f"CASE WHEN {p}_in THEN (360e0 - 180e0 * {p}_x / {p}_c) % 360e0 END", dec: f"CASE WHEN {p}_in THEN degrees(asin(greatest(-1e0, least(1e0, (2e0 * {p}_t + sin(2e0 * {p}_t)) / pi())))) END"},
    ]


def points(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(i, j, ra, dec) of the image's points on the sky."""
    if width < 1 or height < 1:
        raise ValueError("an image has a point at least")
    rows = spark.range(width * height).select(F.expr(f"id % {width}").alias("i"), F.expr(f"CAST(floor(id / {width}) AS BIGINT)").alias("j"))
    return apply(rows, mollweide_stages(width, height), ["ra", "dec"]).where("ra IS NOT NULL")


def density_raster(dens: DataFrame, order: int, width: int, height: int) -> DataFrame:
    """(i, j, value): log10(n + 1) of the pixel of the density map that each point is in."""
    at = with_pixel(points(dens.sparkSession, width, height), order, "ra", "dec")
    return at.join(dens.select("pix", "n"), "pix", "left").select("i", "j", F.log10(F.coalesce("n", F.lit(0)) + 1).alias("value"))


def partition_raster(parts: DataFrame, n_parts: int, orders: list[int], width: int, height: int) -> DataFrame:
    """(i, j, value): the order of the partition that each point is in, -1 in none."""
    found = in_partitions(points(parts.sparkSession, width, height), parts, n_parts, orders, max(orders, default=0), "ra", "dec", keep_all=True)
    return found.select("i", "j", F.coalesce("Norder", F.lit(-1)).alias("value"))


def cone_raster(dens: DataFrame, order: int, ra: float, dec: float, radius: float, width: int, height: int) -> DataFrame:
    """(i, j, value, in_cone): as :func:`density_raster`, with the pixels whose centres are in the cone at the map's largest value and one
    more, so that the cone stands out."""
    at = with_pixel(points(dens.sparkSession, width, height), order, "ra", "dec")
    at = apply(at, hp.pix2ang_stages(order, "pix", "__ra", "__dec"), ["__ra", "__dec"]).withColumn("in_cone", gc_dist("__ra", "__dec", ra, dec) <= radius)
    most = dens.agg((F.log10(F.coalesce(F.max("n"), F.lit(0)) + 1) + 1).alias("__most"))  # one row
    value = F.when(F.col("in_cone"), F.col("__most")).otherwise(F.log10(F.coalesce("n", F.lit(0)) + 1))
    return at.join(dens.select("pix", "n"), "pix", "left").join(F.broadcast(most)).select("i", "j", value.alias("value"), "in_cone")


def picture(raster: DataFrame, width: int, height: int) -> np.ndarray:
    """A raster as an array of rows from the top, NaN outside the sky; as large as the image, whatever the catalogue's size."""
    found = raster.select("i", "j", F.col("value").cast("double").alias("value")).toPandas()
    out = np.full((height, width), np.nan)
    out[found["j"], found["i"]] = found["value"]
    return out
