"""Sky operators on streams: a cone filter keeps no state; densities are counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators.cone import cone
from heliograph.operators.partitioning import with_pixel


def stream_cone(stream: DataFrame, ra: float, dec: float, radius: float, ra_col: str = "ra", dec_col: str = "dec") -> DataFrame:
    return cone(stream, ra, dec, radius, ra_col, dec_col)


def stream_density(stream: DataFrame, order: int, time: str, window: str, late: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """(start, pix, n): rows a pixel and window; rows later than ``late`` are dropped with their windows' state."""
    rows = with_pixel(stream.select(time, ra, dec).withWatermark(time, late), order, ra, dec)
    return rows.groupBy(F.window(time, window), "pix").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "pix", "n")
