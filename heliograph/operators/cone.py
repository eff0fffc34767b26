"""Cone search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.functions.geometry import gc_dist
from heliograph.operators.columns import quoted


def checked_cone(ra, dec, radius) -> tuple[float, float, float]:
    for name, v in (("ra", ra), ("dec", dec), ("radius", radius)):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise TypeError(f"{name} must be a number")
    return float(ra), float(dec), float(radius)


def cone(df: DataFrame, ra: float, dec: float, radius: float, ra_col: str = "ra", dec_col: str = "dec") -> DataFrame:
    """Rows nearer than the radius, with _DIST. The declination band can be pushed to the scan."""
    ra, dec, radius = checked_cone(ra, dec, radius)
    if any(c.upper() == "_DIST" for c in df.columns):
        raise ValueError("the table already has _DIST")
    band = F.col(quoted(dec_col)).between(dec - radius, dec + radius)
    return df.where(band).withColumn("_DIST", gc_dist(quoted(ra_col), quoted(dec_col), ra, dec)).where(F.col("_DIST") < radius)


def partitions_of_cone(parts: list[tuple[int, int]], ra: float, dec: float, radius: float) -> list[tuple[int, int]]:
    """Of a catalogue's (order, pixel) partitions, those that may hold rows of the cone."""
    import numpy as np

    out = []
    for o in sorted({o for o, _ in parts}):
        pix = np.array([p for q, p in parts if q == o])
        away = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(hp.ang2vec(*hp.pix2ang(o, pix)) - hp.ang2vec(ra, dec), axis=-1) / 2, 0, 1)))
        out += [(o, int(p)) for p in pix[away <= radius + hp.reach(o)]]
    return out


def partition_filter(parts: list[tuple[int, int]], order: str = "Norder", pix: str = "Npix") -> Column:
    """A filter on the directory columns, so that only these partitions' files are listed and read."""
    cond = F.lit(False)
    for o in sorted({o for o, _ in parts}):
        cond = cond | ((F.col(order) == o) & F.col(pix).isin([p for q, p in parts if q == o]))
    return cond
