"""Distances and projections on the sky, in degrees, as SQL text and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(v: float | str) -> str:
    """A number as a double literal, or a column's expression as it is."""
    return v if isinstance(v, str) else f"CAST('{float(v)!r}' AS DOUBLE)"


def gc_dist_sql(ra1, dec1, ra2, dec2) -> str:
    """Great-circle distance (haversine)."""
    a, b, c, d = map(text, (ra1, dec1, ra2, dec2))
    return f"2e0 * degrees(asin(sqrt(least(1e0, pow(sin(radians({d} - {b}) / 2e0), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2e0), 2)))))"


def gc_dist(ra1, dec1, ra2, dec2) -> Column:
    return F.expr(gc_dist_sql(ra1, dec1, ra2, dec2))


def gnomonic_sql(ra, dec, ra0, dec0) -> tuple[str, str]:
    """Tangent-plane coordinates about (ra0, dec0); null on the far hemisphere, where the projection mirrors."""
    a, d, a0, d0 = (f"radians({text(v)})" for v in (ra, dec, ra0, dec0))
    cosc = f"(sin({d0}) * sin({d}) + cos({d0}) * cos({d}) * cos({a} - {a0}))"
    x, y = f"cos({d}) * sin({a} - {a0})", f"cos({d0}) * sin({d}) - sin({d0}) * cos({d}) * cos({a} - {a0})"
    return tuple(f"CASE WHEN {cosc} > 0e0 THEN degrees(({v}) / {cosc}) END" for v in (x, y))


def gnomonic(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    return tuple(F.expr(e) for e in gnomonic_sql(ra, dec, ra0, dec0))


def unit_vector(ra: str, dec: str) -> Column:
    a, d = F.radians(F.expr(ra)), F.radians(F.expr(dec))
    return F.struct((F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z"))
