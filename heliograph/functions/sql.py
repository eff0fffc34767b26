"""The kernel as SQL functions, for queries that are SQL text alone."""

from __future__ import annotations

from pyspark.sql import SparkSession

from heliograph.functions import healpix as hp
from heliograph.functions.geometry import gc_dist_sql, gnomonic_sql
from heliograph.functions.stages import as_expression

TOP = hp.MAX_ORDER


def of_position(value: str) -> str:
    """Null for what is no position."""
    return f"CASE WHEN ra IS NOT NULL AND NOT isnan(ra) AND abs(ra) < CAST('Infinity' AS DOUBLE) AND dec BETWEEN -90e0 AND 90e0 THEN {value} END"


def of_pixel(value: str, order: str = "ord") -> str:
    """Null for what is no pixel of an order."""
    return f"CASE WHEN {order} BETWEEN 0 AND {TOP} AND pix >= 0 AND pix < shiftleft(12L, 2 * {order}) THEN {value} END"


def centre(which: str) -> str:
    """A pixel's centre is half a pixel, in units of the deepest order, from its first child there."""
    stages = [
        {"h": f"pow(2e0, {TOP - 1} - ord)", "first": f"shiftleft(pix, 2 * ({TOP} - ord))"},
        *hp.unpack_stages(TOP, "first", "u"),
        *hp.angle_stages(TOP, "u_x + h", "u_y + h", "u_f", "ra", "dec", "a"),
    ]
    return of_pixel(as_expression(stages, ["ord", "pix"], which))


def definitions() -> dict[str, tuple[str, str, str]]:
    """Parameters, type and body of each function."""
    pixel = as_expression(hp.ang2pix_stages(TOP, "ra", "dec", "pix"), ["ra", "dec"], "pix")
    x, y = gnomonic_sql("ra", "dec", "ra0", "dec0")
    # least() skips nulls
    distance = f"CASE WHEN ra IS NOT NULL AND dec IS NOT NULL AND ra0 IS NOT NULL AND dec0 IS NOT NULL THEN {gc_dist_sql('ra', 'dec', 'ra0', 'dec0')} END"
    place = "ra DOUBLE, dec DOUBLE"
    about = f"{place}, ra0 DOUBLE, dec0 DOUBLE"
    return {
        "healpix_pix": (f"ord INT, {place}", "BIGINT", of_position(f"CASE WHEN ord BETWEEN 0 AND {TOP} THEN shiftright({pixel}, 2 * ({TOP} - ord)) END")),
        "healpix_ra": ("ord INT, pix BIGINT", "DOUBLE", centre("ra")),
        "healpix_dec": ("ord INT, pix BIGINT", "DOUBLE", centre("dec")),
        "healpix_parent": ("ord INT, pix BIGINT, coarser INT", "BIGINT", of_pixel("CASE WHEN coarser BETWEEN 0 AND ord THEN shiftright(pix, 2 * (ord - coarser)) END")),
        "healpix_resolution": ("ord INT", "DOUBLE", f"{hp.resolution(0)!r}D / pow(2e0, ord)"),
        "spatial_sort_key": ("ord INT, pix BIGINT", "BIGINT", of_pixel("CASE WHEN ord <= 20 THEN shiftleft(pix, 2 * (20 - ord)) END")),
        "sky_distance": (about, "DOUBLE", distance),
        "in_cone": (f"{about}, radius DOUBLE", "BOOLEAN", f"dec BETWEEN dec0 - radius AND dec0 + radius AND {distance} < radius"),
        "gnomonic_x": (about, "DOUBLE", x),
        "gnomonic_y": (about, "DOUBLE", y),
    }


def register(spark: SparkSession, temporary: bool = True) -> list[str]:
    """Create the functions, of this session or else of its current database. They are SQL, so the optimiser sees their bodies: a filter
    by ``in_cone`` pushes its band of declinations to the scan. Returns their names."""
    for name, (parameters, kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE {'TEMPORARY ' if temporary else ''}FUNCTION {name}({parameters}) RETURNS {kind} RETURN ({body})")
    return list(definitions())
