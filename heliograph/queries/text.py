"""Queries that are SQL text alone, over the kernel's SQL functions, and what other engines make of the same."""

from __future__ import annotations

import uuid

from heliograph.functions import healpix as hp
from heliograph.functions.geometry import gc_dist_sql, gnomonic_sql
from heliograph.functions.sql import register
from heliograph.functions.stages import as_sql
from heliograph.queries.sky import DET, OBJ, built, query, shared_dir, table


def of_files(sf_dir: str, sql: str) -> str:
    head, _, name = sql.rpartition(" FROM ")
    return f"{head} FROM parquet.`{sf_dir}/{name}.parquet`"


def same_pixel(order: int) -> str:
    return as_sql(f"({OBJ})", hp.ang2pix_stages(order, "ra", "dec", "pix"), ["id", "ra", "dec", "pix"])


@query("sql_pixels", f"SELECT a.id, a.pix AS p3, b.pix AS p9, a.pix >> 4 AS up, round(c.cra, 6) AS cra, round(c.cdec, 6) AS cdec FROM ({same_pixel(3)}) AS a JOIN ({same_pixel(9)}) AS b USING (id) JOIN ({as_sql(f'({same_pixel(9)})', hp.pix2ang_stages(9, 'pix', 'cra', 'cdec'))}) AS c USING (id)")
def sql_pixels(spark, sf_dir):
    """Pixels of two orders, a pixel of pixels, and centres."""
    register(spark)
    return spark.sql(f"SELECT id, healpix_pix(3, ra, dec) AS p3, p9, healpix_parent(3, healpix_pix(3, ra, dec), 1) AS up, round(healpix_ra(9, p9), 6) AS cra, round(healpix_dec(9, p9), 6) AS cdec FROM (SELECT *, healpix_pix(9, ra, dec) AS p9 FROM ({of_files(sf_dir, OBJ)}))")


@query("sql_density", f"SELECT pix, count(*) AS n, round(avg(flux), 4) AS flux FROM ({as_sql(f'({DET})', hp.ang2pix_stages(4, 'ra', 'dec', 'pix'))}) AS p GROUP BY pix")
def sql_density(spark, sf_dir):
    """Counts and means by pixel."""
    register(spark)
    return spark.sql(f"SELECT healpix_pix(4, ra, dec) AS pix, count(*) AS n, round(avg(flux), 4) AS flux FROM ({of_files(sf_dir, DET)}) GROUP BY ALL")


@query("sql_cone", "SELECT id, round({d}, 6) AS dist, round({x}, 6) AS x, round({y}, 6) AS y FROM ({det}) AS s WHERE {d} < 10e0".format(d=gc_dist_sql("ra", "dec", 56.0, 20.0), x=gnomonic_sql("ra", "dec", 56.0, 20.0)[0], y=gnomonic_sql("ra", "dec", 56.0, 20.0)[1], det=DET))
def sql_cone(spark, sf_dir):
    """A cone over a catalogue's view, with distances and tangent-plane coordinates."""
    register(spark)
    view = built(spark, table(spark, sf_dir, DET), "det", shared_dir(spark), 5, 2000).view(f"det_{uuid.uuid4().hex[:8]}")
    return spark.sql(f"SELECT id, round(sky_distance(ra, dec, 56, 20), 6) AS dist, round(gnomonic_x(ra, dec, 56, 20), 6) AS x, round(gnomonic_y(ra, dec, 56, 20), 6) AS y FROM {view} WHERE in_cone(ra, dec, 56, 20, 10)")
