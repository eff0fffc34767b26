"""Queries and their SQL."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.functions.geometry import gc_dist, gc_dist_sql, gnomonic, gnomonic_sql
from heliograph.functions.stages import apply, as_sql
from heliograph.operators import columns as co
from heliograph.operators import cone as cn
from heliograph.operators import coverage as cv
from heliograph.operators import crossmatch as xm
from heliograph.operators import partitioning as pt
from heliograph.operators import raster
from heliograph.operators import tiles as ti
from heliograph.plans.builder import CatalogBuilder
from heliograph.plans.catalog import Catalog
from heliograph.sources import readers, storage

C1, C2 = "CAST('0.5698402909980532' AS DOUBLE)", "CAST('0.7548776662466927' AS DOUBLE)"


def frac(k: str, c: str) -> str:
    return f"((CAST({k} AS DOUBLE) * {c}) % 1e0)"


def ra_of(k: str) -> str:
    return f"round(360e0 * {frac(k, C1)}, 9)"


def dec_of(k: str, power: int = 1) -> str:
    v = " * ".join([frac(k, C2)] * power)
    return f"round(degrees(asin(2e0 * {v} - 1e0)), 9)"


OBJ = f"SELECT c_custkey AS id, {ra_of('c_custkey')} AS ra, {dec_of('c_custkey')} AS dec, c_acctbal AS mag FROM customer"
DET = f"SELECT o_orderkey AS id, o_custkey AS obj, round(({ra_of('o_custkey')} + 0.2e0 * {frac('o_orderkey', C1)} - 0.1e0 + 360e0) % 360e0, 9) AS ra, round(greatest(-90e0, least(90e0, {dec_of('o_custkey')} + 0.2e0 * {frac('o_orderkey', C2)} - 0.1e0)), 9) AS dec, o_totalprice AS flux FROM orders"
#: Objects crowded to one side of the sky, for partitions of several orders.
SKEW = f"SELECT o_orderkey AS id, {ra_of('o_orderkey')} AS ra, {dec_of("o_orderkey", 2)} AS dec FROM orders"
ORDER_K, THRESHOLD = 7, 300


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A projection of one of the driver's tables."""
    name = sql.rpartition(" FROM ")[2]
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*split_columns(sql[len("SELECT ") : sql.rindex(" FROM ")]))


def split_columns(text: str) -> list[str]:
    out, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out]


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---- cones ----


def cone_sql(source: str, ra: float, dec: float, radius: float, cols: str = "*") -> str:
    return f"SELECT {cols}, round(d, 6) AS _DIST FROM (SELECT *, {gc_dist_sql('ra', 'dec', ra, dec)} AS d FROM ({source}) AS s) AS t WHERE d < {float(radius)!r}"


def add_cone(name: str, source: str, ra: float, dec: float, radius: float) -> None:
    cols = "id, ra, dec"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(cn.cone(table(spark, sf_dir, source).select("id", "ra", "dec"), ra, dec, radius), "_DIST")

    query(name, cone_sql(source, ra, dec, radius, cols))(run)


add_cone("cone_search", DET, 56.0, 20.0, 10.0)
add_cone("cone_search_empty", DET, 56.0, 20.0, 0.000001)
add_cone("cone_search_polar", DET, 10.0, 89.0, 12.0)
add_cone("cone_search_south_pole", OBJ, 0.0, -90.0, 25.0)
add_cone("cone_search_seam", DET, 359.5, -10.0, 8.0)
add_cone("cone_search_whole_sky", OBJ, 20.0, 30.0, 181.0)


@query("cone_assign_filter", f"SELECT id, ra, dec, mag, round(pm, 6) AS pm, round(d, 6) AS _DIST FROM (SELECT *, sqrt(pow(mag, 2) + pow(id % 100, 2)) AS pm, {gc_dist_sql('ra', 'dec', 55.0, 20.0)} AS d FROM ({OBJ}) AS s) AS t WHERE d < 40e0 AND pm > 1000e0 AND mag > 0e0")
def cone_assign_filter(spark, sf_dir):
    found = cn.cone(table(spark, sf_dir, OBJ), 55.0, 20.0, 40.0).withColumn("pm", F.sqrt(F.pow("mag", F.lit(2)) + F.pow(F.col("id") % 100, F.lit(2))))
    return rounded(found.where("pm > 1000 AND mag > 0"), "pm", "_DIST")


@query("gc_distance", f"SELECT a.id, round({gc_dist_sql('a.ra', 'a.dec', 'b.ra', 'b.dec')}, 6) AS dist FROM ({DET}) AS a JOIN ({OBJ}) AS b ON a.obj = b.id")
def gc_distance(spark, sf_dir):
    obj = table(spark, sf_dir, OBJ).select(F.col("id").alias("obj"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    return table(spark, sf_dir, DET).join(obj, "obj").select("id", F.round(gc_dist("ra", "dec", "ra2", "dec2"), 6).alias("dist"))


@query("gnomonic_xy", "SELECT id, round({}, 6) AS x, round({}, 6) AS y FROM ({}) AS s WHERE {} < 60e0".format(*gnomonic_sql("ra", "dec", 100.0, 15.0), OBJ, gc_dist_sql("ra", "dec", 100.0, 15.0)))
def gnomonic_xy(spark, sf_dir):
    x, y = gnomonic("ra", "dec", 100.0, 15.0)
    return table(spark, sf_dir, OBJ).where(gc_dist("ra", "dec", 100.0, 15.0) < 60.0).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


# ---- pixels ----

PIX = [(0, "p0"), (5, "p5"), (10, "p10"), (14, "p14")]


def pixels_sql() -> str:
    stages = [s for o, n in PIX for s in hp.ang2pix_stages(o, "ra", "dec", n, f"h{o}")]
    return as_sql(f"({OBJ})", stages, ["id", *[n for _, n in PIX]])


@query("healpix_pix", pixels_sql())
def healpix_pix(spark, sf_dir):
    df = table(spark, sf_dir, OBJ)
    for o, n in PIX:
        df = pt.with_pixel(df, o, "ra", "dec", n)
    return df.select("id", *[n for _, n in PIX])


@query("healpix_parent", as_sql(f"({as_sql(f'({OBJ})', hp.ang2pix_stages(10, 'ra', 'dec', 'pix'))})", [{"parent": "pix >> 2", "top": "pix >> 20", "child": "pix << 2"}], ["id", "pix", "parent", "top", "child"]))
def healpix_parent(spark, sf_dir):
    df = pt.with_pixel(table(spark, sf_dir, OBJ), 10, "ra", "dec")
    return df.select("id", "pix", F.shiftright("pix", 2).alias("parent"), F.shiftright("pix", 20).alias("top"), F.shiftleft("pix", 2).alias("child"))


def ring_sql(order: int) -> str:
    """Pixels of the ring scheme straight from positions: rings and places in them, without faces."""
    ns = 1 << order
    return f"""SELECT id, CASE WHEN za <= 2e0 / 3e0 THEN {2 * ns * (ns - 1)} + (ir - 1) * {4 * ns} + (((jp + jm - {ns} + (1 - (ir & 1)) + 1) // 2) % {4 * ns} + {4 * ns}) % {4 * ns}
      WHEN z > 0 THEN 2 * ring * (ring - 1) + least(CAST(floor(tt * ring) AS BIGINT), 4 * ring - 1)
      ELSE {12 * ns * ns} - 2 * ring * (ring + 1) + least(CAST(floor(tt * ring) AS BIGINT), 4 * ring - 1) END AS ring{order}
    FROM (SELECT *, {ns} + 1 + jp - jm AS ir, least({ns}, qp + qm + 1) AS ring FROM (SELECT *,
      CAST(floor({ns} * (0.5e0 + tt) - {ns} * z * 0.75e0) AS BIGINT) AS jp, CAST(floor({ns} * (0.5e0 + tt) + {ns} * z * 0.75e0) AS BIGINT) AS jm,
      CAST(floor((tt - floor(tt)) * cap) AS BIGINT) AS qp, CAST(floor((1e0 - (tt - floor(tt))) * cap) AS BIGINT) AS qm
    FROM (SELECT id, sin(radians(dec)) AS z, abs(sin(radians(dec))) AS za, ((ra % 360e0) + 360e0) % 360e0 / 90e0 AS tt, {ns} * sqrt(6e0) * sin(radians(90e0 - abs(dec)) / 2e0) AS cap FROM ({OBJ}) AS s) AS a) AS b) AS c"""


RINGS = (0, 4, 10)


@query("healpix_ring", "SELECT * FROM " + " JOIN ".join(f"({ring_sql(o)}) AS r{o}" + (" USING (id)" if o else "") for o in RINGS))
def healpix_ring(spark, sf_dir):
    df = table(spark, sf_dir, OBJ).select("id", "ra", "dec")
    for o in RINGS:
        df = apply(pt.with_pixel(df, o, "ra", "dec", f"nest{o}"), hp.ring_stages(o, f"nest{o}", f"ring{o}"), [f"ring{o}"])
    return df.select("id", *[f"ring{o}" for o in RINGS])


@query("healpix_center", "SELECT id, pix, round(cra, 6) AS cra, round(cdec, 6) AS cdec FROM (" + as_sql(f"({OBJ})", [*hp.ang2pix_stages(7, "ra", "dec", "pix"), *hp.pix2ang_stages(7, "pix", "cra", "cdec")]) + ") AS c")
def healpix_center(spark, sf_dir):
    df = apply(pt.with_pixel(table(spark, sf_dir, OBJ), 7, "ra", "dec"), hp.pix2ang_stages(7, "pix", "cra", "cdec"))
    return df.select("id", "pix", F.round("cra", 6).alias("cra"), F.round("cdec", 6).alias("cdec"))


NB = [f"nb{k}" for k in range(8)]


@query("healpix_neighbours", as_sql(f"({OBJ})", [*hp.xyf_stages(4, "ra", "dec"), *hp.neighbour_stages(4, "hp_x", "hp_y", "hp_f")], ["id", *NB]))
def healpix_neighbours(spark, sf_dir):
    stages = [*hp.unpack_stages(4, "pix"), *hp.neighbour_stages(4, "up_x", "up_y", "up_f")]
    return apply(pt.with_pixel(table(spark, sf_dir, OBJ), 4, "ra", "dec"), stages).select("id", *NB)


def vectors(spark, sf_dir):
    from heliograph.functions.geometry import unit_vector

    return table(spark, sf_dir, OBJ).select("id", unit_vector("ra", "dec").alias("v")).select("id", *[F.round(F.col("v")[k], 6).alias(k) for k in "xyz"])


query("unit_vectors", f"SELECT id, round(cos(radians(dec)) * cos(radians(ra)), 6) AS x, round(cos(radians(dec)) * sin(radians(ra)), 6) AS y, round(sin(radians(dec)), 6) AS z FROM ({OBJ}) AS s")(vectors)

# ---- densities and partitions ----



def density_sql(source: str, order: int) -> str:
    return f"SELECT pix, count(*) AS n FROM ({as_sql(f'({source})', hp.ang2pix_stages(order, 'ra', 'dec', 'pix'), ['id', 'ra', 'dec', 'pix'])}) AS p GROUP BY pix"


def map_sql(source: str, order: int, threshold: int) -> str:
    """Pixels below the threshold whose parent is not; pixels of the deepest order are kept however full they are."""
    up = f"SELECT o, pix >> CAST(2 * ({order} - o) AS BIGINT) AS q, CAST(sum(n) AS BIGINT) AS n FROM ({density_sql(source, order)}) AS d, (SELECT unnest(range(0, {order + 1})) AS o) AS orders GROUP BY 1, 2"
    return f"SELECT CAST(a.o AS INTEGER) AS Norder, a.q AS Npix, a.n FROM ({up}) AS a LEFT JOIN ({up}) AS b ON b.o = a.o - 1 AND b.q = a.q >> 2 WHERE (a.n < {threshold} OR a.o = {order}) AND (a.o = 0 OR b.n >= {threshold})"


def assign_sql(source: str, order: int, threshold: int) -> str:
    """Rows with their partition's Norder and Npix."""
    pixels = as_sql(f"({source})", hp.ang2pix_stages(order, "ra", "dec", "pix"))
    return f"SELECT p.*, m.Norder, m.Npix FROM ({pixels}) AS p JOIN ({map_sql(source, order, threshold)}) AS m ON p.pix >> CAST(2 * ({order} - m.Norder) AS BIGINT) = m.Npix"


PIXELS = as_sql(f"({SKEW})", hp.ang2pix_stages(ORDER_K, "ra", "dec", "pix"), ["id", "ra", "dec", "pix"])
DENSITY = density_sql(SKEW, ORDER_K)
MAP = map_sql(SKEW, ORDER_K, THRESHOLD)


def density_of(spark, sf_dir) -> DataFrame:
    return pt.density(table(spark, sf_dir, SKEW), ORDER_K, "ra", "dec")


def map_of(spark, sf_dir) -> DataFrame:
    return pt.partition_map(density_of(spark, sf_dir), ORDER_K, THRESHOLD, allow_overflow=True)


query("density_map", DENSITY)(density_of)
query("density_rebin", f"SELECT pix >> 6 AS pix, CAST(sum(n) AS BIGINT) AS n FROM ({DENSITY}) AS d GROUP BY 1")(lambda s, d: pt.rebinned(density_of(s, d), ORDER_K, ORDER_K - 3))
query("density_log", f"SELECT pix, n, round(log10(n + 1), 6) AS log_n FROM ({DENSITY}) AS d")(lambda s, d: rounded(cv.log_density(density_of(s, d)), "log_n"))
query("partition_map", MAP)(map_of)
query("partition_total", f"SELECT CAST(sum(n) AS BIGINT) AS n_sources, count(*) AS n_partitions, max(Norder) AS deepest FROM ({MAP}) AS m")(lambda s, d: map_of(s, d).agg(F.sum("n").alias("n_sources"), F.count("*").alias("n_partitions"), F.max("Norder").alias("deepest")))
query("spatial_sort_key", f"SELECT Norder, Npix, CAST(Npix AS BIGINT) << CAST(2 * (20 - Norder) AS BIGINT) AS sort_key FROM ({MAP}) AS m")(lambda s, d: map_of(s, d).select("Norder", "Npix", pt.sort_key().alias("sort_key")))


@query("partition_assign", f"SELECT p.id, m.Norder, CAST(m.Npix AS INTEGER) AS Npix, CAST(floor(m.Npix / 10000) * 10000 AS INTEGER) AS Dir FROM ({PIXELS}) AS p JOIN ({MAP}) AS m ON p.pix >> CAST(2 * ({ORDER_K} - m.Norder) AS BIGINT) = m.Npix")
def partition_assign(spark, sf_dir):
    dens = density_of(spark, sf_dir)
    cells = pt.cell_partitions(dens, pt.partition_map(dens, ORDER_K, THRESHOLD, allow_overflow=True), ORDER_K)
    return pt.assigned(table(spark, sf_dir, SKEW), cells, dens.count(), ORDER_K, "ra", "dec").select("id", "Norder", "Npix", "Dir")


@query("spatial_index_rank", f"SELECT id, (p << 31) | (row_number() OVER (PARTITION BY p ORDER BY ra, dec, id) - 1) AS _ID FROM ({as_sql(f'({DET})', hp.ang2pix_stages(14, 'ra', 'dec', 'p'), ['id', 'ra', 'dec', 'p'])}) AS s")
def spatial_index_rank(spark, sf_dir):
    return pt.with_spatial_id(table(spark, sf_dir, DET), "ra", "dec", "id").select("id", "_ID")


#: Every other object is at one of 64 places of a spot that is smaller than an id's pixel.
CROWDED = f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN round(200e0 + 1e-5 * (o_orderkey % 64), 9) ELSE {ra_of('o_orderkey')} END AS ra, CASE WHEN o_orderkey % 2 = 0 THEN 30e0 ELSE {dec_of('o_orderkey')} END AS dec FROM orders"


@query("spatial_index_crowded", "SELECT id, CAST(Norder AS INTEGER) AS Norder, CAST(Npix AS INTEGER) AS Npix, (p << 31) | (row_number() OVER (PARTITION BY p ORDER BY ra, dec, id) - 1) AS _ID FROM ({}) AS s".format(as_sql(f"({assign_sql(CROWDED, 5, THRESHOLD)})", hp.ang2pix_stages(14, "ra", "dec", "p", "h14"), ["id", "ra", "dec", "Norder", "Npix", "p"])))
def spatial_index_crowded(spark, sf_dir):
    """A catalogue with half of its rows in a pixel of the deepest order: that pixel is ranked and written in ranges."""
    return built(spark, table(spark, sf_dir, CROWDED), "crowd", shared_dir(spark), 5, THRESHOLD).load(["id", "Norder", "Npix", "_ID"])


OTHER = map_sql(SKEW, ORDER_K, 3 * THRESHOLD)


@query("partition_pairs", f"SELECT a.Norder AS o1, a.Npix AS p1, b.Norder AS o2, b.Npix AS p2, greatest(a.Norder, b.Norder) AS hips_k, CASE WHEN b.Norder > a.Norder THEN b.Npix ELSE a.Npix END AS hips_pix FROM ({MAP}) AS a JOIN ({OTHER}) AS b ON a.Npix << CAST(2 * (20 - a.Norder) AS BIGINT) < (b.Npix + 1) << CAST(2 * (20 - b.Norder) AS BIGINT) AND b.Npix << CAST(2 * (20 - b.Norder) AS BIGINT) < (a.Npix + 1) << CAST(2 * (20 - a.Norder) AS BIGINT)")
def partition_pairs(spark, sf_dir):
    return pt.partition_pairs(map_of(spark, sf_dir), pt.partition_map(density_of(spark, sf_dir), ORDER_K, 3 * THRESHOLD, allow_overflow=True))


COVER_ORDER = ORDER_K
query("partition_cover", f"SELECT (Npix << CAST(2 * ({COVER_ORDER} - Norder) AS BIGINT)) + i AS pix, Norder AS \"order\" FROM (SELECT Npix, Norder, unnest(range(0, CAST(1 AS BIGINT) << CAST(2 * ({COVER_ORDER} - Norder) AS BIGINT))) AS i FROM ({MAP}) AS m) AS t")(lambda s, d: cv.partition_cover(map_of(s, d), COVER_ORDER))
query("cone_cover", "SELECT pix, n, {} <= 30e0 AS in_cone FROM ({}) AS c".format(gc_dist_sql("cra", "cdec", 56.0, 20.0), as_sql(f"({DENSITY})", hp.pix2ang_stages(ORDER_K, "pix", "cra", "cdec"))))(lambda s, d: cv.cone_cover(density_of(s, d), ORDER_K, 56.0, 20.0, 30.0))


IMAGE = (200, 100)
#: The image's points by another way: the projected latitude's area, and the parallel's share of its width.
POINTS = "SELECT i, j, CASE WHEN x <= 0 THEN -180e0 * x / w ELSE 360e0 - 180e0 * x / w END AS ra, degrees(asin((2e0 * atan2(y, w) + 2e0 * y * w) / pi())) AS dec FROM (SELECT *, sqrt((1e0 - y) * (1e0 + y)) AS w FROM (SELECT i, j, (i + 0.5e0) / {0} * 2e0 - 1e0 AS x, 1e0 - (j + 0.5e0) / {1} * 2e0 AS y FROM (SELECT unnest(range(0, {0})) AS i) AS a, (SELECT unnest(range(0, {1})) AS j) AS b) AS c) AS d WHERE abs(x) <= w".format(*IMAGE)
AT = as_sql(f"({POINTS})", hp.ang2pix_stages(ORDER_K, "ra", "dec", "pix"), ["i", "j", "pix"])
query("map_sources", f"SELECT i, j, round(log10(coalesce(n, 0) + 1), 6) AS value FROM ({AT}) AS a LEFT JOIN ({DENSITY}) AS d USING (pix)")(lambda s, d: rounded(raster.density_raster(density_of(s, d), ORDER_K, *IMAGE), "value"))
CENTRES = as_sql(f"({AT})", hp.pix2ang_stages(ORDER_K, "pix", "cra", "cdec"), ["i", "j", "pix", "cra", "cdec"])
query("map_cone", f"WITH dens AS MATERIALIZED ({DENSITY}) SELECT i, j, in_cone, round(CASE WHEN in_cone THEN log10((SELECT max(n) FROM dens) + 1) + 1 ELSE log10(coalesce(n, 0) + 1) END, 6) AS value FROM (SELECT *, {gc_dist_sql('cra', 'cdec', 56.0, 20.0)} <= 30e0 AS in_cone FROM ({CENTRES}) AS c) AS a LEFT JOIN dens USING (pix)")(lambda s, d: rounded(raster.cone_raster(density_of(s, d), ORDER_K, 56.0, 20.0, 30.0, *IMAGE), "value"))


@query("map_partitions", f"SELECT i, j, coalesce(m.Norder, -1) AS value FROM ({AT}) AS a LEFT JOIN ({MAP}) AS m ON a.pix >> CAST(2 * ({ORDER_K} - m.Norder) AS BIGINT) = m.Npix")
def map_partitions(spark, sf_dir):
    parts = map_of(spark, sf_dir)
    return raster.partition_raster(parts, parts.count(), list(range(ORDER_K + 1)), *IMAGE)


@query("healpix_sizes", f"SELECT Norder, Npix, CAST(1 AS BIGINT) << CAST(Norder AS BIGINT) AS nside, CAST(12 AS BIGINT) << CAST(2 * Norder AS BIGINT) AS n_pixels, round(sqrt(4e0 * pi() / CAST(12 AS DOUBLE)) * 180e0 / pi() / pow(2e0, Norder), 9) AS resolution, round(n / (4e0 * pi() * pow(180e0 / pi(), 2e0) / 12e0 / pow(4e0, Norder)), 6) AS density FROM ({MAP}) AS m")
def healpix_sizes(spark, sf_dir):
    """The sizes of the partitions' pixels, and their rows a square degree."""
    area = F.lit(hp.pixel_area(0)) / F.pow(F.lit(4.0), F.col("Norder"))
    sides = F.expr("shiftleft(CAST(1 AS BIGINT), Norder)"), F.expr("shiftleft(CAST(12 AS BIGINT), 2 * Norder)")
    return map_of(spark, sf_dir).select("Norder", "Npix", sides[0].alias("nside"), sides[1].alias("n_pixels"), F.round(F.lit(hp.resolution(0)) / F.pow(F.lit(2.0), F.col("Norder")), 9).alias("resolution"), F.round(F.col("n") / area, 6).alias("density"))


def all_pixels(order: int) -> str:
    return f"(SELECT unnest(range(0, {hp.order2npix(order)})) AS pix)"


@query("disc_pixels", "SELECT o.id, c.pix FROM ({}) AS o JOIN ({}) AS c ON c.cdec BETWEEN o.dec - 2.5e0 AND o.dec + 2.5e0 AND {} <= 2e0".format(OBJ, as_sql(all_pixels(5), hp.pix2ang_stages(5, "pix", "cra", "cdec")), gc_dist_sql("o.ra", "o.dec", "c.cra", "c.cdec")))
def disc_pixels(spark, sf_dir):
    """The pixels of a disc about each object."""
    return cv.disc_cells(table(spark, sf_dir, OBJ), 5, "ra", "dec", 2.0).select("id", "pix")


RIM_ORDER, DEEPER = 3, 2


def coarse_map(spark, sf_dir) -> DataFrame:
    return pt.partition_map(pt.density(table(spark, sf_dir, SKEW), RIM_ORDER, "ra", "dec"), RIM_ORDER, THRESHOLD, allow_overflow=True)


def rim_sql(order: int) -> str:
    """From the other side: pixels outside that have a neighbour inside."""
    deep = order + DEEPER
    cells = as_sql(all_pixels(deep), [*hp.unpack_stages(deep, "pix"), *hp.neighbour_stages(deep, "up_x", "up_y", "up_f")])
    touches = " OR ".join(f"(t.nb{k} >= 0 AND t.nb{k} >> {2 * DEEPER} = m.Npix)" for k in range(8))
    return f"SELECT m.Norder, m.Npix, t.pix AS margin_pix FROM ({cells}) AS t JOIN parts AS m ON m.Norder = {order} AND t.pix >> {2 * DEEPER} <> m.Npix AND ({touches})"


@query("margin_pixels", f"WITH parts AS MATERIALIZED ({map_sql(SKEW, RIM_ORDER, THRESHOLD)}) " + " UNION ALL ".join(rim_sql(o) for o in range(RIM_ORDER + 1)))
def margin_pixels(spark, sf_dir):
    return cv.margin_cells(coarse_map(spark, sf_dir), DEEPER)


EDGE_SQL = " UNION ALL ".join(f"SELECT Norder, Npix, {e} AS edge, (Npix << 4) + i AS pix FROM parts, cells WHERE {' AND '.join(f'{v} = {3 * at}' for v, at in zip('xy', ends) if at is not None)}" for e, ends in enumerate(hp.EDGES))


@query("edge_pixels", f"WITH parts AS MATERIALIZED ({MAP}), cells AS (SELECT i, (i & 1) + 2 * ((i >> 2) & 1) AS x, ((i >> 1) & 1) + 2 * ((i >> 3) & 1) AS y FROM (SELECT unnest(range(0, 16)) AS i) AS t) {EDGE_SQL}")
def edge_pixels(spark, sf_dir):
    """The cells along the partitions' edges and in their corners."""
    return cv.edge_cells(map_of(spark, sf_dir), 2)


@query("polar_flags", f"SELECT id, pix, CASE WHEN pix < 64 AND pix % 16 = 15 THEN 'North' WHEN pix >= 128 AND pix % 16 = 0 THEN 'South' ELSE '' END AS pole FROM ({as_sql(f'({DET})', hp.ang2pix_stages(2, 'ra', 'dec', 'pix'))}) AS s")
def polar_flags(spark, sf_dir):
    """Which detections lie in a pixel that touches a pole."""
    rows = pt.with_pixel(table(spark, sf_dir, DET), 2, "ra", "dec")
    return apply(rows, hp.polar_stages(2, "pix", "pole"), ["pole"]).select("id", "pix", "pole")


# ---- coverages ----

DISC_ORDER = 6
CONES = f"SELECT id AS cone, ra AS cra, dec AS cdec, 0.5e0 + (id % 4) * 0.5e0 AS radius FROM ({OBJ}) AS o"


def cones(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, OBJ).selectExpr("id AS cone", "ra AS cra", "dec AS cdec", "0.5e0 + (id % 4) * 0.5e0 AS radius")


def islands_sql(pixels: str) -> str:
    """Runs of neighbouring numbers within a chunk, as ranges of the finest pixels."""
    bits, fine = 2 * (DISC_ORDER - ti.CHUNK_ORDER), 2 * (pt.ID_ORDER - DISC_ORDER)
    return f"SELECT min(pix) << {fine} AS lo, (max(pix) + 1) << {fine} AS hi FROM (SELECT pix, pix - row_number() OVER (PARTITION BY pix >> {bits} ORDER BY pix) AS g FROM ({pixels}) AS p) AS q GROUP BY pix >> {bits}, g"


DISCS = "SELECT DISTINCT c.pix FROM ({}) AS o JOIN ({}) AS c ON c.pdec BETWEEN o.cdec - o.radius - 0.1e0 AND o.cdec + o.radius + 0.1e0 AND {} <= o.radius".format(CONES, as_sql(all_pixels(DISC_ORDER), hp.pix2ang_stages(DISC_ORDER, "pix", "pra", "pdec")), gc_dist_sql("o.cra", "o.cdec", "c.pra", "c.pdec"))
CROWD = f"SELECT pix FROM ({density_sql(SKEW, DISC_ORDER)}) AS d"


def disc_coverage(spark, sf_dir) -> DataFrame:
    return ti.union(ti.tile_ranges(ti.cone_tiles(cones(spark, sf_dir), "cra", "cdec", "radius", DISC_ORDER)))


def crowd_coverage(spark, sf_dir) -> DataFrame:
    dens = pt.density(table(spark, sf_dir, SKEW), DISC_ORDER, "ra", "dec")
    return ti.union(ti.tile_ranges(dens.withColumn("o", F.lit(DISC_ORDER)), "o", "pix"))


query("coverage_union", islands_sql(DISCS))(disc_coverage)
query("coverage_intersection", islands_sql(f"({DISCS}) INTERSECT ({CROWD})"))(lambda s, d: ti.intersection(disc_coverage(s, d), crowd_coverage(s, d)))
query("coverage_difference", islands_sql(f"({CROWD}) EXCEPT ({DISCS})"))(lambda s, d: ti.difference(crowd_coverage(s, d), disc_coverage(s, d)))


@query("coverage_rows", f"SELECT id, ra, dec FROM ({as_sql(f'({DET})', hp.ang2pix_stages(DISC_ORDER, 'ra', 'dec', 'pix'), ['id', 'ra', 'dec', 'pix'])}) AS r WHERE pix IN ({DISCS})")
def coverage_rows(spark, sf_dir):
    """The detections in the discs about objects."""
    cov = disc_coverage(spark, sf_dir)
    return ti.rows_within(table(spark, sf_dir, DET).select("id", "ra", "dec"), cov, ti.tiles_of(cov).count())


@query("cones_of_customers", "SELECT cone, id, round(d, 6) AS _DIST FROM (SELECT c.cone, c.radius, r.id, {} AS d FROM ({}) AS c JOIN ({}) AS r ON r.dec BETWEEN c.cdec - c.radius AND c.cdec + c.radius) AS p WHERE d < radius".format(gc_dist_sql("r.ra", "r.dec", "c.cra", "c.cdec"), CONES, DET))
def cones_of_customers(spark, sf_dir):
    """Each customer's cone, of a radius of its own, with the detections in it, from a catalogue on disk."""
    cat = built(spark, table(spark, sf_dir, DET), "det", shared_dir(spark), 5, 2000)
    return rounded(cat.cones(cones(spark, sf_dir), "cra", "cdec", "radius", ["id"]).select("cone", "id", "_DIST"), "_DIST")


# ---- cross-matches ----


def match_sql(n: int, distance: float, one: str = OBJ, two: str = DET) -> str:
    """Brute force in a band of declination."""
    d = gc_dist_sql("a.ra", "a.dec", "b.ra", "b.dec")
    return f"SELECT id1, id2, round(d, 6) AS _DIST FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS r FROM (SELECT a.id AS id1, b.id AS id2, {d} AS d FROM ({one}) AS a JOIN ({two}) AS b ON b.dec BETWEEN a.dec - {float(distance)!r} AND a.dec + {float(distance)!r}) AS p WHERE d < {float(distance)!r}) AS q WHERE r <= {n}"


def sides(spark, sf_dir, one: str = OBJ, two: str = DET) -> tuple[DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, s).select(F.col("id").alias(f"id{k}"), F.col("ra").alias(f"ra{k}"), F.col("dec").alias(f"dec{k}")) for k, s in ((1, one), (2, two)))


def add_match(name: str, n: int, distance: float, one: str = OBJ, two: str = DET) -> None:
    def run(spark, sf_dir):
        return rounded(xm.cross_match(*sides(spark, sf_dir, one, two), n, distance, "id1", "id2").select("id1", "id2", "_DIST"), "_DIST")

    query(name, match_sql(n, distance, one, two))(run)


add_match("xmatch_nearest", 1, 0.1)
add_match("xmatch_two", 2, 0.05)
add_match("xmatch_knn4", 4, 1.0)
add_match("xmatch_detections", 1, 0.01, DET, OBJ)
add_match("xmatch_wide", 3, 20.0, OBJ, OBJ.replace("c_custkey", "(c_custkey + 7)"))
add_match("xmatch_empty", 1, 0.0000001, OBJ, DET.replace("AS dec,", "* 0.999e0 AS dec,"))


# ---- catalogues on disk ----


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share; of this machine only where all executors are on it."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/sky-{uuid.uuid4().hex}"
    fs, p = storage.file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # results are lazy and read it
    return path


def built(spark: SparkSession, df: DataFrame, name: str, where: str, order: int = ORDER_K, threshold: int = 5000, margin: float | None = None) -> Catalog:
    return CatalogBuilder(spark, name, source=df, id_kw="id", order_k=order, threshold=threshold, margin=margin, location=where, allow_overflow=True).build()


@query("catalog_roundtrip", f"SELECT id, obj, ra, dec, flux FROM ({DET}) AS s")
def catalog_roundtrip(spark, sf_dir):
    return built(spark, table(spark, sf_dir, DET), "det", shared_dir(spark)).load(["id", "obj", "ra", "dec", "flux"])


@query("catalog_columns", f"SELECT flux, id FROM ({DET}) AS s")
def catalog_columns(spark, sf_dir):
    cat = built(spark, table(spark, sf_dir, DET), "det", shared_dir(spark))
    return cat.load(["flux", "id"], partitions=[(o, p) for o, pix in cat.hips.items() for p in pix])


@query("catalog_rebuild", f"SELECT id, ra, dec FROM ({DET}) AS s")
def catalog_rebuild(spark, sf_dir):
    """One catalogue built anew with other orders; each build has all rows."""
    where = shared_dir(spark)
    path = f"{where}/source"
    table(spark, sf_dir, DET).write.parquet(path)
    for order in (5, 4, 5):
        cat = CatalogBuilder(spark, "det", [path], "parquet", id_kw="id", order_k=order, threshold=2000, margin=None, location=where, allow_overflow=True).build()
    return cat.load(["id", "ra", "dec"])


@query("catalog_versions", f"SELECT 1 AS build, id, flux FROM ({DET}) AS s UNION ALL SELECT 2 AS build, id, flux FROM ({DET}) AS s WHERE id % 3 = 0 UNION ALL SELECT 3 AS build, id, flux FROM ({DET}) AS s")
def catalog_versions(spark, sf_dir):
    """A catalogue open before it is built anew with fewer rows and no margin, the new build, and the first one opened by its name."""
    where = shared_dir(spark)
    det = table(spark, sf_dir, DET)
    old = built(spark, det, "det", where, 5, 2000, 0.2)
    new = built(spark, det.where("id % 3 = 0"), "det", where, 4, 500)
    again = Catalog(spark, "det", where, build=new.builds()[1])
    tables = [cat.load(["id", "flux"]).select(F.lit(k).alias("build"), "id", "flux") for k, cat in enumerate((old, new, again), 1)]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("catalog_cone", cone_sql(DET, 56.0, 20.0, 10.0, "flux, ra, dec, id"))
def catalog_cone(spark, sf_dir):
    return rounded(built(spark, table(spark, sf_dir, DET), "det", shared_dir(spark), 5, 2000).cone_search(56.0, 20.0, 10.0, ["flux"]), "_DIST")


def catalog_pair(spark, sf_dir, threshold=2000):
    where = shared_dir(spark)
    return built(spark, table(spark, sf_dir, OBJ), "obj", where, 5, threshold), built(spark, table(spark, sf_dir, DET), "det", where, 5, threshold)


@query("xmatch_prefixed_cols", "SELECT m.id1 AS obj_id, a.ra AS obj_ra, a.dec AS obj_dec, a.mag AS obj_mag, m.id2 AS det_id, b.ra AS det_ra, b.dec AS det_dec, b.flux AS det_flux, m._DIST FROM ({}) AS m JOIN ({}) AS a ON a.id = m.id1 JOIN ({}) AS b ON b.id = m.id2".format(match_sql(2, 0.1), OBJ, DET))
def xmatch_prefixed_cols(spark, sf_dir):
    one, two = catalog_pair(spark, sf_dir)
    return rounded(one.cross_match(two, ["mag"], ["flux"], 2, 0.1, delim="_").drop("hips_k", "hips_pix"), "_DIST")


def partitioned_match_sql(distance: float, order: int = 5, threshold: int = 2000) -> str:
    d = gc_dist_sql("a.ra", "a.dec", "b.ra", "b.dec")
    near = f"b.dec BETWEEN a.dec - {distance!r} AND a.dec + {distance!r} AND a.Npix >> CAST(2 * greatest(0, a.Norder - b.Norder) AS BIGINT) = b.Npix >> CAST(2 * greatest(0, b.Norder - a.Norder) AS BIGINT)"
    cols = "a.mag AS obj_mag, a.ra AS obj_ra, a.dec AS obj_dec, a.id AS obj_id, b.flux AS det_flux, b.ra AS det_ra, b.dec AS det_dec, b.id AS det_id, greatest(a.Norder, b.Norder) AS hips_k, CASE WHEN b.Norder > a.Norder THEN b.Npix ELSE a.Npix END AS hips_pix"
    pairs = f"SELECT {cols}, {d} AS d FROM ({assign_sql(OBJ, order, threshold)}) AS a JOIN ({assign_sql(DET, order, threshold)}) AS b ON {near}"
    return f"SELECT obj_mag, obj_ra, obj_dec, obj_id, det_flux, det_ra, det_dec, det_id, hips_k, hips_pix, round(d, 6) AS _DIST FROM (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY d, det_id) AS r FROM ({pairs}) AS p WHERE d < {distance!r}) AS q WHERE r = 1"


@query("xmatch_no_margin", partitioned_match_sql(0.1))
def xmatch_no_margin(spark, sf_dir):
    one, two = catalog_pair(spark, sf_dir)
    return rounded(one.cross_match(two, ["mag"], ["flux"], 1, 0.1, evaluate_margins=False, delim="_"), "_DIST")


@query("xmatch_margin_tree", "SELECT m.id1 AS obj_id, m.id2 AS det_id, m._DIST FROM ({}) AS m".format(match_sql(2, 0.1)))
def xmatch_margin_tree(spark, sf_dir):
    """Partition by partition, with the other catalogue's margin rows in place of its neighbouring partitions."""
    where = shared_dir(spark)
    one = built(spark, table(spark, sf_dir, OBJ), "obj", where, 5, 2000)
    two = built(spark, table(spark, sf_dir, DET), "det", where, 5, 2000, 0.2)
    return rounded(one.cross_match(two, ["id"], ["id"], 2, 0.1, evaluate_margins="tree", delim="_").select("obj_id", "det_id", "_DIST"), "_DIST")


@query("xmatch_local", "SELECT m.id1 AS obj_id, a.mag AS obj_mag, m.id2 AS det_id, b.flux AS det_flux, m._DIST FROM ({}) AS m JOIN ({}) AS a ON a.id = m.id1 JOIN ({}) AS b ON b.id = m.id2".format(match_sql(2, 0.05), OBJ, DET))
def xmatch_local(spark, sf_dir):
    """Splits that read both catalogues' partitions and the second one's margin, without a shuffle."""
    where = shared_dir(spark)
    one = built(spark, table(spark, sf_dir, OBJ), "obj", where, 5, 2000)
    two = built(spark, table(spark, sf_dir, DET), "det", where, 5, 2000, 0.2)
    return rounded(one.cross_match(two, ["mag"], ["flux"], 2, 0.05, evaluate_margins="local", delim="_").select("obj_id", "obj_mag", "det_id", "det_flux", "_DIST"), "_DIST")


def margin_sql(source: str, order: int, threshold: int, margin: float, edge: int = 256, fine: int = 64) -> str:
    """Rows beside a partition by sampling its whole border, then finely about the nearest point. Places on the border are edges from
    the northern corner, in units of the deepest order."""
    corner = as_sql(f"(SELECT Norder, Npix, Npix << CAST(2 * ({order} - Norder) AS BIGINT) AS c, CAST(1 AS BIGINT) << CAST({order} - Norder AS BIGINT) AS size FROM ({map_sql(source, order, threshold)}) AS m)", hp.unpack_stages(order, "c", "cu"), ["Norder", "Npix", "size", "cu_x", "cu_y", "cu_f"])

    def points(of: str, u: str, keep: str) -> str:
        side, t = f"CAST(floor({u}) AS BIGINT) % 4", f"({u} - floor({u}))"
        at = f"SELECT *, cu_x + size * CASE {side} WHEN 0 THEN 1 - {t} WHEN 1 THEN 0 WHEN 2 THEN {t} ELSE 1 END AS at_x, cu_y + size * CASE {side} WHEN 0 THEN 1 WHEN 1 THEN 1 - {t} WHEN 2 THEN 0 ELSE {t} END AS at_y FROM ({of}) AS o"
        return as_sql(f"({at})", hp.angle_stages(order, "at_x", "at_y", "cu_f", "bra", "bdec"), [*keep.split(", "), "bra", "bdec"])

    own = "Norder, Npix, size, cu_x, cu_y, cu_f"
    around = points(f"SELECT c.*, s, s / {edge}e0 AS u FROM corners AS c, (SELECT unnest(range(0, {4 * edge})) AS s) AS t", "u", f"{own}, s")
    again = points(f"SELECT n.*, (s + {4 * edge} + (i - {fine}) / {fine}e0) / {edge}e0 AS u FROM nearest AS n, (SELECT unnest(range(0, {2 * fine + 1})) AS i) AS t", "u", "id, ra, dec, Norder, Npix")
    near = gc_dist_sql("r.ra", "r.dec", "b.bra", "b.bdec")
    return f"""WITH corners AS MATERIALIZED ({corner}), around AS MATERIALIZED ({around}),
    discs AS (SELECT a.Norder, a.Npix, b.bra AS cra, b.bdec AS cdec, max({gc_dist_sql("a.bra", "a.bdec", "b.bra", "b.bdec")}) AS r FROM around AS a JOIN around AS b ON a.Norder = b.Norder AND a.Npix = b.Npix AND b.s = 0 GROUP BY ALL),
    placed AS MATERIALIZED (SELECT id, ra, dec, Norder AS o, Npix AS p FROM ({assign_sql(source, order, threshold)}) AS s),
    pairs AS MATERIALIZED (SELECT r.id, r.ra, r.dec, d.Norder, d.Npix FROM placed AS r JOIN discs AS d ON r.dec BETWEEN d.cdec - d.r - {margin!r} AND d.cdec + d.r + {margin!r} AND {gc_dist_sql("r.ra", "r.dec", "d.cra", "d.cdec")} <= d.r + {margin!r} AND (r.o <> d.Norder OR r.p <> d.Npix)),
    nearest AS MATERIALIZED (SELECT q.*, c.size, c.cu_x, c.cu_y, c.cu_f FROM (SELECT r.id, r.ra, r.dec, r.Norder, r.Npix, arg_min(b.s, {near}) AS s, min({near}) AS d FROM pairs AS r JOIN around AS b USING (Norder, Npix) GROUP BY ALL) AS q JOIN corners AS c USING (Norder, Npix) WHERE q.d <= {2 * margin!r})
    SELECT id, Norder, CAST(Npix AS INTEGER) AS Npix FROM ({again}) AS r GROUP BY id, Norder, Npix HAVING min({gc_dist_sql("ra", "dec", "bra", "bdec")}) <= {margin!r}"""


@query("margin_rows", margin_sql(DET, 5, 2000, 0.5))
def margin_rows(spark, sf_dir):
    return built(spark, table(spark, sf_dir, DET), "det", shared_dir(spark), 5, 2000, 0.5).load(["id", "Norder", "Npix"], "neighbor")


@query("catalog_head", "SELECT count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders")
def catalog_head(spark, sf_dir):
    return built(spark, table(spark, sf_dir, DET), "det", shared_dir(spark)).load().agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# ---- sources ----


def written(spark: SparkSession, df: DataFrame, fmt: str) -> str:
    path = f"{shared_dir(spark)}/source"
    w = df.write.option("header", True)
    (w.option("compression", "gzip") if fmt == "csv.gz" else w).csv(path) if fmt != "parquet" else df.write.parquet(path)
    return path


def add_source(fmt: str) -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, OBJ)
        return readers.read_source(spark, written(spark, df, fmt), fmt, dtypes={"id": "i8", "mag": "f8"})

    query("source_" + fmt.replace(".", "_"), OBJ)(run)


for _fmt in ("csv", "csv.gz", "parquet"):
    add_source(_fmt)


@query("dtype_override", f"SELECT CAST(id AS VARCHAR) AS id, CAST(mag AS REAL) AS mag FROM ({OBJ}) AS s")
def dtype_override(spark, sf_dir):
    return co.cast(table(spark, sf_dir, OBJ).select("id", "mag"), {"id": "unicode", "mag": "f4"})


@query("positional_columns", cone_sql(OBJ, 56.0, 20.0, 30.0, "id, ra, dec"))
def positional_columns(spark, sf_dir):
    df = table(spark, sf_dir, OBJ).toDF("_c0", "_c1", "_c2", "_c3")
    ra, dec, key = (co.resolve(df, k) for k in (1, 2, 0))
    return rounded(cn.cone(df.select(key, ra, dec), 56.0, 20.0, 30.0, ra, dec), "_DIST").toDF("id", "ra", "dec", "_DIST")


# ---- relational operators on results ----


@query("delegated_join", "SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def delegated_join(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("delegated_window", f"SELECT obj, id, r FROM (SELECT obj, id, row_number() OVER (PARTITION BY obj ORDER BY flux DESC, id) AS r FROM ({DET}) AS s) AS t WHERE r <= 2")
def delegated_window(spark, sf_dir):
    by = Window.partitionBy("obj").orderBy(F.desc("flux"), "id")
    return table(spark, sf_dir, DET).withColumn("r", F.row_number().over(by).cast("bigint")).where("r <= 2").select("obj", "id", "r")


@query("delegated_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def delegated_rollup(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("delegated_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def delegated_except(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return t("customer").select(F.col("c_custkey").alias("id")).subtract(t("orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")))
