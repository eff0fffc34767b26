"""Tables behind sky maps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from heliograph.functions import healpix as hp
from heliograph.functions.geometry import gc_dist
from heliograph.functions.stages import apply
from heliograph.operators.columns import quoted


def log_density(dens: DataFrame) -> DataFrame:
    return dens.select("pix", "n", F.log10(F.col("n") + 1).alias("log_n"))


def partition_cover(parts: DataFrame, deepest: int) -> DataFrame:
    """(pix, order): for each pixel of the deepest order the order of the partition that holds it."""
    first = F.expr(f"shiftleft(CAST(Npix AS BIGINT), 2 * ({deepest} - Norder))")
    last = F.expr(f"shiftleft(CAST(Npix AS BIGINT) + 1, 2 * ({deepest} - Norder)) - 1")
    return parts.select(F.explode(F.sequence(first, last)).alias("pix"), F.col("Norder").alias("order"))


def cone_cover(dens: DataFrame, order: int, ra: float, dec: float, radius: float) -> DataFrame:
    """(pix, n, in_cone) of the density map's pixels; a pixel is in the cone if its centre is."""
    rows = apply(dens, hp.pix2ang_stages(order, "pix", "__ra", "__dec"), ["__ra", "__dec"])
    return rows.select("pix", "n", (gc_dist("__ra", "__dec", ra, dec) <= radius).alias("in_cone"))


#: Cones whose pixels are sought in step.
CONES = 512


def disc_cells(cones: DataFrame, order: int, ra: str, dec: str, radius: float, out: str = "pix") -> DataFrame:
    """The rows, one a cone, with each pixel of the order whose centre lies within the radius; the cones of a batch go down from the
    base pixels together."""
    schema = StructType([*cones.schema.fields, StructField(out, LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, CONES):
                part = batch.slice(a, CONES)
                who, pix = hp.query_discs(order, *[part.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (ra, dec)], radius)
                own = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pix)], names=[*own.schema.names, out])

    return cones.mapInArrow(run, schema)


def edge_cells(parts: DataFrame, deeper: int) -> DataFrame:
    """(Norder, Npix, edge, pix): the pixels so many orders deeper along each edge and in each corner of the partitions, numbered as in
    ``healpix.EDGES``."""
    n = 1 << deeper
    cells = []
    for e, (ex, ey) in enumerate(hp.EDGES):
        run = f"sequence(0, {n - 1 if None in (ex, ey) else 0})"
        place = lambda end: "__k" if end is None else str(end * (n - 1))
        cells.append(f"transform({run}, __k -> named_struct('edge', {e}, 'x', {place(ex)}, 'y', {place(ey)}))")
    rows = parts.select("Norder", F.col("Npix").cast("bigint").alias("Npix"), F.explode(F.expr(f"concat({', '.join(cells)})")).alias("__c"))
    rows = rows.select("Norder", "Npix", F.col("__c.edge").alias("edge"), F.col("__c.x").cast("bigint").alias("__x"), F.col("__c.y").cast("bigint").alias("__y"))
    return apply(rows, hp.pack_stages(deeper, "pix", "__x", "__y", "Npix"), ["pix"]).drop("__x", "__y")


def margin_cells(parts: DataFrame, deeper: int) -> DataFrame:
    """(Norder, Npix, margin_pix): the pixels so many orders deeper that border the partitions from outside."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for o, p in zip(batch.column("Norder").to_pylist(), batch.column("Npix").to_pylist()):
                found = hp.margin_pixels(o, p, deeper)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(o, pa.int32()), len(found)), pa.repeat(pa.scalar(p, pa.int64()), len(found)), pa.array(found)], names=["Norder", "Npix", "margin_pix"])

    return parts.select(F.col("Norder").cast("int").alias("Norder"), F.col("Npix").cast("bigint").alias("Npix")).mapInArrow(run, "Norder int, Npix bigint, margin_pix bigint")
