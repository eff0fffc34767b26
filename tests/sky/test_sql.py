"""SQL functions: the same values as the columns' stages and numpy twins, nulls, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.functions.sql import register
from heliograph.operators import partitioning as pt
from heliograph.plans.builder import CatalogBuilder


@pytest.fixture(scope="module")
def sky(spark):
    register(spark)
    return spark.range(3000).select("id", ((F.col("id") * 137.507) % 360).alias("ra"), F.degrees(F.asin((F.col("id") + 0.5) / 1500 - 1)).alias("dec"))


@pytest.mark.parametrize("order", [0, 1, 6, 13, 29])
def test_pixels_and_centres(spark, sky, order):
    got = pt.with_pixel(sky, order, "ra", "dec", "want").withColumn("pix", F.expr(f"healpix_pix({order}, ra, dec)"))
    got = got.selectExpr("want", "pix", f"healpix_ra({order}, want) AS cra", f"healpix_dec({order}, want) AS cdec").toPandas()
    assert (got.want == got.pix).all()
    ra, dec = hp.pix2ang(order, got.want.to_numpy())
    assert np.allclose(got.cra, ra, atol=1e-9) and np.allclose(got.cdec, dec, atol=1e-6 if order > 25 else 1e-9)


def test_orders_by_row(spark, sky):
    rows = sky.limit(40).selectExpr("CAST(id % 12 AS INT) AS o", "healpix_pix(CAST(id % 12 AS INT), ra, dec) AS p", "healpix_pix(12, ra, dec) AS deep").collect()
    assert all(r.p == r.deep >> 2 * (12 - r.o) for r in rows)


def test_what_is_no_position_or_pixel(spark, sky):
    bad = spark.sql("""SELECT healpix_pix(3, NULL, 1D) a, healpix_pix(3, 1D, NULL) b, healpix_pix(3, double('nan'), 0D) c, healpix_pix(3, 1D, 90.5D) d, healpix_pix(30, 1D, 1D) e,
        healpix_ra(1, 48L) f, healpix_dec(1, -1L) g, healpix_parent(3, 5L, 4) h, healpix_pix(NULL, 1D, 1D) i, in_cone(NULL, 1D, 1D, 1D, 5D) j""").first()
    assert set(bad) == {None}
    assert spark.sql("SELECT healpix_resolution(5) r").first().r == pytest.approx(hp.resolution(5))
    assert spark.sql("SELECT spatial_sort_key(3, 7L) k").first().k == 7 << 34


def test_a_view_with_functions_prunes_by_declination(spark, sky, tmp_path):
    cat = CatalogBuilder(spark, "sky", source=sky, id_kw="id", order_k=4, threshold=200, margin=None, location=str(tmp_path)).build()
    cat.view("sky_view")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW sky_cone AS SELECT id, sky_distance(ra, dec, 30, 10) AS d FROM sky_view WHERE in_cone(ra, dec, 30, 10, 8)")
    df = spark.table("sky_cone")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dec,2.0)" in plan and "LessThanOrEqual(dec,18.0)" in plan
    assert {r.id for r in df.collect()} == {r.id for r in cat.cone_search(30, 10, 8).collect()}
