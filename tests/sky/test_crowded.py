"""Pixels of the deepest order with far more rows than the threshold."""

from pyspark.sql import functions as F

from heliograph.operators import local_match as lm
from heliograph.operators import partitioning as pt
from heliograph.plans.builder import CatalogBuilder


def crowd(spark, n=6000):
    """Half of the rows in one spot, a fifth of all the very same row."""
    spot = F.col("id") % 2 == 0
    same = F.col("id") % 5 == 0
    rows = spark.range(n).select(F.when(same, -1).otherwise(F.col("id")).alias("source_id"), F.when(spot | same, F.when(same, 200.0).otherwise(200 + (F.col("id") % 7) * 1e-5)).otherwise((F.col("id") * 137.5) % 360).alias("ra"), F.when(spot | same, 30.0).otherwise((F.col("id") * 61.8) % 178 - 89).alias("dec"))
    return rows.repartition(7, "source_id")


def test_ids_and_files(spark, tmp_path):
    df = crowd(spark)
    cat = CatalogBuilder(spark, "c", source=df, order_k=5, threshold=300, margin=None, location=str(tmp_path), allow_overflow=True).build()
    got = sorted((r.source_id, r._ID) for r in cat.load(["source_id", "_ID"]).collect())
    want = sorted((r.source_id, r._ID) for r in pt.with_spatial_id(df, "ra", "dec", "source_id").select("source_id", "_ID").collect())
    assert got == want and len({i for _, i in got}) == 6000
    rows = {(r.Norder, r.Npix): r.n for r in cat.partitions().collect()}
    files = lm.tree_files(spark, f"{cat.base}/catalog")
    for part, n in rows.items():
        assert len(files[part]) == 1 if n < 300 else len(files[part]) >= n // 300 // 2
    biggest = cat.load().where("Norder = 5").groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0]
    assert max(rows.values()) > 3000 and biggest < 1500
    assert {tuple(r) for r in cat.load(["Norder", "Npix"]).distinct().collect()} == set(rows)
    assert cat.cone_search(200, 30, 0.01).count() == df.where("dec = 30").where(F.abs(F.col("ra") - 200) < 0.01).count()


def test_only_crowded_pixels(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("source_id"), F.lit(10.0).alias("ra"), F.lit(10.0).alias("dec"))
    cat = CatalogBuilder(spark, "c", source=df, order_k=3, threshold=100, margin=None, location=str(tmp_path), allow_overflow=True).build()
    ids = [r._ID for r in cat.load().orderBy("source_id").collect()]
    assert ids == list(range(ids[0], ids[0] + 1000)) and len(cat) == 1000


def test_matches_over_crowded_partitions(spark, tmp_path):
    where = str(tmp_path)
    one = CatalogBuilder(spark, "a", source=crowd(spark, 900).where("source_id >= 0"), order_k=3, threshold=200, margin=None, location=where, allow_overflow=True).build()
    two = CatalogBuilder(spark, "b", source=crowd(spark, 600).where("source_id >= 0"), order_k=2, threshold=150, margin=0.5, location=where, allow_overflow=True).build()
    found = [sorted((r["a.source_id"], r["b.source_id"]) for r in one.cross_match(two, n_neighbors=2, dthresh=0.2, evaluate_margins=how).collect()) for how in (True, "tree", "local")]
    assert found[0] == found[1] == found[2] and found[0]
