"""What must not grow with the tables faster than they do."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.operators import margin as mg
from heliograph.operators import partitioning as pt
from heliograph.operators import tiles as ti
from heliograph.plans.builder import CatalogBuilder
from heliograph.sources import fits


def test_tiles_of_margins_are_never_broadcast_by_their_looks(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS source_id", "(id * 137.5) % 360 AS ra", "(id * 61.8) % 178 - 89 AS dec")
    cat = CatalogBuilder(spark, "c", source=rows, order_k=4, threshold=100, margin=0.5, location=str(tmp_path)).build()
    got = sorted(map(tuple, cat.load(["source_id", "Norder", "Npix"], "neighbor").collect()))
    monkeypatch.setattr(pt, "BROADCAST_ROWS", 0)
    stage = lambda df, name: (df.write.mode("overwrite").parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    near = mg.margin_rows(cat.load(), cat.partitions(), sorted(cat.hips), 0.5, "ra", "dec", stage)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, near.select("source_id", "Norder", "Npix").collect())) == got and got


def test_near_a_border():
    """Against fine sampling, with margins narrower and wider than the pixel, about a pole and corners too."""
    rng = np.random.default_rng(5)
    for order, pix, margin in ((0, 4, 0.3), (1, 3, 1.0), (3, 0, 0.2), (3, 700, 9.0), (5, 1023, 0.5)):
        ra, dec = mg.border_at(order, np.full(300, pix), rng.uniform(0, 4, 300))
        a, d = ra + rng.normal(size=300) * margin, np.clip(dec + rng.normal(size=300) * margin, -90, 90)
        edge = hp.ang2vec(*hp.boundaries(order, pix, 3000))
        least = np.array([np.degrees(2 * np.arcsin(np.linalg.norm(edge - v, axis=-1).min() / 2)) for v in hp.ang2vec(a, d)])
        got = mg.near_border(order, np.full(300, pix), a, d, margin)
        sure = np.abs(least - margin) > 90 / (1 << order) / 3000
        assert (got == (least <= margin))[sure].all() and got.any() and not got.all()
        tiles = set(mg.border_tiles(order, pix, margin).tolist())
        shown = spark_free_pixels(mg.tile_order(order, margin), a, d)
        inside = spark_free_pixels(order, a, d) == pix
        assert {p for p, ok in zip(shown.tolist(), got & ~inside) if ok} <= tiles


def spark_free_pixels(order, ra, dec):
    """The nearest cell of those that may hold each position, by descent."""
    return np.array([next(int(p) for p in hp.query_disc(order, x, y, 0.0, inclusive=True) if inside(order, p, x, y)) for x, y in zip(ra, dec)])


def inside(order, pix, ra, dec):
    """Is the position in the pixel? By the plane that the scheme projects to."""
    z, t = np.sin(np.radians(dec)), ra % 360 / 90
    za, ns = abs(z), 1 << order
    x, y, f = (int(v) for v in hp.pix2xyf(order, pix))
    if za <= 2 / 3:
        jp, jm = np.floor(ns * (0.5 + t) - ns * z * 0.75), np.floor(ns * (0.5 + t) + ns * z * 0.75)
        fp, fm = int(jp // ns), int(jm // ns)
        face = (fp & 3) | 4 if fp == fm else fp & 3 if fp < fm else (fm & 3) + 8
        return (int(jm) & (ns - 1), ns - 1 - (int(jp) & (ns - 1)), face) == (x, y, f)
    q, s = int(min(3, t)), np.sqrt(3 * (1 - za))
    tp = t - q
    jp, jm = int(min(ns - 1, np.floor(ns * tp * s))), int(min(ns - 1, np.floor(ns * (1 - tp) * s)))
    return ((ns - 1 - jm, ns - 1 - jp, q) if z >= 0 else (jp, jm, q + 8)) == (x, y, f)


def test_ranges_of_crowded_pixels_do_not_grow_with_the_rows():
    """At 54 million rows and a threshold of 300 there were 90,000 ranges for the half of them in one pixel."""
    assert pt.range_rows(6000, 300) == 300
    for n in (10**5, 10**7, 54 * 10**6, 10**8):
        assert n / pt.range_rows(n, 300) <= 257
    assert pt.range_rows(10**12, 300) == pt.RANGE_ROWS


def test_partitions_that_a_task_can_rank_are_whole(spark, tmp_path, monkeypatch):
    """All pixels of the deepest order beyond the threshold: each is one file, without the way by ranges."""
    from heliograph.operators import local_match as lm

    monkeypatch.setattr(pt, "RANGES", 8)
    rows = spark.range(20_000).selectExpr("id AS source_id", "(id * 137.50776) % 360 AS ra", "degrees(asin(2 * ((id * 0.7548776662466927) % 1) - 1)) AS dec")
    cat = CatalogBuilder(spark, "c", source=rows, order_k=1, threshold=100, margin=None, location=str(tmp_path), allow_overflow=True).build()
    assert cat.partitions().agg(F.min("n")).first()[0] > 100 and len(cat.hips[1]) == 48
    files = lm.tree_files(spark, f"{cat.base}/catalog")
    assert len(files) == 48 and all(len(f) == 1 for f in files.values())
    want = pt.with_spatial_id(rows, "ra", "dec", "source_id").select("source_id", "_ID")
    assert sorted(map(tuple, cat.load(["source_id", "_ID"]).collect())) == sorted(map(tuple, want.collect()))


def test_nearest_of_many_within_a_wide_distance(spark):
    """Far more rows in reach than neighbours wanted: dense and sparse parts of the sky, copies at one place, ties by id."""
    from heliograph.operators import crossmatch as xm

    rng = np.random.default_rng(7)
    ra = np.r_[rng.uniform(0, 360, 600), 100 + rng.normal(size=1500), np.full(40, 250.0), rng.uniform(0, 360, 60)]
    dec = np.r_[np.degrees(np.arcsin(rng.uniform(-1, 1, 600))), 30 + rng.normal(size=1500), np.full(40, -20.0), np.where(np.arange(60) % 2, 89.9, -89.9)]
    two = spark.createDataFrame([(int(i), float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "id2 long, ra2 double, dec2 double")
    take = rng.permutation(len(ra))[:400]
    a1, d1 = (ra[take] + rng.normal(size=400)) % 360, np.clip(dec[take] + rng.normal(size=400), -89.7, 89.7)
    a1[:3], d1[:3] = 250.0, -20.0
    one = spark.createDataFrame([(int(i), float(a), float(d)) for i, (a, d) in enumerate(zip(a1, d1))], "id1 long, ra1 double, dec1 double")
    for n, distance in ((3, 20.0), (1, 6.0)):
        want = set()
        for i, (a, d) in enumerate(zip(a1, d1)):
            away = mg.degrees_apart(a, d, ra, dec)
            want |= {(i, int(j)) for j in np.lexsort((np.arange(len(ra)), away))[:n] if away[j] < distance}
        levels = xm.levels_of(one, two, n, distance, ("ra1", "dec1"), ("ra2", "dec2"))
        assert levels is not None and len(levels[1]) > 2
        got = xm.cross_match(one, two, n, distance, "id1", "id2")
        assert {(r.id1, r.id2) for r in got.select("id1", "id2").collect()} == want
    assert xm.levels_of(one, two, 1, 0.01, ("ra1", "dec1"), ("ra2", "dec2")) is None


def test_fits_files_from_tasks(spark, tmp_path):
    """Several files a task and tasks without rows, nulls, texts; no row goes by way of the driver."""
    df = spark.range(0, 5000, 1, 4).selectExpr("id", "IF(id % 7 = 0, NULL, id / 3) AS x", "IF(id % 5 = 0, NULL, CAST(id AS INT)) AS i", "repeat('a', CAST(id % 4 AS INT)) AS s").where("id < 2000 OR id > 3000")
    assert fits.write_fits_files(df, str(tmp_path / "t"), file_bytes=10_000) == df.count()
    names = sorted(f.name for f in (tmp_path / "t").iterdir())
    assert len(names) > 8 and all(n.startswith("part-") and n.endswith(".fits") for n in names)
    back = fits.read_fits(spark, [str(tmp_path / "t")])
    assert back.selectExpr("id", "nanvl(x, NULL) AS x", "i", "s").exceptAll(df).isEmpty()
    assert back.count() == df.count()
    with pytest.raises(FileExistsError):
        fits.write_fits_files(df, str(tmp_path / "t"))
    fits.write_fits_files(df.limit(0), str(tmp_path / "none"))
    assert fits.read_fits(spark, [str(tmp_path / "none")]).columns == df.columns and fits.read_fits(spark, [str(tmp_path / "none")]).count() == 0


def test_local_match_is_planned_without_matching(spark, tmp_path, monkeypatch):
    """The splits' schema costs no job on the rows, files are listed by tasks, and a task's reader holds no other task's split."""
    import pickle

    from heliograph.operators import crossmatch as xm
    from heliograph.operators import local_match as lm
    from heliograph.sources import storage

    rows = spark.range(3000).selectExpr("id AS source_id", "(id * 137.5) % 360 AS ra", "(id * 61.8) % 178 - 89 AS dec")
    one, two = (CatalogBuilder(spark, n, source=rows, order_k=4, threshold=100, margin=0.5, location=str(tmp_path)).build() for n in ("one", "two"))

    def never(*_):
        raise AssertionError

    monkeypatch.setattr(xm, "levels_of", never)
    monkeypatch.setattr(storage, "file_system", lambda s, p, f=storage.file_system: never() if p.endswith(("/catalog", "/neighbor")) and never_listed else f(s, p))
    never_listed = True
    assert len(lm.tree_files(spark, f"{one.base}/catalog")) == sum(map(len, one.hips.values()))
    never_listed = False
    found = one.cross_match(two, ["source_id"], ["source_id"], 1, 0.1, evaluate_margins="local", delim="_")
    assert found.where("one_source_id = two_source_id").count() == 3000
    reader = lm.LocalMatchReader({"splits": [[[0, 1], True, [], [], [0, 1]]], "n": 1}, found.schema)
    assert len(reader.partitions()) == 1 and pickle.loads(pickle.dumps(reader)).plan == {"n": 1}


def test_coordinates_are_checked_without_a_filter(spark):
    """A filter was pushed below the projection and made the coordinates anew for each condition, in every pass."""
    made = spark.range(100).selectExpr("id", "round(id * 3.1, 9) AS ra", "round(id * 0.5e0, 9) AS dec")
    assert "Filter" not in pt.checked(made, "ra", "dec")._jdf.queryExecution().optimizedPlan().toString()
    odd = made.selectExpr("id", "ra", "IF(id < 3, element_at(array(NULL, CAST('NaN' AS DOUBLE), 91e0), CAST(id AS INT) + 1), dec) AS dec")
    with pytest.raises(pt.BadCoordinates, match="^3 rows"):
        pt.checked(odd, "ra", "dec")
    assert pt.checked(odd, "ra", "dec", "drop").count() == 97


def test_cone_opens_its_partitions_and_trees_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    from heliograph.operators import cone as cn
    from heliograph.plans.catalog import read_tree
    from heliograph.sources import storage

    rows = spark.range(2000).selectExpr("id AS source_id", "(id * 137.50776e0) % 360 AS ra", "degrees(asin(2 * ((id * 0.7548776662466927e0) % 1) - 1)) AS dec")
    cat = CatalogBuilder(spark, "c", source=rows, order_k=4, threshold=100, margin=None, location=str(tmp_path)).build()
    near = cat.cone_search(56.0, 20.0, 10.0)
    assert 0 < len(near.inputFiles()) < len(cat.load().inputFiles()) / 2
    monkeypatch.setattr("heliograph.plans.catalog.FEW_PARTS", 0)
    want = sorted(r.source_id for r in cn.cone(rows, 56.0, 20.0, 10.0).collect())
    assert want and sorted(r.source_id for r in near.collect()) == want == sorted(r.source_id for r in cat.cone_search(56.0, 20.0, 10.0).collect())
    monkeypatch.setattr(storage, "LISTINGS", 3)
    name, sc = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(name, None)
    sc.setJobGroup("listing", "")
    assert read_tree(spark, f"{cat.base}/catalog").count() == 2000
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sorted(sc.statusTracker().getJobIdsForGroup("listing"))
    tasks = [sc.statusTracker().getStageInfo(s).numTasks for s in sc.statusTracker().getJobInfo(jobs[0]).stageIds]
    assert len(cat.load().inputFiles()) > 32 and tasks == [3] and spark.conf.get(name, None) == before


def test_tree_match_plans_no_second_match_of_what_is_covered(spark, tmp_path, monkeypatch):
    """No job on the rows, no lookup and one join while the other catalogue covers this one; where it doesn't, its rows are matched too."""
    from heliograph.operators import crossmatch as xm

    sky = "id AS source_id", "(id * 137.50776e0) % 360 AS ra", "degrees(asin(2 * ((id * 0.7548776662466927e0) % 1) - 1)) AS dec"
    rows = spark.range(4000).selectExpr(*sky)
    build = lambda name, df, threshold: CatalogBuilder(spark, name, source=df, order_k=4, threshold=threshold, margin=0.5, location=str(tmp_path)).build()
    one, two, mixed = build("one", rows, 150), build("two", rows.selectExpr("source_id", "ra + 0.2 AS ra", "dec"), 400), build("mixed", rows.where("dec > 20 OR dec > -20 AND source_id % 5 = 0"), 150)
    match = lambda other, how: one.cross_match(other, ["source_id"], ["source_id"], 2, 0.4, evaluate_margins=how, delim="_")
    assert len(two.hips) == 1 and len(mixed.hips) > 1
    want = {c.name: sorted((r.one_source_id, r[f"{c.name}_source_id"], r._DIST) for r in match(c, True).collect()) for c in (two, mixed)}
    got = lambda c: sorted((r.one_source_id, r[f"{c.name}_source_id"], r._DIST) for r in match(c, "tree").collect())
    assert all(len(w) > 1000 for w in want.values())
    assert got(mixed) == want["mixed"]

    def never(*_):
        raise AssertionError

    monkeypatch.setattr(xm, "levels_of", never)
    plan = match(two, "tree")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert got(two) == want["two"]


def shuffled_rows(df):
    """Rows written to shuffles by the last run of a table."""
    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        own = p.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(p.children().apply(k)) for k in range(p.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def brute_pairs(ra, dec, cones):
    stars = hp.ang2vec(ra, dec)
    away = [np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(stars - hp.ang2vec(a, d), axis=-1) / 2, 0, 1))) for _, a, d, _ in cones]
    return sorted((c[0], int(i)) for c, gap in zip(cones, away) for i in np.flatnonzero(gap < c[3]))


@pytest.mark.parametrize("radii, most", [((0.5, 1.0, 1.5, 2.0), 1), ((0.001, 0.3, 4.0, 25.0, 180.0), 7)])
def test_rows_of_cones_shuffle_a_row_once_and_cones_to_few_cells(spark, radii, most):
    rng = np.random.default_rng(11)
    ra, dec = rng.uniform(0, 360, 3000), np.degrees(np.arcsin(rng.uniform(-1, 1, 3000)))
    ra[:4], dec[:4] = [0, 359.9999, 17, 200], [3, 3, 90, -90]
    dec[4:300] = rng.uniform(88, 90, 296)  # crowded about a pole
    cones = [(k, float(ra[9 * k] if k % 2 else rng.uniform(0, 360)), float(dec[9 * k]), radii[k % len(radii)]) for k in range(200)]
    stars = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "id int, ra double, dec double")
    table = spark.createDataFrame(cones, "k int, a double, d double, r double")
    orders = ti.tile_orders(table, "r")
    found = ti.rows_of_cones(stars, table, orders, "ra", "dec", "a", "d", "r").select("k", "id")
    assert sorted(map(tuple, found.collect())) == brute_pairs(ra, dec, cones)
    assert len(orders) <= most
    if most == 1:
        assert 3000 + 200 <= shuffled_rows(found) <= 3000 + 10 * 200


def test_shuffles_of_a_build_go_after_it(spark, tmp_path):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    rows = spark.range(3000).selectExpr("id AS source_id", "(id * 137.5) % 360 AS ra", "(id * 61.8) % 178 - 89 AS dec")
    before = shuffles()
    CatalogBuilder(spark, "c", source=rows, order_k=3, threshold=100, margin=None, location=str(tmp_path)).build()
    for _ in range(20):  # they are removed in the background
        if not shuffles() - before:
            break
        time.sleep(0.5)
    assert not shuffles() - before
