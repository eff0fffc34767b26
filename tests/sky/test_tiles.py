import numpy as np
import pytest

from heliograph.functions import healpix as hp
from heliograph.operators import partitioning as pt
from heliograph.operators import tiles as ti
from heliograph.plans.builder import CatalogBuilder

FINE = 2 * (ti.ID_ORDER - 6)


def coverage(spark, pixels, order=6):
    return ti.tile_ranges(spark.createDataFrame([(order, int(p)) for p in pixels], "t_order int, t_pix bigint"))


def pixels_of(cov):
    found = []
    for lo, hi in cov.collect():
        assert lo % (1 << FINE) == hi % (1 << FINE) == 0 and lo >> ti.CHUNK_BITS == (hi - 1) >> ti.CHUNK_BITS
        found += range(lo >> FINE, hi >> FINE)
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("a, b", [(0.3, 0.3), (0.0, 0.5), (0.5, 0.0), (1.0, 0.2), (0.0, 0.0)])
def test_algebra(spark, a, b):
    rng = np.random.default_rng(1)
    one, two = (set(np.flatnonzero(rng.random(hp.order2npix(6)) < s).tolist()) for s in (a, b))
    x, y = coverage(spark, list(one) * 2), coverage(spark, two)
    assert pixels_of(ti.union(x, y)) == one | two
    assert pixels_of(ti.intersection(x, y)) == one & two
    assert pixels_of(ti.difference(x, y)) == one - two
    flat = ti.union(x).orderBy("lo").collect()
    assert all(p.hi < q.lo or p.hi >> ti.CHUNK_BITS == q.lo >> ti.CHUNK_BITS and q.lo % (1 << ti.CHUNK_BITS) == 0 for p, q in zip(flat, flat[1:]))
    assert ti.area(ti.union(x)).first().area == pytest.approx(len(one) * hp.pixel_area(6))


def test_tiles_of_are_fewest(spark):
    rng = np.random.default_rng(2)
    fine = sorted(set(rng.integers(0, 4**9 * 3, 3000).tolist()) | set(range(70_000, 70_000 + 4**7)) | set(range(4**9, 2 * 4**9)))
    cov = ti.union(coverage(spark, fine, ti.ID_ORDER))
    tiles = {(r.Norder, r.Npix) for r in ti.tiles_of(cov).collect()}
    assert sorted(p for o, q in tiles for p in range(q << 2 * (14 - o), q + 1 << 2 * (14 - o))) == fine
    assert (5, 1) in tiles  # a whole chunk
    for o, q in tiles:  # four siblings would be one tile of the order above
        assert o == 5 or not all((o, (q & ~3) + k) in tiles for k in range(4))


def test_disc_tiles():
    rng = np.random.default_rng(3)
    ra, dec = rng.uniform(0, 360, 40), np.degrees(np.arcsin(rng.uniform(-1, 1, 40)))
    ra[:3], dec[:3] = [0, 10, 359.99], [90, -90, 0]
    radius = rng.uniform(0, 40, 40)
    radius[3:6] = [0, 180, 0.01]
    who, o, pix, inside = hp.disc_tiles(ra, dec, radius, np.full(40, 5))
    for k in range(40):
        got = [p for q, c in zip(o[who == k], pix[who == k]) for p in range(c << 2 * (5 - q), c + 1 << 2 * (5 - q))]
        assert sorted(got) == hp.query_disc(5, ra[k], dec[k], radius[k]).tolist()
    # all points of a disc are in its inclusive tiles, all points of an inside tile in the disc
    for k in range(40):
        turn, away = rng.uniform(0, 2 * np.pi, 300), np.radians(radius[k]) * np.sqrt(rng.uniform(0, 1, 300))
        d0 = np.radians(dec[k])
        d = np.arcsin(np.clip(np.sin(d0) * np.cos(away) + np.cos(d0) * np.sin(away) * np.cos(turn), -1, 1))
        a = np.radians(ra[k]) + np.arctan2(np.sin(turn) * np.sin(away) * np.cos(d0), np.cos(away) - np.sin(d0) * np.sin(d))
        held = ti.id_ranges(ra[k], dec[k], radius[k])
        assert 0 < len(held) <= ti.RANGES and all(x[1] < y[0] for x, y in zip(held, held[1:]))
        ids = hp.ang2pix(14, np.degrees(a) % 360, np.degrees(d)) << pt.RANK_BITS
        assert all(any(lo <= i < hi for lo, hi in held) for i in ids.tolist())
    corners = [hp.boundaries(int(q), int(p), 4) for q, p in zip(o[inside], pix[inside])]
    for k, (a, d) in zip(who[inside], corners):
        gap = np.degrees(2 * np.arcsin(np.linalg.norm(hp.ang2vec(a, d) - hp.ang2vec(ra[k], dec[k]), axis=-1) / 2))
        assert gap.max() <= radius[k] + 1e-9


def test_odd_cones(spark):
    rows = [(1, 0.0, 90.0, 1.0), (2, None, 0.0, 1.0), (3, 5.0, 0.0, None), (4, 5.0, 0.0, -1.0), (5, 5.0, 0.0, float("nan")), (6, 400.0, 0.0, 0.0), (7, 0.0, 91.0, 1.0), (8, -10.0, 0.0, 200.0)]
    cones = spark.createDataFrame(rows, "k int, a double, d double, r double")
    assert {r.k for r in ti.cone_tiles(cones, "a", "d", "r", inclusive=True).collect()} == {1, 6, 8}
    assert ti.cone_tiles(cones.limit(0), "a", "d", "r").count() == 0
    assert pixels_of(ti.union(ti.tile_ranges(ti.cone_tiles(cones.where("k = 8"), "a", "d", "r", 6)))) == set(range(hp.order2npix(6)))
    stars = spark.createDataFrame([(i, 36.0 * i, 10.0 * i - 50) for i in range(10)], "id int, ra double, dec double")
    found = ti.rows_of_cones(stars, cones, ti.tile_orders(cones, "r"), "ra", "dec", "a", "d", "r")
    assert sorted((r.k, r.id) for r in found.collect()) == [(8, i) for i in range(10)]
    assert ti.rows_of_cones(stars, cones.limit(0), ti.tile_orders(cones.limit(0), "r"), "ra", "dec", "a", "d", "r").count() == 0


def test_catalogue(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(rng.uniform(0, 360, 800), np.degrees(np.arcsin(rng.uniform(-1, 1, 800)))))]
    cat = CatalogBuilder(spark, "c", source=spark.createDataFrame(rows, "source_id bigint, ra double, dec double"), order_k=5, threshold=100, margin=None, location=str(tmp_path)).build()
    assert ti.rows_within(cat.load(), cat.coverage(), 10).count() == 800
    assert {int(r.lo) >> 18 for r in cat.coverage().collect()} == set(hp.ang2pix(5, [r[1] for r in rows], [r[2] for r in rows]).tolist())
    near = cat.cone_search(200.0, 10.0, 12.0)
    gap = lambda r: np.degrees(2 * np.arcsin(np.linalg.norm(hp.ang2vec(r[1], r[2]) - hp.ang2vec(200.0, 10.0)) / 2))
    assert {r.source_id for r in near.collect()} == {r[0] for r in rows if gap(r) < 12}
    plan = near._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "_ID,GreaterThanOrEqual" in pushed or "GreaterThanOrEqual(_ID" in pushed
