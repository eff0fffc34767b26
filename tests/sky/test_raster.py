import numpy as np
import pytest

from heliograph.functions import healpix as hp
from heliograph.operators import raster
from heliograph.plans.builder import CatalogBuilder


def test_points_are_of_equal_area(spark):
    rows = raster.points(spark, 240, 120).toPandas()
    assert len(rows) == pytest.approx(240 * 120 * np.pi / 4, rel=0.01)
    # projected forward by Newton steps they are where they came from
    lat, t = np.radians(rows["dec"]), np.radians(rows["dec"])
    for _ in range(200):
        t = t - (2 * t + np.sin(2 * t) - np.pi * np.sin(lat)) / np.maximum(2 + 2 * np.cos(2 * t), 1e-9)
    x = -((rows["ra"] + 180) % 360 - 180) / 180 * np.cos(t)
    assert np.abs((x + 1) * 120 - 0.5 - rows["i"]).max() < 1e-3 and np.abs((1 - np.sin(t)) * 60 - 0.5 - rows["j"]).max() < 1e-3
    n = np.bincount(hp.ang2pix(1, rows["ra"], rows["dec"]), minlength=48)
    assert n.min() > 0.85 * n.mean() and n.max() < 1.15 * n.mean()
    with pytest.raises(ValueError):
        raster.points(spark, 0, 5)


def test_maps_of_a_catalogue(spark, tmp_path):
    rows = [(i, 40.0 + i % 10, 20.0 + i % 7) for i in range(200)] + [(999, 220.0, -60.0)]
    build = lambda name, r: CatalogBuilder(spark, name, source=spark.createDataFrame(r, "source_id bigint, ra double, dec double"), order_k=4, threshold=50, margin=None, allow_overflow=True, location=str(tmp_path)).build()
    cat = build("c", rows)
    sources, parts = (raster.picture(m, 80, 40) for m in (cat.map_sources(80, 40), cat.map_partitions(80, 40)))
    at = {(r.j, r.i): (r.ra, r.dec) for r in raster.points(spark, 80, 40).collect()}
    counts = {r.pix: r.n for r in cat.density().collect()}
    for (j, i), (ra, dec) in at.items():
        pix = int(hp.ang2pix(4, ra, dec))
        assert sources[j, i] == pytest.approx(np.log10(counts.get(pix, 0) + 1))
        assert parts[j, i] == max([o for o in cat.hips if pix >> 2 * (4 - o) in cat.hips[o]], default=-1)
    assert np.isnan(sources[0, 0]) and np.isnan(sources).sum() == 3200 - len(at)
    cone = {(r.j, r.i): r for r in cat.map_cone_search(220.0, -60.0, 15.0, 80, 40).collect()}
    inside = {k for k, r in cone.items() if r.in_cone}
    assert inside and all(cone[k].value == pytest.approx(np.log10(max(counts.values()) + 1) + 1) for k in inside)
    assert inside == {k for k, (a, d) in at.items() if int(hp.ang2pix(4, a, d)) in set(hp.query_disc(4, 220.0, -60.0, 15.0).tolist())}
    empty = build("e", rows[:0])
    assert {r.value for r in empty.map_sources(20, 10).collect()} == {0} and {r.value for r in empty.map_partitions(20, 10).collect()} == {-1}
    assert {r.value for r in empty.map_cone_search(0.0, 0.0, 40.0, 20, 10).collect()} == {0, 1}
