import numpy as np
import pytest

from heliograph.operators import local_match as lm
from heliograph.operators.margin import degrees_apart
from heliograph.plans.builder import CatalogBuilder


@pytest.mark.parametrize("distance", [0.002, 0.5, 7.0, 95.0])
def test_zones(distance, monkeypatch):
    monkeypatch.setattr(lm, "PAIRS", 700)
    rng = np.random.default_rng(5)
    ra, dec = rng.uniform(-20, 380, 400), np.degrees(np.arcsin(rng.uniform(-1, 1, 400)))
    ra[:60], dec[:60] = rng.normal(0, 0.3, 60), 90 - np.abs(rng.normal(0, 0.3, 60))
    ra[60:120], dec[60:120] = rng.normal(0, 0.002, 60), rng.normal(0, 0.002, 60)
    dec[120:123], ra[123:126], dec[123:126] = [90, -90, -90], [0, 360, 720], 5
    rank = rng.integers(0, 5, 400)
    a, d = np.r_[ra[::2] + 1e-4, 0.0, 359.999], np.r_[dec[::2], 5.0, 0.0]
    want = []
    for i in range(len(a)):
        away = degrees_apart(a[i], d[i], ra, dec)
        near = np.flatnonzero(away < distance)
        want += [(i, away[j], rank[j]) for j in near[np.lexsort((rank[near], away[near]))][:3]]
    got = [(i, w, rank[j]) for who, at, away in lm.Zones(ra, dec, rank, distance).nearest(a, d, 3) for i, j, w in zip(who, at, away)]
    assert got == want and want


def test_pairs_of():
    one, two = [(0, 0), (1, 5), (2, 40), (1, 20)], [(1, 0), (1, 1), (1, 2), (1, 3), (2, 20), (1, 10), (3, 1000)]
    pairs, uncovered = lm.pairs_of(one, two)
    assert sorted(pairs) == [((0, 0), (1, k)) for k in range(4)] + [((1, 5), (2, 20)), ((2, 40), (1, 10))]
    assert uncovered == [(1, 5), (1, 20)]
    assert lm.tiles_of(((3, 9), (1, 0)), (10, 10)) == [(3, 9)]
    assert lm.tiles_of(((3, 9), (3, 9)), (lm.SPLIT_ROWS * 4, 1)) == [(4, 36 + k) for k in range(4)]


def rows_of(n, seed, south=True):
    rng = np.random.default_rng(seed)
    ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1 if south else 0.2, 1, n)))
    ra[: n // 2], dec[: n // 2] = 50 + rng.normal(0, 2, n // 2), 20 + rng.normal(0, 2, n // 2)
    return [(f"k{i:04d}", float(a), float(d), None if i % 5 == 0 else i % 7) for i, (a, d) in enumerate(zip(ra, dec))]


@pytest.mark.parametrize("split_rows, south", [(2_000_000, True), (15, True), (2_000_000, False)])
def test_local_match(spark, tmp_path, monkeypatch, split_rows, south):
    monkeypatch.setattr(lm, "SPLIT_ROWS", split_rows)
    one, two = rows_of(400, 1), rows_of(700, 2, south)
    cats = [CatalogBuilder(spark, name, source=spark.createDataFrame(r, "source_id string, ra double, dec double, mag int"), order_k=6, threshold=t, margin=0.8, location=str(tmp_path)).build() for name, r, t in (("one", one, 60), ("two", two, 40))]
    found = cats[0].cross_match(cats[1], ["mag"], ["mag"], 3, 0.7, evaluate_margins="local")
    same = cats[0].cross_match(cats[1], ["mag"], ["mag"], 3, 0.7)
    assert found.columns == same.columns and [f.dataType for f in found.schema] == [f.dataType for f in same.schema]
    keys = ("one.source_id", "two.source_id", "one.mag", "two.mag")
    rounded = lambda df: sorted((*[str(r[k]) for k in keys], round(r["_DIST"], 9)) for r in df.collect())
    assert rounded(found) == rounded(same) and len(rounded(found)) > 100
    with pytest.raises(ValueError, match="margin"):
        cats[0].cross_match(cats[1], n_neighbors=1, dthresh=0.9, evaluate_margins="local")


def test_no_shuffle(spark, tmp_path):
    """Catalogues that cover the same sky: no exchange at all."""
    rows = rows_of(600, 3)
    cats = [CatalogBuilder(spark, name, source=spark.createDataFrame(rows, "source_id string, ra double, dec double, mag int"), order_k=2, threshold=300, margin=0.8, location=str(tmp_path)).build() for name in ("one", "two")]
    found = cats[0].cross_match(cats[1], ["mag"], ["mag"], 1, 0.5, evaluate_margins="local")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["one.source_id"] == r["two.source_id"] and r["_DIST"] == 0 for r in found.collect()} == {True} and found.count() == 600
    empty = CatalogBuilder(spark, "none", source=spark.createDataFrame([], "source_id string, ra double, dec double, mag int"), order_k=2, margin=0.8, location=str(tmp_path)).build()
    assert empty.cross_match(cats[0], n_neighbors=1, dthresh=0.5, evaluate_margins="local").count() == 0
    assert cats[0].cross_match(empty, n_neighbors=1, dthresh=0.5, evaluate_margins="local").count() == 0
