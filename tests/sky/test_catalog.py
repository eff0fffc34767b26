import json
import math
import pathlib
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.operators import columns as co
from heliograph.operators import crossmatch as xm
from heliograph.operators import partitioning as pt
from heliograph.plans.builder import CatalogBuilder, LostRows
from heliograph.plans.catalog import Catalog, read_paths
from heliograph.sources import fits, readers, storage
from heliograph.streaming.cone import stream_cone, stream_density


def dist(a, b):
    (r1, d1), (r2, d2) = np.radians(a), np.radians(b)
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


def sky(n, seed, crowd=False):
    rng = np.random.default_rng(seed)
    ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    if crowd:
        ra[: n // 2], dec[: n // 2] = 50 + rng.normal(0, 1, n // 2), 20 + rng.normal(0, 1, n // 2)
    ra[:6], dec[:6] = [0.0004, 359.9996, 10, 200, 50, 50], [0, 0, 89.9999, 89.9999, -90, 20]
    return [(i, float(a), float(d), float(i % 7)) for i, (a, d) in enumerate(zip(ra, dec))]


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sky"))
    rows = {"one": sky(300, 1, True), "two": sky(500, 2, True)}
    cats = {}
    for name, r in rows.items():
        df = spark.createDataFrame(r, "source_id bigint, ra double, dec double, mag double")
        cats[name] = CatalogBuilder(spark, name, source=df, order_k=8, threshold=40, margin=1.0, location=where).build()
    return cats, rows


def test_partitions(two, spark):
    cats, rows = two
    cat = cats["one"]
    parts = {(r.Norder, r.Npix): r.n for r in cat.partitions().collect()}
    loaded = cat.load().collect()
    assert sorted(r.source_id for r in loaded) == list(range(300)) and len({r._ID for r in loaded}) == 300
    assert sum(parts.values()) == 300 == len(cat) and max(parts.values()) < 40 and len({o for o, _ in parts}) > 1
    for r in loaded:
        assert (r.Norder, r.Npix) in parts and hp.ang2pix(r.Norder, r.ra, r.dec).item() == r.Npix and r.Dir == r.Npix // 10000 * 10000
        assert r._ID >> 31 == hp.ang2pix(14, r.ra, r.dec).item()
    for o, p in parts:
        if o:
            assert sum(hp.ang2pix(o - 1, r.ra, r.dec).item() == p >> 2 for r in loaded) >= 40
    meta = json.loads(storage.read_text(spark, f"{cat.root}/one_meta.json"))
    assert {(int(o), p) for o, ps in meta["hips"].items() for p in ps} == set(parts) and meta["n_sources"] == 300
    assert (repr(cat), str(cat)) == ("Catalog(one)", "Catalog: one")


@pytest.mark.parametrize("cone", [(50.0, 20.0, 2.0), (0, 0, 0.001), (0.0, 90.0, 5.0), (359.9, -45.0, 30.0), (10.0, 10.0, 200.0), (120.0, 60.0, 1e-9)])
def test_cone(two, cone):
    cats, rows = two
    got = cats["one"].cone_search(*cone, columns=["mag"])
    assert got.columns == ["mag", "ra", "dec", "source_id", "_DIST"]
    want = {i for i, a, d, _ in rows["one"] if dist((a, d), cone[:2]) < cone[2]}
    assert {r.source_id for r in got.collect()} == want


def test_cone_prunes_partitions(two):
    plan = two[0]["one"].cone_search(50.0, 20.0, 0.5)._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan") :]
    assert "PartitionFilters: [" in scan and "Npix" in scan[scan.index("PartitionFilters") :] and "PushedFilters: [" in scan


def test_cone_arguments(two):
    cat = two[0]["one"]
    with pytest.raises(TypeError):
        cat.cone_search("1", 2, 3)
    wanted = ["mag"]
    cat.cone_search(1, 2, 3, wanted)
    assert wanted == ["mag"] and cat.cone_search(1, 2, 3, []).columns == ["source_id", "ra", "dec", "mag", "_DIST"]


def nearest(one, two_, n, limit):
    out = set()
    for i, a, d, _ in one:
        near = sorted((dist((a, d), (x, y)), j) for j, x, y, _ in two_ if dist((a, d), (x, y)) < limit)
        out |= {(i, j) for _, j in near[:n]}
    return out


@pytest.mark.parametrize("n,limit", [(1, 0.5), (3, 2.0), (600, 0.3), (2, 25.0), (1, 40.0), (5, 170.0)])
def test_cross_match(two, n, limit):
    cats, rows = two
    got = cats["one"].cross_match(cats["two"], ["mag"], ["mag"], n, limit)
    assert got.columns == ["one.mag", "one.ra", "one.dec", "one.source_id", "two.mag", "two.ra", "two.dec", "two.source_id", "hips_k", "hips_pix", "_DIST"]
    assert {(r["one.source_id"], r["two.source_id"]) for r in got.collect()} == nearest(rows["one"], rows["two"], n, limit)


def test_cross_match_without_margins(two):
    cats, rows = two
    part = {n: {r.source_id: (r.Norder, r.Npix) for r in c.load().collect()} for n, c in cats.items()}

    def inside(i, j):
        (o, p), (q, s) = part["one"][i], part["two"][j]
        return p >> 2 * max(0, o - q) == s >> 2 * max(0, q - o)

    want = set()
    for row in rows["one"]:
        want |= nearest([row], [r for r in rows["two"] if inside(row[0], r[0])], 1, 1.0)
    got = cats["one"].cross_match(cats["two"], ["mag"], ["mag"], 1, 1.0, evaluate_margins=False)
    rows_ = got.collect()
    assert {(r["one.source_id"], r["two.source_id"]) for r in rows_} == want
    for r in rows_:
        finer = max(part["one"][r["one.source_id"]], part["two"][r["two.source_id"]], key=lambda x: x[0])
        assert r.hips_k == finer[0]


@pytest.mark.parametrize("n,limit", [(1, 0.5), (3, 1.0)])
def test_cross_match_by_margin_tree(two, n, limit):
    cats, rows = two
    got = cats["one"].cross_match(cats["two"], ["mag"], ["mag"], n, limit, evaluate_margins="tree")
    assert {(r["one.source_id"], r["two.source_id"]) for r in got.collect()} == nearest(rows["one"], rows["two"], n, limit)
    with pytest.raises(ValueError, match="margin"):
        cats["one"].cross_match(cats["two"], n_neighbors=1, dthresh=1.5, evaluate_margins="tree")


def test_cells_in_reach_hold_every_near_row(spark):
    """Rows near borders of cells, at poles and at the seam; few copies elsewhere."""
    rows = [(i, a, d) for i, (a, d) in enumerate((a, d) for a in (0.0, 0.01, 359.99, 12.3, 90.0, 179.999, 270.4) for d in (-90.0, -89.95, -60.0, -0.01, 0.0, 0.31, 45.0, 89.8, 90.0))]
    df = spark.createDataFrame(rows, "id bigint, ra double, dec double")
    other = df.toDF("id2", "ra2", "dec2")
    got = xm.cross_match(df, other.selectExpr("id2", "pmod(ra2 + 0.02, 360) AS ra2", "greatest(-90, least(90, dec2 - 0.03)) AS dec2"), 99, 0.1, "id", "id2", coords=(("ra", "dec"), ("ra2", "dec2")))
    want = {(i, j) for i, a, d in rows for j, x, y in rows if dist((a, d), ((x + 0.02) % 360, max(-90, min(90, y - 0.03)))) < 0.1}
    assert {(r.id, r.id2) for r in got.collect()} == want
    many = spark.range(20000).selectExpr("id AS id2", "pmod(id * 0.5698402909980532D, 1D) * 360 AS ra2", "degrees(asin(2 * pmod(id * 0.7548776662466927D, 1D) - 1)) AS dec2")
    assert xm.with_cells_in_reach(many, xm.zone_height(0.4), 0.1, "ra2", "dec2").count() < 2.6 * 20000


def test_cross_match_arguments(two, spark):
    one = two[0]["one"]
    with pytest.raises(TypeError):
        one.cross_match(None)
    with pytest.raises(ValueError):
        one.cross_match(one)
    with pytest.raises(ValueError):
        one.cross_match(two[0]["two"], n_neighbors=0)
    assert xm.n_zones(xm.zone_height(200)) == 1 and xm.n_zones(xm.zone_height(0)) * 360 / xm.LEAST_HEIGHT < 2**63 and 360 / xm.LEAST_HEIGHT < xm.BINS
    with pytest.raises(FileNotFoundError):
        Catalog(spark, "none", one.location)


def test_margin(two):
    cats, rows = two
    cat = cats["two"]
    parts = [(r.Norder, r.Npix) for r in cat.partitions().collect()]
    own = {r.source_id: (r.Norder, r.Npix) for r in cat.load().collect()}
    got = {(r.source_id, r.Norder, r.Npix) for r in cat.load(which="neighbor").collect()}
    least, most = set(), set()
    for o, p in parts:
        edge = hp.ang2vec(*hp.boundaries(o, p, 4000))
        for i, a, d, _ in rows["two"]:
            if own[i] != (o, p):
                away = math.degrees(2 * math.asin(min(1, np.linalg.norm(edge - hp.ang2vec(a, d), axis=-1).min() / 2)))
                if away <= 1 - 1e-5:
                    least.add((i, o, p))
                if away <= 1 + 1e-5:
                    most.add((i, o, p))
    assert least and least <= got <= most
    assert cat.load(which="neighbor").columns == cat.load().columns or set(cat.load(which="neighbor").columns) == set(cat.load().columns)


def test_distance_from_a_border_is_exact():
    """Against fine sampling, about corners and a pole too."""
    from heliograph.operators import margin as mg

    rng = np.random.default_rng(3)
    for order, pix in ((0, 0), (0, 5), (1, 3), (2, 0), (2, 15), (3, 700)):
        u = rng.uniform(0, 4, 200)
        ra, dec = mg.border_at(order, np.full(200, pix), u)
        a, d = ra + rng.normal(size=200) * 0.3, np.clip(dec + rng.normal(size=200) * 0.3, -90, 90)
        step = 1 / 64
        at = np.floor(u / step) * step
        got = mg.least_distance(order, np.full(200, pix), a, d, at, at + step)
        fine = np.min([mg.degrees_apart(a, d, *mg.border_at(order, np.full(200, pix), at + step * k / 4000)) for k in range(4001)], axis=0)
        assert (got <= fine + 1e-9).all() and (fine - got).max() < 1e-4


def test_maps(two):
    cats, _ = two
    cat = cats["one"]
    assert sum(r.n for r in cat.visualize_sources().collect()) == 300
    cover = cat.visualize_partitions()
    assert cover.count() == cover.select("pix").distinct().count()
    assert cat.visualize_cone_search(50, 20, 3).where("in_cone").count() > 0
    pairs = cat.visualize_cross_match(cats["two"])
    a = {(r.Norder, r.Npix) for r in cat.partitions().collect()}
    b = {(r.Norder, r.Npix) for r in cats["two"].partitions().collect()}
    want = {(*x, *y) for x in a for y in b if x[1] >> 2 * max(0, x[0] - y[0]) == y[1] >> 2 * max(0, y[0] - x[0])}
    assert {(r.o1, r.p1, r.o2, r.p2) for r in pairs.collect()} == want


def test_bad_coordinates_and_thresholds(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 1.0, 91.0), (5, 1.0, 1.0)], "source_id bigint, ra double, dec double")
    with pytest.raises(pt.BadCoordinates, match="3 rows"):
        CatalogBuilder(spark, "x", source=df, location=str(tmp_path))
    make = lambda **k: CatalogBuilder(spark, "x", source=df, location=str(tmp_path), on_bad_coords="drop", order_k=3, margin=0.5, **k)
    with pytest.raises(ValueError, match="higher order"):
        make(threshold=2).build()
    cat = make(threshold=2, allow_overflow=True).build()
    assert sorted(r.source_id for r in cat.load().collect()) == [1, 5] and len({r._ID for r in cat.load().collect()}) == 2
    assert cat.load(which="neighbor").count() == 0
    assert make(threshold=3).build().hips.keys() == {0}
    with pytest.raises(ValueError):
        CatalogBuilder(spark, "x", ["f"], fmt="xlsx")
    empty = CatalogBuilder(spark, "e", source=df.limit(0), location=str(tmp_path)).build()
    assert empty.load().count() == 0 and empty.cone_search(1, 1, 1).count() == 0


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.x.csv").write_text("# c1\n# c2\nra,dec,id,flag\n1,2,3,t\n4,5,6,u\n")
    (tmp_path / "a.y.csv").write_text("# c1\n# c2\nra,dec,id,flag\n7,8,9,v\n")
    paths = [str(tmp_path / n) for n in ("a.x.csv", "a.y.csv")]
    df = readers.read_source(spark, paths, "csv", skiprows=[0, 1], dtypes={"id": "unicode", "ra": "f8"})
    assert sorted(map(tuple, df.collect())) == [(1.0, 2, "3", "t"), (4.0, 5, "6", "u"), (7.0, 8, "9", "v")]
    (tmp_path / "n.csv").write_text("5,a,1.5,2.5\n6,b,3.5,4.5\n")
    cat = CatalogBuilder(spark, "pos", [str(tmp_path / "n.csv")], header=False, ra_kw=2, dec_kw=3, id_kw=0, order_k=2, margin=None, location=str(tmp_path)).build()
    assert cat.meta["ra_kw"] == "_c2" and cat.cone_search(1.5, 2.5, 0.1).collect()[0]["_c0"] == 5
    with pytest.raises(ValueError):
        readers.read_source(spark, paths, "json")
    with pytest.raises(ValueError):
        co.resolve(df, 9)


def card(k, v):
    return f"{k:<8}= {v:>20}".ljust(80)


def test_fits_source(spark, tmp_path):
    rows = [(1.5, -2.5, 7, b"abc", True, 3), (4.25, 80.0, -1, b"de", False, 9)]
    body = b"".join(struct.pack(">ddq4s1si", a, b, c, s, b"T" if f else b"F", k) for a, b, c, s, f, k in rows)
    pad = lambda s: s.ljust(-(-len(s) // 2880) * 2880)
    forms = ["1D", "D", "K", "4A", "L", "J"]
    head = [card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), "END"]
    cols = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", len(body) // 2), card("NAXIS2", "2"), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", "6")]
    for i, (n, f) in enumerate(zip(("RA", "DEC", "ID", "NAME", "OK", "N"), forms), 1):
        cols += [card(f"TTYPE{i}", f"'{n}'"), card(f"TFORM{i}", f"'{f}'")]
    cols += [card("TSCAL6", "0.5"), card("TZERO6", "1"), card("TNULL6", "9"), "END"]
    data = pad("".join(c.ljust(80) for c in head)).encode() + pad("".join(c.ljust(80) for c in cols)).encode() + body.ljust(2880, b"\0")
    (tmp_path / "t.fits").write_bytes(data)
    got = readers.read_source(spark, [str(tmp_path / "t.fits")], "fits")
    assert got.columns == ["RA", "DEC", "ID", "NAME", "OK", "N"]
    assert sorted(map(tuple, got.collect())) == [(1.5, -2.5, 7, "abc", True, 2.5), (4.25, 80.0, -1, "de", False, None)]
    with pytest.raises(ValueError):
        fits.table(pad("".join(c.ljust(80) for c in head)).encode())


def test_listing_and_paths(spark, tmp_path):
    page = '<a href="x.csv.gz">x</a><a>n</a><A HREF="sub/y.csv.gz">y</A><a href="z.html">z</a>'
    assert readers.links_in(page, "http://h/d", "csv.gz") == ["http://h/d/x.csv.gz", "http://h/d/sub/y.csv.gz"]
    (tmp_path / "i.html").write_text(page)
    assert len(readers.list_sources(f"file://{tmp_path}/i.html", "csv.gz")) == 2
    for o, p in ((0, 5), (7, 123456)):
        assert storage.partition_of(f"c/{storage.directory_of(o, p)}/part-0.parquet") == (o, p)
    with pytest.raises(ValueError):
        storage.partition_of("c/part-0.parquet")
    with pytest.raises(ValueError):
        storage.set_storage_options(spark, "abfss://c@a.dfs.core.windows.net/x", {"account_name": "a"})


def test_density_is_used_again_only_for_the_same_inputs(spark, tmp_path):
    path = f"{tmp_path}/s"
    rows = lambda n: spark.createDataFrame([(i, float(i), 0.0) for i in range(n)], "source_id bigint, ra double, dec double")
    make = lambda: CatalogBuilder(spark, "c", [path], "parquet", order_k=2, margin=None, location=str(tmp_path))
    rows(5).write.parquet(path)
    assert make().build().meta["n_sources"] == 5
    assert make().density().agg(F.sum("n")).first()[0] == 5
    rows(8).write.mode("overwrite").parquet(path)
    assert len(make().build()) == 8


def test_rebuilds_with_other_orders_keep_all_rows(spark, tmp_path):
    path = f"{tmp_path}/s"
    spark.createDataFrame(sky(500, 4, True), "source_id bigint, ra double, dec double, mag double").write.parquet(path)
    for order in (5, 4, 5):
        cat = CatalogBuilder(spark, "c", [path], "parquet", order_k=order, threshold=60, margin=None, location=str(tmp_path), allow_overflow=True).build()
        assert cat.load().count() == 500 == len(cat) and cat.density().agg(F.sum("n")).first()[0] == 500


def test_lost_rows_are_noticed(spark, tmp_path):
    df = spark.createDataFrame(sky(50, 4), "source_id bigint, ra double, dec double, mag double")
    b = CatalogBuilder(spark, "c", source=df, order_k=3, margin=None, location=str(tmp_path))
    b.density()
    b.rows = b.rows.where("source_id > 3")
    with pytest.raises(LostRows):
        b.build()


def test_sources_are_parsed_once(spark, tmp_path):
    (tmp_path / "s.csv").write_text("source_id,ra,dec\n1,2.5,3\n2,4.5,5\n")
    make = lambda **k: CatalogBuilder(spark, "c", [str(tmp_path / "s.csv")], order_k=2, margin=None, location=str(tmp_path), **k)
    b = make()
    assert "parquet" in b.source._jdf.queryExecution().toString() and len(b.build()) == 2
    (tmp_path / "s.csv").write_text("source_id,ra,dec\n1,2.5,3\n2,4.5,5\n3,6.5,7\n")
    assert len(make().build()) == 3 and len(make(cache=False).build()) == 3


def test_one_shuffle_for_ids_and_layout(spark, tmp_path):
    df = spark.createDataFrame(sky(300, 1, True), "source_id bigint, ra double, dec double, mag double")
    parts = pt.partition_map(pt.density(df, 6, "ra", "dec"), 6, 40, True)
    parts.write.parquet(f"{tmp_path}/p")
    parts = spark.read.parquet(f"{tmp_path}/p")
    rows = pt.with_spatial_id(pt.in_partitions(df, parts, 50, [0, 1, 2, 3, 4, 5, 6], 6, "ra", "dec"), "ra", "dec", "source_id", within=["Norder", "Npix"])
    rows = rows.repartition("Norder", "Npix").sortWithinPartitions("Norder", "Npix", "_ID")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_summaries_paths_and_partitions(spark, tmp_path):
    df = spark.createDataFrame(sky(300, 1, True), "source_id bigint, ra double, dec double, mag double")
    with pytest.warns(UserWarning, match="smaller"):
        cat = CatalogBuilder(spark, "c", source=df, order_k=8, threshold=40, margin=1.0, location=str(tmp_path), summaries=True).build()
    folder = pathlib.Path(cat.base)
    assert (folder / "catalog/_metadata").exists() and (folder / "catalog/_common_metadata").exists()
    some = [(o, p) for o, pix in cat.hips.items() for p in pix][:3]
    got = cat.load(["source_id"], partitions=some)
    want = {r.source_id for r in cat.load().collect() if (r.Norder, r.Npix) in some}
    assert {r.source_id for r in got.collect()} == want
    paths = [f"{cat.base}/catalog/{storage.directory_of(*x)}" for x in some]
    assert {r.source_id for r in read_paths(spark, paths).collect()} == want and read_paths(spark, paths[0], ["Norder", "source_id"]).columns == ["Norder", "source_id"]
    with pytest.raises(ValueError):
        read_paths(spark, [paths[0], paths[1].replace("/catalog/", "/neighbor/")])


def test_streams(spark, tmp_path):
    schema = "ts timestamp, ra double, dec double"
    spark.createDataFrame([("2024-01-01 00:00:10", 10.0, 10.0), ("2024-01-01 00:00:20", 200.0, 10.0), ("2024-01-01 01:00:00", 10.01, 10.0)], "ts string, ra double, dec double").selectExpr("timestamp(ts) ts", "ra", "dec").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for df, mode, n in ((stream_cone(stream, 10.0, 10.0, 1.0), "append", 2), (stream_density(stream, 3, "ts", "10 minutes", "5 minutes"), "complete", 3)):
        name = "t" + uuid.uuid4().hex
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n


def test_columns_named_like_inner_values(spark, tmp_path):
    rows = [(i, float(i), float(i), 7.0 * i, "z") for i in range(40)]
    df = spark.createDataFrame(rows, "source_id bigint, ra double, dec double, hp_z double, __z string")
    make = lambda name: CatalogBuilder(spark, name, source=df, order_k=3, threshold=30, margin=None, location=str(tmp_path), allow_overflow=True).build()
    one, two_ = make("one"), make("two")
    assert {(r.source_id, r.hp_z, r["__z"]) for r in one.load().collect()} == {(i, 7.0 * i, "z") for i in range(40)}
    got = one.cross_match(two_, None, None, 1, 0.5).collect()
    assert len(got) == 40 and all(r["one.hp_z"] == r["two.hp_z"] for r in got)
    with pytest.raises(ValueError, match="_DIST"):
        from heliograph.operators.cone import cone

        cone(df.withColumnRenamed("hp_z", "_dist"), 1.0, 1.0, 1.0)
