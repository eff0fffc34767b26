"""Binary tables both ways, by ranges of rows."""

import math

import numpy as np
import pytest

from heliograph.plans.builder import CatalogBuilder
from heliograph.sources import fits, readers
from tests.sky.test_sources import Server

SCHEMA = "i smallint, j int, k bigint, e float, d double, l boolean, `a name` string, v array<int>"


def rows(n):
    pick = lambda x, i, m: None if i % m == 0 else x
    return [(pick(i % 100, i, 7), pick(-i, i, 5), pick(i << 40, i, 3), pick(i / 4, i, 4), pick(i / 8, i, 6), pick(i % 2 == 0, i, 9), ("é" if i % 2 else "ab") * (i % 4), [i, None if i % 2 else -i, 2 * i]) for i in range(n)]


def plain(found):
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return [tuple(fix(v) for v in r) for r in found]


def test_what_is_written_is_read(spark, tmp_path):
    data = rows(500)
    df = spark.createDataFrame(data, SCHEMA).repartition(4).sort("k", "j", "d", "v")
    path = str(tmp_path / "t.fits")
    assert fits.write_fits(df, path, {"ORIGIN": "a 'test'"}) == 500
    raw = (tmp_path / "t.fits").read_bytes()
    own = fits.table(raw)
    assert len(raw) % 2880 == 0 and own.cards["ORIGIN"] == "a 'test'" and own.rows == 500
    for size in (1, 1000, 1 << 20):
        got = fits.read_fits(spark, [path], row_column="row", split_bytes=size) if size > 1 else readers.read_source(spark, path, "fits")
        assert sorted(map(repr, plain([tuple(r)[:8] for r in got.collect()]))) == sorted(map(repr, data))
    assert [r.k for r in got.sort("row").collect()] == [r.k for r in df.collect()]
    assert got.select("row").distinct().count() == 500
    some = fits.read_fits(spark, [path], ["l", "k"])
    assert some.columns == ["l", "k"] and some.count() == 500
    assert sorted(map(repr, plain(fits.whole_files(spark, [path]).collect()))) == sorted(map(repr, data))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t.fits"]
    with pytest.raises(ValueError, match="no column x"):
        fits.read_fits(spark, [path], ["x"])


def test_files_of_one_layout_and_empty_ones(spark, tmp_path):
    df = spark.createDataFrame(rows(20), SCHEMA).select("j", "d")
    (tmp_path / "in").mkdir()
    for k in range(3):
        fits.write_fits(df.limit(0) if k == 1 else df, str(tmp_path / f"in/{k}.fits"))
    assert fits.read_fits(spark, [str(tmp_path / "in")]).count() == 40
    assert fits.read_fits(spark, [str(tmp_path / "in/1.fits")]).collect() == []
    fits.write_fits(df.select("d", "j"), str(tmp_path / "in/9.fits"))
    with pytest.raises(Exception, match="differs"):
        fits.read_fits(spark, [str(tmp_path / "in")]).count()
    with pytest.raises(FileNotFoundError):
        fits.read_fits(spark, [str(tmp_path / "none*.fits")])
    cut = (tmp_path / "in/0.fits").read_bytes()[: 2 * 2880 + 10]
    (tmp_path / "cut.fits").write_bytes(cut)
    with pytest.raises(ValueError, match="cut off"):
        fits.read_fits(spark, [str(tmp_path / "cut.fits")])


def test_what_has_no_form_is_refused(spark, tmp_path):
    path = str(tmp_path / "x.fits")
    for schema, data in (("a map<string,int>", [({"x": 1},)]), ("a array<int>", [([1],), ([1, 2],)]), ("a int", [(None,), (-(1 << 31),)])):
        with pytest.raises(ValueError):
            fits.write_fits(spark.createDataFrame(data, schema), path)
    assert list(tmp_path.iterdir()) == []


def test_a_file_beyond_two_gigabytes(tmp_path):
    """A sparse file of 2.2 GB: planning reads headers only, partitions chunks of rows."""
    width, n = 8 + 8000, 280_000
    head = fits.header_bytes([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0)]) + fits.header_bytes([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2), ("TTYPE1", "id"), ("TFORM1", "K"), ("TTYPE2", "flux"), ("TFORM2", "1000D")])
    path = tmp_path / "big.fits"
    with path.open("wb") as f:
        f.write(head)
        for row in (0, 123_456, n - 1):
            f.seek(len(head) + row * width)
            f.write(np.array([row + 1], ">i8").tobytes())
        f.truncate(-(-(len(head) + n * width) // 2880) * 2880)
    assert path.stat().st_size > 2 << 30
    uri = path.as_uri()
    own = fits.layout(*fits.opened(uri))
    reader = fits.FitsReader([uri], own.cols, [0], "row", 128 << 20)
    parts = reader.partitions()
    assert len(parts) == 17 and sum(p.n for p in parts) == n
    found = {}
    for p in (parts[0], parts[123_456 // parts[0].n], parts[-1]):
        for batch in reader.read(p):
            assert batch.nbytes < 1 << 20
            v = batch.column("id").to_numpy()
            found |= {int(batch.column("row")[int(i)].as_py()): int(v[i]) for i in np.flatnonzero(v)}
    assert found == {row: row + 1 for row in (0, 123_456, n - 1)}


def test_tables_over_http(spark, tmp_path):
    fits.write_fits(spark.createDataFrame(rows(300), SCHEMA), str(tmp_path / "t.fits"))
    s = Server({"t.fits": (tmp_path / "t.fits").read_bytes()})
    got = readers.read_source(spark, [s.url + "t.fits"], "fits")
    assert sorted(map(repr, plain(got.collect()))) == sorted(map(repr, rows(300)))


@pytest.mark.parametrize("order", [0, 3, 6])
def test_maps(spark, tmp_path, order):
    npix = 12 << 2 * order
    counts = {p: p % 5 + 1 for p in range(0, npix, 7)}
    path = str(tmp_path / "m.fits")
    fits.write_map(spark.createDataFrame(list(counts.items()), "pix bigint, n bigint"), order, path)
    found, k = fits.read_map(spark, path)
    assert k == order and {r.pix: r.n for r in found.collect()} == counts
    cards = fits.table((tmp_path / "m.fits").read_bytes()).cards
    assert {c: cards[c] for c in ("PIXTYPE", "ORDERING", "INDXSCHM", "OBJECT", "NSIDE")} == {"PIXTYPE": "HEALPIX", "ORDERING": "NESTED", "INDXSCHM": "IMPLICIT", "OBJECT": "FULLSKY", "NSIDE": str(1 << order)}
    raw = (tmp_path / "m.fits").read_bytes().replace(b"'NESTED  '", b"'RING    '")
    (tmp_path / "r.fits").write_bytes(raw)
    with pytest.raises(ValueError, match="nested"):
        fits.read_map(spark, str(tmp_path / "r.fits"))
    assert fits.read_map(spark, str(tmp_path / "r.fits"), "NESTED")[0].count() == len(counts)


def test_a_catalogues_map(spark, tmp_path):
    df = spark.createDataFrame([(i, (i * 7.3) % 360, (i * 3.1) % 170 - 85) for i in range(200)], "source_id bigint, ra double, dec double")
    cat = CatalogBuilder(spark, "c", source=df, order_k=4, threshold=50, margin=None, location=str(tmp_path)).build()
    path = cat.write_density_map()
    assert path.endswith("/c/c_order4_hpmap.fits")
    assert sorted(map(tuple, fits.read_map(spark, path)[0].collect())) == sorted(map(tuple, cat.density().collect()))
