"""csv over http, by lines, with missing values: results and failures."""

import gzip
from http.server import BaseHTTPRequestHandler
from socketserver import ThreadingTCPServer
from threading import Thread

import pytest

from heliograph.plans.builder import CatalogBuilder
from heliograph.sources import readers, text, web


class Server:
    """Files by name; ``cuts`` breaks answers off after so many bytes, ``errors`` answers with 503 first."""

    def __init__(self, files, ranges=True, length=True, cuts=None, errors=0):
        self.asked, outer = [], self
        self.cuts, self.errors = dict(cuts or {}), errors

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                name = self.path.lstrip("/")
                if outer.errors:
                    outer.errors -= 1
                    return self.send_error(503)
                if name not in files:
                    return self.send_error(404)
                body = files[name]
                asked = self.headers["Range"] if ranges else None
                first = int(asked.removeprefix("bytes=").split("-")[0]) if asked else 0
                self.send_response(206 if asked else 200)
                if ranges:
                    self.send_header("Accept-Ranges", "bytes")
                if length:
                    self.send_header("Content-Length", str(len(body) - first))
                self.end_headers()
                if self.command == "GET":
                    outer.asked.append((name, first))
                    part = body[first:]
                    if outer.cuts.get(name):
                        part = part[: outer.cuts[name].pop()]
                    self.wfile.write(part)

            do_HEAD = do_GET

            def log_message(self, *_):
                pass

        self.server = ThreadingTCPServer(("127.0.0.1", 0), Handler)
        self.server.daemon_threads = True
        Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/"


def csv_of(ids):
    return "ra,dec,id\n" + "".join(f"{i % 360},{i % 90}.5,{i}\n" for i in ids)


@pytest.fixture(autouse=True)
def short_pauses(monkeypatch):
    monkeypatch.setattr(web, "PAUSE_S", 0.01)


def test_ranges_give_each_line_once(spark):
    body = "".join(f"line {i} {'x' * (i % 13)}\r\n" for i in range(500)) + "\nlast without an end"
    s = Server({"a": body.encode()})
    want = body.replace("\r\n", "\n").split("\n")
    for size in (1, 7, 64, 1000, 1 << 20):
        reader = web.WebLinesReader([s.url + "a"], size if size > 1 else 31)
        found = [v for p in reader.partitions() for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert found == want
    got = web.web_lines(spark, [s.url + "a"], 900)
    assert got.rdd.getNumPartitions() > 5
    rows = text.numbered(got).collect()
    assert [r.value for r in sorted(rows, key=lambda r: r.line)] == want and sorted(r.line for r in rows) == list(range(len(want)))


@pytest.mark.parametrize("ranges,length", [(True, True), (False, True), (False, False)])
def test_broken_answers_are_asked_for_again(ranges, length):
    body = csv_of(range(2000)).encode()
    cut = {"a": [900, 3000, 10]} if length else {}
    s = Server({"a": body, "z.gz": gzip.compress(body[:500]) + gzip.compress(body[500:])}, ranges, length, cut, errors=2)
    for name, want in (("a", body), ("z.gz", body)):
        reader = web.WebLinesReader([s.url + name], 1 << 20)
        assert [v for p in reader.partitions() for b in reader.read(p) for v in b.column("value").to_pylist()] == want.decode().splitlines()
    if ranges:
        assert [first for name, first in s.asked if name == "a"] == [0, 10, 3010, 3910]


def read(url):
    reader = web.WebLinesReader([url], 1 << 20)
    return [b for p in reader.partitions() for b in reader.read(p)]


def test_failures_are_errors(spark):
    s = Server({"a": b"x\n" * 500, "b": b"x\n" * 500, "z.gz": gzip.compress(b"abc\n" * 1000)[:-9]}, cuts={"a": [1], "b": [0] * 20})
    assert sum(b.num_rows for b in read(s.url + "a")) == 500
    with pytest.raises(OSError, match="beyond byte 0 of 1000"):
        read(s.url + "b")
    with pytest.raises(OSError, match="cut off"):
        read(s.url + "z.gz")
    with pytest.raises(OSError, match="404"):
        read(s.url + "none")
    with pytest.raises(ValueError, match="not read from http"):
        readers.read_source(spark, [s.url + "a"], "parquet")


def test_catalogue_from_the_web(spark, tmp_path):
    """Two files whose headers and comments are their own; the build is used again until a file changes."""
    files = {n: f"# comment\n{csv_of(ids)}".encode() for n, ids in (("a.csv", range(300)), ("b.csv", range(300, 450)))}
    files["index"] = b'<a href="a.csv">a</a><a href="b.csv">b</a>'
    s = Server(files)
    urls = [s.url + n for n in ("a.csv", "b.csv")]
    assert readers.list_sources(s.url + "index", "csv") == [s.url + "index/a.csv", s.url + "index/b.csv"]
    make = lambda: CatalogBuilder(spark, "w", urls, "csv", id_kw="id", order_k=3, threshold=100, margin=None, skiprows=[0], location=str(tmp_path), allow_overflow=True).build()
    cat = make()
    assert len(cat) == 450 and sorted(r.id for r in cat.load(["id"]).collect()) == list(range(450))
    n = len(s.asked)
    make()
    assert len(s.asked) == n
    files["b.csv"] = f"# comment\n{csv_of(range(300, 500))}".encode()
    assert len(make()) == 500


def test_skiprows_count_each_files_own_lines(spark, tmp_path):
    """A folder with folders; blank lines; splits smaller than what is skipped."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        body = [f"# {k} {i}" for i in range(40)] + ["id,name"] + [f'{k * 100 + i},"n, {i}"' for i in range(30)] + ["", f"{k * 100 + 99},null"]
        (tmp_path / ("in" if k else ".") / f"f{k}.csv").write_text("\n".join(body) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        df = readers.read_source(spark, [str(tmp_path / "f0.csv"), str(tmp_path / "in")], "csv", skiprows=[*range(40), 45], dtypes={"name": "unicode"})
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([(k * 100 + i, f"n, {i}") for k in range(3) for i in range(30) if i != 4] + [(k * 100 + 99, None) for k in range(3)], key=lambda r: r[0])


def test_missing_values_and_types(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("id,v,name,big,flag,code,none\n1,null,NA,6917528997577384320,True,00123,\n2,1.5,x,nan,False,7,NULL\n3,-2e3,N/A,12,,0,n/a\n")
    for skip in (None, [0, 1]):
        if skip:
            path.write_text("#\n#\n" + path.read_text())
        df = readers.read_source(spark, str(path), "csv", skiprows=skip, dtypes={"code": "unicode"})
        assert dict(df.dtypes) == {"id": "bigint", "v": "double", "name": "string", "big": "bigint", "flag": "boolean", "code": "string", "none": "string"}
        assert sorted(map(tuple, df.collect()))[0] == (1, None, None, 6917528997577384320, True, "00123", None)
        assert [r.id for r in df.where("v > 0").collect()] == [2]
        assert [r.v for r in readers.read_source(spark, str(path), "csv", skiprows=skip, dtypes={"v": "f8"}).where("id = 1").collect()] == [None]


def test_types_given_need_no_pass(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    seen = spark.sparkContext.statusTracker()
    before = len(seen.getJobIdsForGroup(None))
    readers.read_source(spark, str(tmp_path / "t.csv"), "csv", dtypes={"a": "i8", "b": "f8"})
    assert len(seen.getJobIdsForGroup(None)) - before <= 1  # the header alone
