"""Queries of the sources: files behind a web server, csv as users have it, and binary tables."""

from __future__ import annotations

import atexit
import html
import socket
from http.server import BaseHTTPRequestHandler
from socketserver import ThreadingTCPServer
from threading import Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.queries.sky import DENSITY, DET, OBJ, ORDER_K, density_of, query, shared_dir, table
from heliograph.sources import fits, readers, storage


def served(spark: SparkSession, folder: str) -> str:
    """The address of a server in the driver that lists a folder of any store and gives its files, with ranges."""
    fs, root = storage.file_system(spark, folder)
    files = {s.getPath().getName(): s for s in fs.listStatus(root) if s.isFile() and not s.getPath().getName().startswith(("_", "."))}
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray
    content: dict[str, bytes] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            name = self.path.lstrip("/")
            if name in files:
                if name not in content:
                    stream = fs.open(files[name].getPath())
                    content[name] = bytes(read(stream))
                    stream.close()
                body = content[name]
            else:
                body = "".join(f'<a href="{html.escape(n)}">{html.escape(n)}</a>\n' for n in sorted(files)).encode()
            first = int(self.headers["Range"].removeprefix("bytes=").split("-")[0]) if self.headers["Range"] else 0
            self.send_response(206 if first else 200)
            if first:
                self.send_header("Content-Range", f"bytes {first}-{len(body) - 1}/{len(body)}")
            self.send_header("Accept-Ranges", "bytes")
            self.send_header("Content-Length", str(len(body) - first))
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body[first:])

        do_HEAD = do_GET

        def log_message(self, *_) -> None:
            pass

    conf = spark.sparkContext.getConf()
    host = conf.get("spark.driver.host", "") or socket.gethostname()
    server = ThreadingTCPServer((host, 0), Handler)
    server.daemon_threads = True
    Thread(target=server.serve_forever, daemon=True).start()
    atexit.register(server.shutdown)
    return f"http://{host}:{server.server_address[1]}/"


@query("source_http", OBJ)
def source_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """csv files behind a web server: listed from its page, then read by ranges."""
    path = f"{shared_dir(spark)}/source"
    table(spark, sf_dir, OBJ).repartition(4, "id").write.option("header", True).csv(path)
    url = served(spark, path)
    return readers.read_source(spark, readers.list_sources(url, "csv"), "csv", dtypes={"id": "i8"})


@query("source_http_gz", DET)
def source_http_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/source"
    table(spark, sf_dir, DET).repartition(3, "id").write.option("header", True).option("compression", "gzip").csv(path)
    url = served(spark, path)
    return readers.read_source(spark, readers.list_sources(url, "csv.gz"), "csv.gz")


@query("source_csv_skiprows", f"SELECT id, ra, dec, CASE WHEN id % 7 = 0 OR id % 11 = 0 THEN NULL ELSE mag END AS mag, CASE WHEN id % 5 = 0 THEN NULL ELSE '00' || id END AS label FROM ({OBJ}) AS s")
def source_csv_skiprows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of csv files with three lines of comment in each, missing values in a column of numbers, and numbers that are names."""
    mag = F.when(F.col("id") % 7 == 0, "null").when(F.col("id") % 11 == 0, "NA").otherwise(F.col("mag").cast("string"))
    label = F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("00"), "id"))
    rows = table(spark, sf_dir, OBJ).select(F.floor(F.col("id") / 1000).alias("file"), F.concat_ws(",", "id", "ra", "dec", mag, label).alias("line"))
    top = "# made for a test\n# of comments\n#\nid,ra,dec,mag,label\n"
    texts = rows.groupBy("file").agg(F.concat(F.lit(top), F.array_join(F.collect_list("line"), "\n")).alias("value"))  # 1,000 lines a file
    path = f"{shared_dir(spark)}/source"
    texts.write.partitionBy("file").text(path)
    return readers.read_source(spark, path, "csv", skiprows=[0, 1, 2], dtypes={"label": "unicode"})


@query("source_fits", DET)
def source_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary tables written by tasks, a folder of them, and read again by ranges of rows."""
    path = f"{shared_dir(spark)}/det"
    fits.write_fits_files(table(spark, sf_dir, DET), path)
    return fits.read_fits(spark, [path], split_bytes=1 << 20)


@query("density_fits", DENSITY)
def density_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density map as a map of the whole sky in a FITS file."""
    path = f"{shared_dir(spark)}/map.fits"
    fits.write_map(density_of(spark, sf_dir), ORDER_K, path)
    return fits.read_map(spark, path)[0]
