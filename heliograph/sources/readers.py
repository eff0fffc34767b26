"""Source files of a catalogue."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession

from heliograph.operators.columns import cast
from heliograph.sources.fits import read_fits
from heliograph.sources.text import csv_by_lines, typed
from heliograph.sources.web import is_web

FORMATS = ("csv", "csv.gz", "parquet", "fits")


def read_source(spark: SparkSession, paths: list[str] | str, fmt: str = "csv", skiprows: list[int] | None = None, header: bool = True, dtypes: dict[str, str] | None = None) -> DataFrame:
    """The rows of all files. ``skiprows`` are numbers of physical lines (from 0) to leave out of each csv file before its header.
    csv files can be behind http(s) addresses, and have the usual marks of missing values."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {', '.join(FORMATS)}")
    if not paths:
        raise ValueError("there are no source files")
    if not fmt.startswith("csv"):
        if fmt == "parquet" and any(map(is_web, paths)):
            raise ValueError("parquet files are not read from http(s) addresses")
        return cast(spark.read.parquet(*paths) if fmt == "parquet" else read_fits(spark, paths), dtypes)
    if skiprows or any(map(is_web, paths)):
        return typed(csv_by_lines(spark, paths, skiprows, header), dtypes)
    return typed(spark.read.csv(paths, header=header, escape='"'), dtypes)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v]


def links_in(page: str, url: str, fmt: str) -> list[str]:
    """Addresses of a page's links that end in ``fmt``, in the order of the page."""
    parser = _Links()
    parser.feed(page)
    return [urljoin(url if url.endswith("/") else url + "/", h) for h in parser.found if h.endswith(fmt)]


def list_sources(url: str, fmt: str, timeout: float = 60) -> list[str]:
    with urlopen(url, timeout=timeout) as page:
        return links_in(page.read().decode("utf-8", "replace"), url, fmt)
