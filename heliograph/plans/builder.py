"""Building a catalogue on disk from source files."""

from __future__ import annotations

import gc
import hashlib
import json
import time
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import healpix as hp
from heliograph.operators import margin as mg
from heliograph.operators import partitioning as pt
from heliograph.operators.columns import resolve
from heliograph.plans.catalog import Catalog, read_tree
from heliograph.sources import storage
from heliograph.sources.readers import FORMATS, read_source
from heliograph.sources.web import is_web, stat


class LostRows(RuntimeError):
    pass


class CatalogBuilder:
    """Sources to partitions with spatial ids, a density map, a margin cache and metadata.

    Each build goes to a folder of its own, and the metadata file, which is replaced last and at once, names it: a build that breaks off
    changes nothing, and open catalogues keep theirs. The newest ``keep`` builds stay, with their metadata; :meth:`vacuum` removes
    what broken builds left.

    Sources that are not Parquet are parsed once and kept as Parquet (``cache``). This table and the density map carry a fingerprint
    of what they were made from in their names, so each is used again only for the same files and options."""

    def __init__(self, spark: SparkSession, name: str, urls: list[str] | str | None = None, fmt: str = "csv", ra_kw: int | str = "ra", dec_kw: int | str = "dec", id_kw: int | str = "source_id", order_k: int = 10, dtypes: dict[str, str] | None = None, threshold: int = 1_000_000, margin: float | None = 0.1, location: str = ".", skiprows: list[int] | None = None, header: bool = True, on_bad_coords: str = "fail", allow_overflow: bool = False, source: DataFrame | None = None, storage_options: dict[str, str] | None = None, cache: bool = True, summaries: bool = False, keep: int = 2):
        if fmt not in FORMATS:
            raise ValueError(f"format {fmt!r} is none of {', '.join(FORMATS)}")
        if threshold < 1:
            raise ValueError("the threshold must be 1 or more")
        if source is None and not urls:
            raise ValueError("there are no source files")
        if keep < 1:
            raise ValueError("the newest build is always kept")
        self.spark, self.name, self.fmt, self.order_k, self.threshold, self.margin = spark, name, fmt, hp.check_order(order_k), threshold, margin
        self.urls = [urls] if isinstance(urls, str) else list(urls or [])
        self.root = f"{location.rstrip('/')}/{name}"
        self.keep, self.base = keep, f"{self.root}/builds/{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
        self.options, self.on_bad, self.allow_overflow, self.summaries = {"skiprows": skiprows, "header": header, "dtypes": dtypes}, on_bad_coords, allow_overflow, summaries
        storage.set_storage_options(spark, self.root, storage_options)
        self._source_mark = self._mark(*self._files(), self.fmt, str(self.options)) if source is None else uuid.uuid4().hex[:16]
        self.source = source if source is not None else self._parsed(cache and fmt != "parquet")
        self.ra, self.dec, self.id = (resolve(self.source, k) for k in (ra_kw, dec_kw, id_kw))
        self.rows = pt.checked(self.source, self.ra, self.dec, on_bad_coords)
        if margin and hp.resolution(order_k) < margin:
            warnings.warn(f"pixels of order {order_k} are smaller ({hp.resolution(order_k):.3g} degrees) than the margin ({margin:g})", stacklevel=2)

    @staticmethod
    def _mark(*what) -> str:
        return hashlib.sha256(json.dumps(what).encode()).hexdigest()[:16]

    def _files(self) -> list:
        found = []
        for u in self.urls:
            if is_web(u):
                found.append([u, *stat(u)])
                continue
            fs, p = storage.file_system(self.spark, u)
            for s in fs.globStatus(p) or []:
                inner = fs.listFiles(s.getPath(), True)  # of all levels
                while inner.hasNext():
                    x = inner.next()
                    found.append([str(x.getPath()), x.getLen(), x.getModificationTime()])
        found.sort()
        return [self.urls, found]

    def _parsed(self, cache: bool) -> DataFrame:
        """The sources' rows; with ``cache`` as written to Parquet and read again."""
        if not cache:
            return read_source(self.spark, self.urls, self.fmt, **self.options)
        return self._kept(f"source.{self._source_mark}", lambda: read_source(self.spark, self.urls, self.fmt, **self.options))

    def _kept(self, name: str, make) -> DataFrame:
        """A table under the catalogue's root, made if no finished one is there."""
        path = f"{self.root}/{name}"
        if not storage.exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def fingerprint(self) -> str:
        return self._mark(self._source_mark, self.order_k, self.ra, self.dec, self.on_bad)

    def _density_name(self) -> str:
        """Maps of files are kept for later builds; that of a DataFrame is its build's own."""
        own = f"density.{self.fingerprint()}"
        return own if self.urls else f"builds/{self.base.rpartition('/')[2]}/{own}"

    def density(self) -> DataFrame:
        """The density map, written once for the same inputs."""
        return self._kept(self._density_name(), lambda: pt.density(self.rows, self.order_k, self.ra, self.dec))

    def _staged(self, df: DataFrame, name: str = "points") -> DataFrame:
        path = f"{self.base}/borders/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _written(self, rows: DataFrame, which: str) -> DataFrame:
        write_tree(rows, f"{self.base}/{which}", self.summaries)
        return read_tree(self.spark, f"{self.base}/{which}")

    def _write_catalog(self, rows: DataFrame, parts: DataFrame, listed: list) -> DataFrame:
        """The tree of all rows. A partition with fewer rows than a range (:func:`pt.range_rows`) is ranked and written as a whole; those of
        the deepest order that have more go by ranges, each a file."""
        by, most = ["Norder", "Npix"], pt.range_rows(sum(r.n for r in listed), self.threshold)
        full = (F.col("n") >= most) | (F.col("Norder") > pt.ID_ORDER)  # pixels of ids hold several partitions of deeper orders
        crowded = [r for r in listed if r.n >= most or r.Norder > pt.ID_ORDER]
        which = pt.small(parts.where(full).select(F.col("Norder").cast("int"), F.col("Npix").cast("int")), len(crowded))
        rest = rows.join(which, by, "left_anti").select(*rows.columns) if crowded else rows
        tree = self._written(pt.with_spatial_id(rest, self.ra, self.dec, self.id, within=by), "catalog")
        if not crowded:
            return tree
        own = rows.join(which, by, "left_semi").select(*rows.columns)
        ranked, _ = pt.crowded_ids(own, sum(r.n for r in crowded), most, self.ra, self.dec, self._staged, self.id)
        write_tree(ranked, f"{self.base}/catalog", self.summaries, dealt=True, mode="append" if len(crowded) < len(listed) else "overwrite")
        return read_tree(self.spark, f"{self.base}/catalog")

    def build(self) -> Catalog:
        spark = self.spark
        dens = self.density()
        parts_path = f"{self.base}/partitions"
        pt.partition_map(dens, self.order_k, self.threshold, self.allow_overflow).write.mode("overwrite").parquet(parts_path)
        parts = spark.read.parquet(parts_path)
        listed = parts.orderBy(pt.sort_key()).collect()  # a row a partition
        orders = sorted({r.Norder for r in listed})
        rows = pt.in_partitions(self.rows, parts, len(listed), orders, self.order_k, self.ra, self.dec)
        tree = self._write_catalog(rows, parts, listed)
        n_sources, written = sum(r.n for r in listed), tree.count()
        if written != n_sources:
            raise LostRows(f"{self.base}/catalog has {written} rows, the density map {n_sources}; did the sources change meanwhile?")
        if self.margin:
            near = mg.margin_rows(tree, parts, orders, self.margin, self.ra, self.dec, self._staged) if listed else tree.limit(0)
            write_tree(near.select(*rows.columns, "_ID"), f"{self.base}/neighbor", self.summaries)
        storage.delete(spark, f"{self.base}/borders")
        # keys as in the published layout, then our own
        meta = {
            "cat_name": self.name, "ra_kw": self.ra, "dec_kw": self.dec, "id_kw": self.id, "n_sources": n_sources, "pix_threshold": self.threshold, "urls": self.urls,
            "hips": {str(o): [r.Npix for r in listed if r.Norder == o] for o in orders}, "order_k": self.order_k, "margin": self.margin, "density": self._density_name(), "build": self.base.rpartition("/")[2],
        }
        cat = self._commit(meta)
        release_shuffles(spark)
        return cat

    def _commit(self, meta: dict) -> Catalog:
        """Name the build as the catalogue's, then remove the builds that are no longer kept, with the tables that only they used."""
        spark = self.spark
        path = f"{self.root}/{self.name}_meta.json"
        before = json.loads(storage.read_text(spark, path)).get("history", []) if storage.exists(spark, path) else []
        source = f"source.{self._source_mark}" if self.urls and self.fmt != "parquet" else None
        history = [{"build": meta["build"], "density": meta["density"], "source": source}, *before]
        meta = meta | {"history": history[: self.keep]}
        text = json.dumps(meta, indent=4)
        storage.write_text(spark, f"{self.base}/meta.json", text)
        storage.replace_text(spark, path, text)
        used = {e[k] for e in meta["history"] for k in ("density", "source")}
        for old in history[self.keep :]:
            storage.delete(spark, f"{self.root}/builds/{old['build']}")
            for name in {old["density"], old["source"]} - used - {None}:
                storage.delete(spark, f"{self.root}/{name}")
        return Catalog(spark, self.name, self.root.rpartition("/")[0] or ".")

    def vacuum(self, hours: float = 24.0) -> list[str]:
        """Remove builds and tables under the catalogue's root that no kept build names and that did not change for so long; builds
        that run now are younger. Returns what was removed."""
        path = f"{self.root}/{self.name}_meta.json"
        history = json.loads(storage.read_text(self.spark, path)).get("history", []) if storage.exists(self.spark, path) else []
        used = {x for e in history for x in (f"builds/{e['build']}", e["density"], e["source"])}
        found = [(f"builds/{n}", t) for n, t in storage.children(self.spark, f"{self.root}/builds")]
        found += [(n, t) for n, t in storage.children(self.spark, self.root) if n.startswith(("density.", "source.")) or n.startswith(f"{self.name}_meta.json.")]
        old = [n for n, t in found if n not in used and t < (time.time() - 3600 * hours) * 1000]
        for n in old:
            storage.delete(self.spark, f"{self.root}/{n}")
        return sorted(old)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffles whose jobs are done go now. Spark removes them once the driver's JVM has collected their plans, which else may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def write_tree(rows: DataFrame, path: str, summaries: bool = False, dealt: bool = False, mode: str = "overwrite") -> None:
    """A partition's rows come together, in NEST order, unless they are ``dealt`` already. With ``summaries`` the committer also writes the footers' summary files
    (_metadata and _common_metadata). A tree without rows is a table, so that it has a schema."""
    spark = rows.sparkSession
    rows = rows if dealt else rows.repartition("Norder", "Npix")
    w = rows.sortWithinPartitions("Norder", "Npix", "_ID").write.mode(mode).partitionBy("Norder", "Dir", "Npix")
    (w.option("parquet.summary.metadata.level", "ALL") if summaries else w).parquet(path)
    fs, p = storage.file_system(spark, path)
    if not any(s.isDirectory() for s in fs.listStatus(p)):
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(path)
