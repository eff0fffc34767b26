"""A catalogue on disk."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from heliograph.functions import healpix as hp
from heliograph.operators import cone as cn
from heliograph.operators import coverage as cv
from heliograph.operators import crossmatch as xm
from heliograph.operators import local_match as lm
from heliograph.operators import partitioning as pt
from heliograph.operators import raster
from heliograph.operators import tiles as ti
from heliograph.operators.columns import quoted, with_mandatory
from heliograph.sources import fits, storage

OWN = ("Norder", "Dir", "Npix", "_ID")
TREES = ("catalog", "neighbor")
#: Columns of a result beyond which there is a warning.
MANY = 50
#: Partitions up to which a search opens their folders alone.
FEW_PARTS = 1000


def read_metadata(spark: SparkSession, name: str, location: str) -> dict:
    return json.loads(storage.read_text(spark, f"{location.rstrip('/')}/{name}/{name}_meta.json"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a tree; one without partitions has their columns too."""
    with storage.few_listings(spark):
        df = spark.read.parquet(path)
    return df.select("*", *[F.lit(None).cast("int").alias(c) for c in OWN[:3] if c not in df.columns])


def read_paths(spark: SparkSession, paths: list[str] | str, columns: list[str] | None = None) -> DataFrame:
    """The rows of files or folders of one catalogue's tree, with the columns that the folders' names hold."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("there are no paths")
    base = paths[0].split("/Norder=")[0]
    if any(p.split("/Norder=")[0] != base for p in paths):
        raise ValueError("the paths are of several trees")
    with storage.few_listings(spark):
        df = spark.read.option("basePath", base).parquet(*paths)
    return df.select(*[quoted(c) for c in columns]) if columns else df


class Catalog:
    """Rows, cone searches and cross-matches of a catalogue as lazy DataFrames. It stays with the build that it was opened at: the newest
    one, or with ``build`` one of those that are kept."""

    def __init__(self, spark: SparkSession, name: str, location: str = ".", build: str | None = None):
        self.spark, self.name, self.location = spark, name, location.rstrip("/")
        self.root = f"{self.location}/{name}"
        if not storage.exists(spark, self.root):
            raise FileNotFoundError(self.root)
        self.meta = json.loads(storage.read_text(spark, f"{self.root}/builds/{build}/meta.json")) if build else read_metadata(spark, name, self.location)
        self.base = f"{self.root}/builds/{self.meta['build']}" if "build" in self.meta else self.root
        self.ra, self.dec, self.id = self.meta["ra_kw"], self.meta["dec_kw"], self.meta["id_kw"]
        self.hips = {int(o): [int(p) for p in pix] for o, pix in self.meta["hips"].items()}

    def __repr__(self) -> str:
        return f"Catalog({self.name})"

    def __str__(self) -> str:
        return f"Catalog: {self.name}"

    def __len__(self) -> int:
        return self.meta["n_sources"]

    def tree(self, which: str = "catalog") -> DataFrame:
        if which not in TREES:
            raise ValueError(f"{which!r} is none of {', '.join(TREES)}")
        path = f"{self.base}/{which}"
        if not storage.exists(self.spark, path):
            raise FileNotFoundError(path)
        return read_tree(self.spark, path)

    def builds(self) -> list[str]:
        """The builds that are kept, newest first."""
        return [e["build"] for e in read_metadata(self.spark, self.name, self.location).get("history", [])]

    def load(self, columns: list[str] | None = None, which: str = "catalog", partitions: list[tuple[int, int]] | None = None) -> DataFrame:
        """The tree's rows; with ``partitions``, (order, pixel) pairs, only the files of these are read."""
        df = self.tree(which)
        if partitions is not None:
            df = df.where(cn.partition_filter([(int(o), int(p)) for o, p in partitions]))
        return df.select(*[quoted(c) for c in columns]) if isinstance(columns, list) and columns else df

    def view(self, name: str, which: str = "catalog") -> str:
        """The tree as a view of the session, for SQL. Returns its name."""
        self.tree(which).createOrReplaceTempView(quoted(name))
        return name

    def rows_per_degree(self) -> float:
        """Rows a square degree, over the partitions' area."""
        return len(self) / max(sum(len(pix) * hp.pixel_area(o) for o, pix in self.hips.items()), 1e-300)

    @property
    def schema(self):
        return self.tree().schema

    def density(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.meta['density']}")

    def write_density_map(self, path: str | None = None) -> str:
        """The density map as a map of the whole sky in a FITS file, by default where other programs look for it. Returns its path."""
        path = path or f"{self.root}/{self.name}_order{self.meta['order_k']}_hpmap.fits"
        fits.write_map(self.density(), self.meta["order_k"], path)
        return path

    def partitions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/partitions")

    def _columns(self, columns: list[str] | None) -> list[str]:
        wanted = with_mandatory(columns, [self.ra, self.dec, self.id])
        return wanted or [c for c in self.tree().columns if c not in OWN]

    def cone_search(self, ra: float, dec: float, radius: float, columns: list[str] | None = None) -> DataFrame:
        """Rows nearer than ``radius`` with _DIST; only partitions that the cone may touch are read, and in these only the row groups
        with spatial ids of the cone's tiles."""
        ra, dec, radius = cn.checked_cone(ra, dec, radius)
        parts = cn.partitions_of_cone([(o, p) for o, pix in self.hips.items() for p in pix], ra, dec, radius)
        rows = self._of_partitions(parts).where(ti.id_filter(ti.id_ranges(ra, dec, radius))).select(*[quoted(c) for c in self._columns(columns)])
        return cn.cone(rows, ra, dec, radius, self.ra, self.dec)

    def _of_partitions(self, parts: list[tuple[int, int]]) -> DataFrame:
        """The rows of some partitions: while these are few, other folders are not listed."""
        if not 0 < len(parts) <= FEW_PARTS:
            return self.tree().where(cn.partition_filter(parts))
        return read_paths(self.spark, [f"{self.base}/catalog/{storage.directory_of(o, p)}" for o, p in parts]).where(cn.partition_filter(parts))

    def coverage(self) -> DataFrame:
        """Where the catalogue has rows, by its density map, as a coverage."""
        return ti.union(ti.tile_ranges(self.density().withColumn("o", F.lit(self.meta["order_k"])), "o", "pix"))

    def cones(self, cones: DataFrame, ra: str, dec: str, radius: str, columns: list[str] | None = None) -> DataFrame:
        """For a table of cones, one a row: each cone's rows (its columns, then the catalogue's) with _DIST."""
        rows = self.tree().select(*[quoted(c) for c in self._columns(columns)])
        return ti.rows_of_cones(rows, cones, ti.tile_orders(cones, radius), self.ra, self.dec, ra, dec, radius)

    def cross_match(self, other: Catalog, c1_cols: list[str] | None = None, c2_cols: list[str] | None = None, n_neighbors: int = 1, dthresh: float = 0.01, evaluate_margins: bool | str = True, delim: str = ".") -> DataFrame:
        """For each row its nearest rows of the other catalogue, with both sides' columns by catalogue, hips_k, hips_pix
        and _DIST. Without margins only pairs count whose partitions contain one another. With ``evaluate_margins="tree"`` each row
        is matched within the other catalogue's partition that it lies in, whose margin rows stand in for the partitions around it; ``"local"`` does the same in splits that read
        the partitions' files themselves, without a shuffle."""
        if not isinstance(other, Catalog):
            raise TypeError("the other catalogue is no Catalog")
        if other.name == self.name:
            raise ValueError("the catalogues need different names")

        by_tree, local = evaluate_margins == "tree", evaluate_margins == "local"
        if (by_tree or local) and not (other.meta["margin"] and other.meta["margin"] >= dthresh):
            raise ValueError("the other catalogue has no margin as wide as the distance")

        def side(cat: Catalog, cols: list[str] | None, k: int, which: str = "catalog") -> tuple[DataFrame, list[str]]:
            names = cat._columns(cols)
            own = [F.col(quoted(c)).alias(f"{cat.name}{delim}{c}") for c in names]
            extra = [F.col(quoted(cat.ra)).cast("double").alias(f"__ra{k}"), F.col(quoted(cat.dec)).cast("double").alias(f"__dec{k}"), F.col(quoted(cat.id)).alias(f"__id{k}"), F.col("_ID").alias(f"__key{k}"), F.col("Norder").alias(f"__o{k}"), F.col("Npix").cast("bigint").alias(f"__x{k}")]
            return cat.tree(which).select(*own, *extra), [f"{cat.name}{delim}{c}" for c in names]

        one, names1 = side(self, c1_cols, 1)
        two, names2 = side(other, c2_cols, 2)
        if len(names1) + len(names2) > MANY:
            warnings.warn(f"the result has {len(names1) + len(names2)} columns; name those you need", stacklevel=2)
        inside = F.expr("shiftright(__x1, 2 * greatest(0, __o1 - __o2)) = shiftright(__x2, 2 * greatest(0, __o2 - __o1))")
        coords = (("__ra1", "__dec1"), ("__ra2", "__dec2"))
        if local:
            return self._local_match(other, one, two, names1, names2, [self._columns(c1_cols), other._columns(c2_cols)], coords, n_neighbors, dthresh)
        if by_tree:
            margin, _ = side(other, c2_cols, 2, "neighbor")
            theirs = two.unionByName(margin).withColumns({"__q_order": F.col("__o2"), "__q_pix": F.col("__x2")})
            names = [quoted(c) for c in (*one.columns, *two.columns, "_DIST")]
            found = xm.cross_match(self._placed(one, other), theirs, n_neighbors, dthresh, "__key1", "__id2", coords=coords, same=(("__p_order", "__q_order"), ("__p_pix", "__q_pix")), density=self.rows_per_degree()).select(*names)
            parts = [[(o, p) for o, pix in cat.hips.items() for p in pix] for cat in (self, other)]
            if uncovered := lm.pairs_of(*parts)[1]:
                found = found.unionByName(self._match_in_none(other, one, two, uncovered, coords, n_neighbors, dthresh).select(*names))
        else:
            found = xm.cross_match(one, two, n_neighbors, dthresh, "__key1", "__id2", None if evaluate_margins else inside, coords, density=self.rows_per_degree())
        return self._pairs(found, names1, names2)

    @staticmethod
    def _pairs(found: DataFrame, names1: list[str], names2: list[str]) -> DataFrame:
        finer = F.col("__o2") > F.col("__o1")
        return found.select(*[quoted(c) for c in [*names1, *names2]], F.when(finer, F.col("__o2")).otherwise(F.col("__o1")).alias("hips_k"), F.when(finer, F.col("__x2")).otherwise(F.col("__x1")).alias("hips_pix"), "_DIST")

    def _local_match(self, other: Catalog, one: DataFrame, two: DataFrame, names1: list[str], names2: list[str], columns: list[list[str]], coords, n: int, distance: float) -> DataFrame:
        if n < 1:
            raise ValueError("n_neighbors must be 1 or more")
        parts = [[(o, p) for o, pix in cat.hips.items() for p in pix] for cat in (self, other)]
        rows = [{(r.Norder, r.Npix): r.n for r in cat.partitions().collect()} for cat in (self, other)]  # a row a partition
        pairs, uncovered = lm.pairs_of(*parts)
        files, theirs, margin = (lm.tree_files(self.spark, f"{cat.base}/{t}") for cat, t in ((self, "catalog"), (other, "catalog"), (other, "neighbor")))
        splits = [(t, t == a, files[a], theirs[b] + margin.get(b, []), max(a, b)) for a, b in pairs for t in lm.tiles_of((a, b), (rows[0][a], rows[1][b]))]
        whole = self._pairs(xm.pairs_in_reach(one, two, xm.cell_height(distance), distance, coords, ()), names1, names2)  # for its schema
        schema = StructType([StructField(f.name, f.dataType) for f in whole.schema])
        found = lm.local_match(self.spark, splits, columns, ((self.ra, self.dec, self.id), (other.ra, other.dec, other.id)), schema, n, distance)
        if not uncovered:
            return found
        return found.unionByName(self._pairs(self._match_in_none(other, one, two, uncovered, coords, n, distance), names1, names2))

    @staticmethod
    def _placed(one: DataFrame, other: Catalog) -> DataFrame:
        """The rows with the partition of the other catalogue that they are in (__p_order, __p_pix), by their ids where these tell. Where its partitions are all of
        one order nothing is looked up: a partition that it lacks has no rows to match."""
        orders, deepest = sorted(other.hips), max(other.hips, default=0)
        if deepest > pt.ID_ORDER:
            found = pt.in_partitions(one, other.partitions(), sum(map(len, other.hips.values())), orders, deepest, "__ra1", "__dec1").drop("Dir")
        elif len(orders) == 1:
            found = one.withColumns({"Norder": F.lit(deepest), "Npix": pt.pixel_of_id("__key1", deepest)})
        else:
            rows = one.withColumn("__pix", pt.pixel_of_id("__key1", deepest))
            found = pt.looked_up(rows, other.partitions(), sum(map(len, other.hips.values())), orders, deepest).drop("Dir")
        return found.withColumn("Npix", F.col("Npix").cast("bigint")).withColumnsRenamed({"Norder": "__p_order", "Npix": "__p_pix"})

    def _match_in_none(self, other: Catalog, one: DataFrame, two: DataFrame, uncovered: list[tuple[int, int]], coords, n: int, distance: float) -> DataFrame:
        """The rows in none of the other's partitions, matched with all of it. They are in these partitions, which it doesn't cover whole."""
        rows = one.where(cn.partition_filter(uncovered, "__o1", "__x1")) if len(uncovered) <= FEW_PARTS else one
        placed = pt.in_partitions(rows, other.partitions(), sum(map(len, other.hips.values())), sorted(other.hips), max(other.hips, default=0), "__ra1", "__dec1", keep_all=True)
        rest = placed.where("Norder IS NULL").select(*[quoted(c) for c in one.columns])
        return xm.cross_match(rest, two, n, distance, "__key1", "__id2", coords=coords, density=self.rows_per_degree())

    # tables behind sky maps

    def visualize_sources(self) -> DataFrame:
        return cv.log_density(self.density())

    def visualize_partitions(self) -> DataFrame:
        return cv.partition_cover(self.partitions(), max(self.hips, default=0))

    def visualize_cone_search(self, ra: float, dec: float, radius: float) -> DataFrame:
        return cv.cone_cover(self.density(), self.meta["order_k"], *cn.checked_cone(ra, dec, radius))

    def visualize_cross_match(self, other: Catalog) -> DataFrame:
        return pt.partition_pairs(self.partitions(), other.partitions())

    # the same as images of the whole sky

    def map_sources(self, width: int = 800, height: int = 400) -> DataFrame:
        return raster.density_raster(self.density(), self.meta["order_k"], width, height)

    def map_partitions(self, width: int = 800, height: int = 400) -> DataFrame:
        return raster.partition_raster(self.partitions(), sum(map(len, self.hips.values())), sorted(self.hips), width, height)

    def map_cone_search(self, ra: float, dec: float, radius: float, width: int = 800, height: int = 400) -> DataFrame:
        return raster.cone_raster(self.density(), self.meta["order_k"], *cn.checked_cone(ra, dec, radius), width, height)

    def sorted_partitions(self) -> DataFrame:
        return self.partitions().orderBy(pt.sort_key())

    def resolution(self) -> float:
        """Degrees a pixel of the deepest partitions."""
        return hp.resolution(max(self.hips, default=0))
