"""Centroid clustering by ball k-means, exact in integers.

A cluster is a ball: its centroid and a bound on its members' distance from it (the largest distance before the centroid moved, and
the move). Another centroid can only attract a member if it is at most twice the ball's radius away; these are the ball's
neighbours, sorted by their distance. A member nearer to its own centroid than half the way to the first neighbour is in the stable
core and is compared with none. The others lie in annuli bounded by the half distances, and a member of the k-th annulus is
compared exactly with the first k neighbours only. Equal distances go to the smaller number.

Rows never move: a round reads the table of the round before, and writes the vectors with their cluster and distance, which a lost
executor cannot take away. Only a row a cluster (count, radius, sums of components) reaches the driver.

Cases: rows whose vector is null, has another number of components, or a null or non-finite one are left out; a component too
large for exact 64-bit distances raises an error; null vec_ids hash as an empty number; rows that share a vec_id are vectors of
their own, in the order of their components where their hashes decide; with fewer vectors than clusters each one starts
a cluster; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import Workspace, only

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
STATE = "vec_id bigint, v array<int>, cluster int, distance bigint"
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
#: Up to this magnitude the inner products of 64 components are exact in doubles.
EXACT = 1 << 22


def largest(dims: int) -> int:
    """The largest magnitude of a component for which four times a squared distance stays in 64 bits."""
    return isqrt(((1 << 63) - 1) // (16 * dims))


def kept_vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the integer components floor(scale * x), of complete finite vectors."""
    src = only(table, "vec_id", "embedding").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    whole = (F.size("e") == dims) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = float(largest(dims))
    fits = F.forall("e", lambda x: F.abs(x * float(scale)) < most)
    part = lambda x: F.floor(x * float(scale)).cast("int")
    checked = F.when(fits, F.transform("e", part)).otherwise(F.raise_error(F.lit("a vector's component is too large for exact distances")).cast("array<int>"))
    return src.where(F.col("e").isNotNull() & whole).select("vec_id", checked.alias("v"))


def first_centroids(kept: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select("v", mark.alias("mark")).orderBy("mark", "v").limit(k).select("v").collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


class Balls:
    """The clusters' centroids and each one's neighbours: centroids at most twice its radius away, nearest first."""

    def __init__(self, centroids: np.ndarray, radii: list[int | None]):
        self.centroids = centroids
        self.apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
        self.neighbours = []
        for i, radius in enumerate(radii):
            near = np.array([j for j in range(len(centroids)) if j != i and (radius is None or int(self.apart[i, j]) <= 4 * radius * radius)], np.int64)
            self.neighbours.append(near[np.lexsort((near, self.apart[i, near]))])

    def distances(self, v: np.ndarray, c: np.ndarray | int) -> np.ndarray:
        """Squared distances of vectors from their or from one centroid."""
        gap = v - self.centroids[c]
        if len(gap) and max(int(gap.max()), -int(gap.min())) < EXACT:
            gap = gap.astype(np.float64)
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)

    def assign(self, v: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector and its squared distance, from the ball that holds the vector."""
        best, found = self.distances(v, cluster), cluster.copy()
        for i in np.unique(cluster).tolist():
            near = self.neighbours[i]
            own = np.nonzero(cluster == i)[0]
            # twice a member's distance reaches so many neighbours: its annulus, 0 in the stable core
            annulus = np.searchsorted(self.apart[i, near], 4 * best[own], side="right")
            for at, j in enumerate(near.tolist()):
                rows = own[annulus > at]
                if not len(rows):
                    break
                d = self.distances(v[rows], j)
                closer = (d < best[rows]) | ((d == best[rows]) & (j < found[rows]))
                best[rows[closer]], found[rows[closer]] = d[closer], j
        return found, best


def assigned(state: DataFrame, balls: Balls) -> DataFrame:
    """The vectors with their nearest cluster and distance; ``state`` names the ball that holds each."""
    shared = state.sparkSession.sparkContext.broadcast(balls)  # clusters x components, whatever the rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                vectors = batch.column("v")
                v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
                cluster, distance = shared.value.assign(v, batch.column("cluster").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vectors, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(run, STATE)


def ball_kmeans(kept: DataFrame, ws: Workspace, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Vectors with cluster and squared distance after the rounds and a last assignment, and the final centroids."""
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], STATE), centroids
    dims = centroids.shape[1]
    balls = Balls(centroids, [None] * len(centroids))  # all vectors start in the first ball, whose radius nobody knows
    state = kept.withColumn("cluster", F.lit(0))
    for t in range(rounds + 1):
        state = ws.stage(assigned(state, balls), f"round{t}")
        if t > 1:
            ws.drop(f"round{t - 1}")
        if t == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *[F.sum(F.col("v")[i].cast("bigint")).alias(f"s{i}") for i in range(dims)]).collect()  # a row a cluster
        moved, radii = centroids.copy(), [0] * len(centroids)
        for r in sums:
            moved[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
            shift = int(((moved[r.cluster] - centroids[r.cluster]) ** 2).sum())
            radii[r.cluster] = isqrt(r.far) + isqrt(shift) + 2
        centroids = moved
        balls = Balls(centroids, radii)
    return state, centroids


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "ball-kmeans")
    state, centroids = ball_kmeans(kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), ws)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    per = {r.cluster: r.s for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(per.values()), marks[c]) for c, s in sorted(per.items())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    d = "CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 16)",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"a{t} AS (SELECT vec_id, v, c, d FROM (SELECT a.vec_id, a.v, b.c, {d} AS d FROM kept AS a, c{t} AS b) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if t < ROUNDS:
            parts.append(f"m{t} AS (SELECT c, list(q ORDER BY i) AS v FROM (SELECT c, i, CAST((s - (((s % n) + n) % n)) // n AS BIGINT) AS q FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY c, i)) GROUP BY c)")
            parts.append(f"c{t + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{t} AS o LEFT JOIN m{t} AS m ON m.c = o.c)")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(b.v, ',')) AS centroid_sha256 FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS b ON a.c = b.c"


ORACLE_SQL = _oracle()
