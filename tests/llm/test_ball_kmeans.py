import hashlib
import math

import numpy as np
import pytest

from heliograph.llm.ball_kmeans import ORACLE_SQL, RESULT, Balls, ball_kmeans, kept_vectors, largest, op11_ball_kmeans
from heliograph.llm.common import Workspace
from tests.llm.helpers import same_rows

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, dims, k, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    mark = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(((mark(i), v) for i, v in kept))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted((i is not None, i or 0, *reversed(nearest(v))) for i, v in kept), centroids


@pytest.mark.parametrize("seed,spread", [(1, 0.05), (2, 1.0), (3, 40.0)])
def test_rounds_equal_brute_force(spark, tmp_path, seed, spread):
    rng = np.random.default_rng(seed)
    homes = rng.normal(size=(5, 4)) * spread
    rows = [(i, (homes[i % 5] + rng.normal(size=4) * 0.3).tolist()) for i in range(400)] + [(9, [0.5] * 4)] * 150 + [(None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).repartition(7)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found, centroids = ball_kmeans(kept_vectors(df, 4), Workspace(spark, "t"), k=7)
    want, want_centroids = brute(rows, 4, 7)
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect()) == want
    assert centroids.tolist() == want_centroids


def test_members_are_compared_with_neighbours_only():
    """Three far balls: no member leaves the stable core, and no distance to another centroid is taken."""
    rng = np.random.default_rng(4)
    homes = np.array([[0, 0], [1000, 0], [0, 1000]])
    cluster = np.repeat([0, 1, 2], 50)
    v = homes[cluster] + rng.integers(-20, 20, (150, 2))
    balls = Balls(homes, [30, 30, 30])
    assert [len(x) for x in balls.neighbours] == [0, 0, 0]
    taken = []
    plain = Balls.distances
    balls.distances = lambda rows, c: (taken.append(len(rows)), plain(balls, rows, c))[1]
    found, _ = balls.assign(v, cluster)
    assert found.tolist() == cluster.tolist() and taken == [150]
    # the annuli: a member nearer than half the way is compared with none, a farther one with the first neighbours it reaches
    balls = Balls(np.array([[0], [100], [300]]), [400, 400, 400])
    assert balls.assign(np.array([[10], [49], [50], [51], [160], [290]]), np.zeros(6, np.int64))[0].tolist() == [0, 0, 0, 1, 1, 2]


def test_ties_and_large_components():
    balls = Balls(np.array([[4, 0], [-4, 0], [4, 0]]), [None] * 3)
    for start in range(3):
        found, d = balls.assign(np.array([[0, 3], [4, 0]]), np.full(2, start))
        assert found.tolist() == [0, 0] and d.tolist() == [25, 0]
    most = largest(2)
    far = Balls(np.array([[most - 1, most - 1], [1 - most, 1 - most]]), [None] * 2)
    assert far.assign(np.array([[-most + 1, most - 1], [1 - most, 2 - most]]), np.zeros(2, np.int64))[1].tolist() == [4 * (most - 1) ** 2, 1]


def test_cases(spark, tmp_path):
    nan, inf, one = float("nan"), float("inf"), [1.0] * 64
    rows = [(1, one, 0), (2, None, 0), (3, one[:63], 0), (4, [nan] + one[1:], 0), (5, [inf] + one[1:], 0), (6, [None] + one[1:], 0), (7, [-0.01] * 64, 0), (8, [], 0), (1, one, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "cluster")
    assert sorted((r.vec_id, r.v[0]) for r in kept_vectors(df).collect()) == [(1, 64), (1, 64), (7, -1)]
    df.withColumnRenamed("cluster", "distance").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = op11_ball_kmeans(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in found) == [(1, 0, 0), (1, 0, 0), (7, 0, 0)]
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    empty = op11_ball_kmeans(spark, str(tmp_path))
    assert empty.collect() == [] and empty.schema == spark.createDataFrame([], RESULT).schema
    with pytest.raises(Exception, match="too large"):
        kept_vectors(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA)).collect()


def test_query(spark, sf):
    assert same_rows(op11_ball_kmeans(spark, sf), ORACLE_SQL, sf) == 500
