import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import clusters, queries
from tests.conftest import DATA

COLUMNS = "vec_id long, embedding array<float>, cluster string, id string, distance string"


def brute(rows, k, rounds, width, scale=64):
    """Plain Python, one vector at a time."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), rows_of[r[0]])
    rows_of = {i: v for i, v in kept}
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    of = lambda n: sum(d for _, d, m in found if m == n)
    return sorted(((i, n, d, of(n), sum(d for _, d, _ in found), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(str(DATA / "sf0.01" / "embeddings.parquet")).select("vec_id", "embedding").collect()]
    assert result(queries.op11_centroid_clustering(spark, str(DATA / "sf0.01"))) == brute(rows, 16, 3, 64)


def test_odd_vectors(spark):
    rng = random.Random(5)
    good = [(i, [rng.choice([-1.0, -0.01, 0.0, 0.5, 3.0]) for _ in range(4)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 1.0, 1.0]), (104, [float("nan")] + [0.0] * 3), (105, [float("-inf")] + [0.0] * 3), (106, [1.0] * 5)]
    rows = good + good[:7] + [(None, good[3][1])] + odd
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], COLUMNS).repartition(5)
    for k, rounds in ((5, 3), (3, 0), (80, 2)):
        got = result(clusters.lloyd(df, k=k, rounds=rounds, width=4))
        assert got == brute(rows, k, rounds, 4)
    assert clusters.lloyd(df.filter("vec_id >= 100"), width=4).collect() == []
    assert clusters.lloyd(df.limit(0), width=4).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ties_go_to_the_lowest_and_empty_centroids_stay():
    x = np.array([[0, 0], [2, 0], [1, 0]])
    best, distance = clusters.nearest(x, np.array([[0, 0], [2, 0], [0, 0]]))
    assert best.tolist() == [0, 1, 0] and distance.tolist() == [0, 0, 1]


def test_sums_of_one_cluster_are_few_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5) for _ in range(4)]).cast("array<float>").alias("embedding"))
    rows = result(clusters.lloyd(df, k=3, width=4))
    assert {r[1:5] for r in rows} == {(0, 0, 0, 0)} and len(rows) == 20_000


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [4e6, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="could overflow"):
        clusters.lloyd(df, width=4).collect()
