import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import ann, queries
from strandlake.llm.ann import Curves, hilbert, search
from tests.conftest import DATA


@pytest.mark.parametrize("d,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_every_cell_by_single_steps(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    keys = hilbert(grid, bits)
    path = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(len(grid))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall_and_scores(spark, sf):
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(str(DATA / sf / "embeddings.parquet")).collect()}
    got = queries.op8_nearest_neighbours(spark, str(DATA / sf)).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in v if i % 50 == 0}
    ids = np.array(sorted(v))
    m = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids])
    hits = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and all(r["vec_id"] != q for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        assert all(r["score"] == pytest.approx(cosine(v[q], v[r["vec_id"]]), abs=1e-12) for r in rows)
        s = m @ (v[q] / np.linalg.norm(v[q]))
        s[ids == q] = -2
        hits += len({r["vec_id"] for r in rows} & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(by)


def test_odd_vectors(spark):
    good = [(i, [math.cos(i), math.sin(i), 0.5]) for i in range(4)]
    copies = [(i, [1.0, 2.0, 3.0]) for i in range(10, 30)]
    bad = [(50, None), (60, []), (70, [0.0, 0.0, 0.0]), (80, [1.0, None, 2.0]), (90, [1.0, float("nan"), 2.0]), (95, [1.0, float("inf"), 2.0]), (96, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (100, [3.0, 1.0, 2.0]), (100, [3.0, 1.0, 2.0])]
    df = spark.createDataFrame([*good, *copies, *bad], "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS score")
    got = {}
    for r in sorted(search(df, F.col("id") % 10 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 10, 20, 100}
    assert got[20] == [10, 11, 12, 13, 14] and got[10] == [11, 12, 13, 14, 15] and 100 not in got[100]  # ties to smaller ids
    few = search(df.filter("vec_id < 3"), F.col("id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert search(df.limit(0), F.lit(True)).collect() == [] and search(df.filter("vec_id = 1"), F.lit(True)).collect() == []


def test_hot_cells_are_split(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in search(df, F.col("id") % 50 == 0, curves=Curves(block=8)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [i for _, i in sorted(got[1050])] == [1000, 1001, 1002, 1003, 1004]


def test_repeated_rows_leave_room_for_other_ids(spark):
    rng = np.random.default_rng(1)
    once = [(i, rng.standard_normal(4).tolist()) for i in range(40)]
    df = spark.createDataFrame(once * 5 + [(3, [9.0, 1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    every = once + [(3, [9.0, 1.0, 0.0, 0.0])]
    got = {}
    for r in search(df, F.col("id") == 0, curves=Curves()).collect():
        got[r["rank"]] = (r["vec_id"], pytest.approx(r["score"], abs=1e-12))
    best = {}
    for i, v in every[1:]:
        best[i] = max(best.get(i, -2), cosine(once[0][1], v))
    assert [got[k] for k in range(1, 6)] == sorted(best.items(), key=lambda x: -x[1])[:5]


def clustered(n, seed=2):
    """Vectors around many centers, 20 each."""
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((n // 20, 32))
    return (np.repeat(centers, 20, axis=0) + 0.05 * rng.standard_normal((n, 32))).astype(np.float32)


def test_windows_follow_the_vectors_and_not_the_table(spark, monkeypatch):
    """Where vectors have structure the window is a number of rows that stays, and recall is kept; what blocks hold grows in proportion."""
    reach, held = [], []
    for n in (2_000, 8_000):
        v = clustered(n)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
        seen, real = [], ann._reach
        monkeypatch.setattr(ann, "_reach", lambda *a: seen.append(real(*a)) or seen[-1])
        got = search(df, F.col("id") % 50 == 0).collect()
        monkeypatch.setattr(ann, "_reach", real)
        m = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
        found = {(r["query_id"], r["vec_id"]) for r in got}
        hits = 0
        for q in range(0, n, 50):
            s = m @ m[q]
            s[q] = -2
            hits += sum((q, int(i)) in found for i in np.argsort(-s)[:5])
        assert hits >= 0.9 * 5 * (n // 50)
        reach += seen
        held.append(len(got))
    assert reach[0] < 200 and reach[1] < 2 * reach[0] + 50 and held[1] == 4 * held[0]


def test_ranks(spark):
    df = spark.range(500).withColumnRenamed("id", "vec_id")
    ranked = ann._ranked(df.selectExpr("true AS d", "vec_id AS id", "vec_id AS h", "array(vec_id * 7 % 500, -vec_id) AS keys"), 2).collect()
    assert {(r["t"], r["id"]): r["rank"] for r in ranked} == {(0, i): i * 7 % 500 for i in range(500)} | {(1, i): 499 - i for i in range(500)}


def test_large_and_tiny_components(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [2.0, 1.0]), (4, [5e-324, 0.0]), (5, [1.7e308, 1.7e308])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 1).collect()
    assert [(r["vec_id"], round(r["score"], 9)) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 1.0), (5, 0.948683298), (3, 0.8), (4, 0.447213595)]
