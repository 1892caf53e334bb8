"""Centroid clustering of integer vectors: plain Lloyd rounds.

Centroids (a few rows) go to the tasks with the function that uses them. A task adds up its vectors and their number for
each centroid; only these sums are shuffled, at most one row for each task and centroid, so a cluster that
holds most vectors is no hot spot. All arithmetic is on whole numbers, so reruns agree whatever the partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components lie below this size, so that squared distances of up to 128 components fit 64 bits.
LARGEST = 2**27


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has ``width`` components, all of them finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & fine, F.lit(False))


def grid(vectors: pd.Series, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all components, one row a vector."""
    if not len(vectors):
        return np.empty((0, width), np.int64)
    x = np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * scale)
    if np.abs(x).max(initial=0) >= LARGEST:
        raise ValueError(f"a component times {scale} is not below {LARGEST}: its squares could overflow")
    return x.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest-numbered nearest centroid of each row, and the squared distance to it."""
    d = np.empty((len(x), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        difference = x - centroid
        d[:, c] = np.einsum("ij,ij->i", difference, difference)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def starts(rows: DataFrame, k: int, seed: str) -> DataFrame:
    """The k rows whose ``seed`` + id (in decimal) has the smallest SHA-256; rows without an id come last, ties by vector."""
    key = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    return rows.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "vector").limit(k)


def moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round; one without vectors stays."""
    k, width = centroids.shape

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            x = grid(frame["vector"], width, scale)
            best, _ = nearest(x, centroids)
            counts += np.bincount(best, minlength=k)
            for c in np.unique(best):
                sums[c] += x[best == c].sum(axis=0)
        here = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": here, "n": counts[here], "sums": list(sums[here])})

    parts = rows.select("vector").mapInPandas(task, "cluster long, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for cluster, at, s, n in totals.collect():  # one row a component of a centroid at most
        out[cluster, at] = s // n
    return out


def lloyd(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1:") -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Vectors that are null, of another width than ``width``, or hold null or non-finite components take no part. Components
    x become floor(scale * x); one of 2**27 or more is an error. The starting centroids are the k vectors with
    the smallest hashes of their ids (all, if there are fewer). In a round all vectors go to
    their nearest centroid (squared distance; ties: smallest number), whose components become floor(sum / count). Repeated rows each
    count and come out repeatedly; so do rows without an id. No usable vectors give no rows.
    """
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector"), width))
    first = starts(rows, k, seed).select("vector").collect()  # k rows
    centroids = grid(pd.Series([np.array(r[0]) for r in first], dtype=object), width, scale)
    for _ in range(rounds if len(first) else 0):
        centroids = moved(rows, centroids, scale)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best, distance = nearest(grid(frame["vector"], width, scale), centroids)
            yield pd.DataFrame({"id": frame["id"], "cluster": best.astype(np.int32), "distance": distance})

    kind = rows.schema["id"].dataType.simpleString()
    found = written(rows.mapInPandas(assign, f"id {kind}, cluster int, distance long"))
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row a centroid at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = table.sparkSession.createDataFrame([(c, d, sum(inertia.values()), digests[c]) for c, d in sorted(inertia.items())], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), F.col("cluster") == F.col("c")).select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
