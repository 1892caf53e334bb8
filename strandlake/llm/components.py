"""Connected components of a graph given by its edges, without collecting anything."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, written

#: Edges up to which a round's tables are made by 8 tasks (16 bytes an edge).
SMALL = 1_000_000
#: Edges of numbers up to which a task finishes what is left (8 MB); more are contracted in rounds until so few are left, or none.
FEW = 500_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of the edges, ascending, and the least node that each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if ends:
        for node, root in zip(*(np.array_split(x, len(x) // 10_000 + 1) for x in roots(*map(np.concatenate, zip(*ends))))):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "to"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of edges(a, b); nodes have equal roots if and only if they are connected.

    Each round contracts the graph: every node is merged into the one of itself and its neighbours
    that comes first in a random order, new in each round. A minimum over neighbours combines before
    the shuffle, so a node with very many edges is no hot spot. Once there are few edges left, one task
    finishes them. The rounds needed grow with the
    logarithm of the number of nodes; their merges are followed from node to root at the end. Edges to oneself and
    repeated edges do no harm; edges with a null end are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    with scratch(spark) as put:
        given = put(edges.select("a", "b").dropna().distinct())
        count = given.count()
        small, numbers = count <= SMALL, given.schema["a"].dataType == given.schema["b"].dataType == T.LongType()
        narrow = (lambda df: df.coalesce(8)) if small else (lambda df: df)
        e, steps = given.filter("a != b"), []
        while True:
            turn = len(steps)
            if numbers and count <= FEW:
                steps.append(put(e.coalesce(1).mapInArrow(_finished, "a long, to long")))
                break

            def order(c: str):
                return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))

            first = e.union(e.select("b", "a")).groupBy("a").agg(F.min(order("b")).alias("m"))
            step = put(narrow(first.select("a", F.least("m", order("a"))["id"].alias("to"))))
            if step.isEmpty():
                break
            steps.append(step)
            end = [step.select(F.col("a").alias(f"k{i}"), F.col("to").alias(f"to{i}")) for i in range(2)]
            e = put(narrow(e.join(end[0], F.col("a") == F.col("k0")).join(end[1], F.col("b") == F.col("k1")).select(F.col("to0").alias("a"), F.col("to1").alias("b")).filter("a != b").distinct()))
            count = e.count()
        total = given.select(F.col("a").alias("node")).union(given.select("b")).distinct().withColumn("root", F.col("node"))
        for step in steps:
            total = total.join(step.withColumnRenamed("a", "k"), F.col("root") == F.col("k"), "left").select("node", F.coalesce("to", "root").alias("root"))
        return written(narrow(total))
