"""Approximate nearest neighbours (largest cosine) with shifted space-filling curves.

Unit vectors are projected by several random maps onto few dimensions, shifted, and laid along a
Hilbert curve each. Every ordering is range-partitioned by the curve's keys, and rows get their ranks in
it. A query looks at the rows within a window of ranks around its own place, in all orderings, and the
finds are merged and ranked by the exact cosine. How wide the windows are is calibrated: a bounded sample
of rows gets its true neighbours among all rows, and the window is the least distance in ranks that
holds ``recall`` of them. So a window is a number of rows that depends on how the vectors lie, and
grows with the table only where they lie without structure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, near


@dataclass(frozen=True)
class Curves:
    """Number of orderings, dimensions and bits of each curve; rows of a sample that fits the curves' ranges,
    and of one whose neighbours calibrate the window; recall aimed at; most rows and queries of a block.
    """

    orderings: int = 8
    dims: int = 6
    bits: int = 8
    sample: int = 4096
    asked: int = 256
    recall: float = 0.95
    block: int = 4096
    seed: int = 42


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, d), each coordinate below 2**bits; d * bits <= 63.

    The coordinates are turned, bit plane by bit plane, into the transposed index: a plane's set bit
    flips the first coordinate's lower bits, a clear one swaps them with the first coordinate's;
    then the planes are Gray-decoded and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[i] >> b & 1
    return key


@dataclass
class Orderings:
    """The fitted projections of each ordering."""

    curves: Curves
    maps: np.ndarray  # (orderings, dims, vector dims)
    low: np.ndarray  # (orderings, dims)
    step: np.ndarray

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, orderings) places on the curves."""
        most = (1 << self.curves.bits) - 1
        return np.stack([hilbert(np.clip(np.floor((unit @ m.T - low) / step), 0, most), self.curves.bits) for m, low, step in zip(self.maps, self.low, self.step)], axis=1)


def prepare(sample: np.ndarray, curves: Curves) -> Orderings:
    rng = np.random.default_rng(curves.seed)
    maps = np.stack([np.linalg.qr(rng.standard_normal((sample.shape[1], max(curves.dims, 1))))[0].T[: curves.dims] for _ in range(curves.orderings)])
    p = np.einsum("tdv,nv->tnd", maps, sample)
    low, high = p.min(axis=1), p.max(axis=1)
    width = np.maximum(high - low, 1e-9) * 1.25
    shift = rng.random(low.shape) * 0.25 * width / 1.25
    return Orderings(curves, maps, low - shift, width / (1 << curves.bits))


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest ids of ``rows`` for each query, its own left out: query ids, ids, cosines. An id counts once, by its nearest row.

    A matrix product preselects; the cosines are then computed pair by pair, always in the same
    order of operations, so equal vectors have equal cosines and ties go to the smaller id.
    """
    norm = np.sqrt((rows * rows).sum(axis=1))
    qnorm = np.sqrt((queries * queries).sum(axis=1))
    order = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] - 1))
    repeated = len(starts) < len(ids)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), 256):
        rough = (queries[a : a + 256] / qnorm[a : a + 256, None]) @ (rows / norm[:, None]).T
        for i, r in enumerate(rough, a):
            r[ids == query_ids[i]] = -2
            # Repeats of an id must not take others' places: an id's best row stands for it.
            top = np.maximum.reduceat(r[order], starts) if repeated else r
            least = np.partition(top, -k)[-k] if len(top) > k else -1.5
            at = np.flatnonzero(r >= max(least - 1e-9, -1.5))
            exact = (rows[at] * queries[i]).sum(axis=1) / (norm[at] * qnorm[i])
            by = np.lexsort((ids[at], -exact))
            if repeated:
                by = by[np.sort(np.unique(ids[at][by], return_index=True)[1])]
            by = by[:k]
            out.append((np.full(len(by), query_ids[i]), ids[at][by], exact[by]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, each times a power of two, so that no square overflows or vanishes; cosines stay the same."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    m = np.asarray(flat, np.float64).reshape(-1, dim)
    _, exponent = np.frexp(np.abs(m).max(axis=1, initial=0))
    half = exponent // 2  # twice, for a power of two may itself be out of range
    return np.ldexp(np.ldexp(m, -half[:, None]), (half - exponent)[:, None])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their dimension.

    Left out: null ids and vectors, vectors with a null, NaN or infinite component, zero vectors,
    and those of another dimension than the most frequent one (ties: the larger).
    """
    v = F.col("v")
    own = vectors.schema[vector_col].dataType.simpleString()
    kind = own if own in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).filter("id is not null and v is not null")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(fine)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = top[0]["d"] if top else 0
    return rows.filter(F.size("v") == dim), dim


ENTRIES = "t int, d boolean, id long, h long, rank long"


def _ranked(placed: DataFrame, orderings: int) -> DataFrame:
    """``ENTRIES`` for placed(d, id, h, keys): how many rows with ``d`` lie before each row in each ordering.

    The keys are range-partitioned and counted in each partition; the partitions' counts, a row for each
    partition and ordering, make the places in the whole.
    """
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = placed.select("d", "id", "h", F.posexplode("keys").alias("t", "key"))
    sorted_ = entries.repartitionByRange(n, "t", "key", "id", "h", "d").sortWithinPartitions("t", "key", "id", "h", "d")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = np.zeros(orderings, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            t, d = batch.column("t").to_numpy(), batch.column("d").to_numpy(zero_copy_only=False)
            rank = np.zeros(len(t), np.int64)
            for k in np.unique(t):
                own = t == k
                rank[own] = at[k] + np.cumsum(d[own]) - d[own]
                at[k] += d[own].sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), part, np.int32)), *[batch.column(c) for c in ("t", "d", "id", "h")], pa.array(rank)], ["part", "t", "d", "id", "h", "rank"])

    local = checkpointed(sorted_.mapInArrow(count, "part int, t int, d boolean, id long, h long, rank long"))
    before = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = local.groupBy("t", "part").agg(F.sum(F.col("d").cast("long")).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = near(checkpointed(starts.select("t", "part", "start")))
    return local.join(starts, ["t", "part"]).select("t", "d", "id", "h", (F.col("rank") + F.col("start")).alias("rank"))


def _reach(data: DataFrame, ranked: DataFrame, asked: tuple[np.ndarray, np.ndarray], k: int, curves: Curves, dim: int) -> int:
    """The window: the ranks within which ``curves.recall`` of the true neighbours of ``asked`` (ids, vectors) lie in some ordering."""
    spark = data.sparkSession
    shared = spark.sparkContext.broadcast(asked)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for batch in batches:
            q_, ids, s = best(q_ids, q, batch.column("id").to_numpy(), _matrix(batch.column("v"), dim), k)
            yield pa.RecordBatch.from_arrays([pa.array(q_), pa.array(ids), pa.array(s)], ["q", "id", "s"])

    order = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    pairs = data.mapInArrow(task, "q long, id long, s double").groupBy("q", "id").agg(F.max("s").alias("s"))
    true = pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("q", "id").toArrow()
    q, ids = true.column("q").to_numpy(), true.column("id").to_numpy()
    if not len(q):
        return 1
    named = spark.createDataFrame([(int(i),) for i in sorted({*q.tolist(), *ids.tolist()})], "id long")
    got = ranked.filter("d").join(F.broadcast(named), "id").groupBy("id", "t").agg(F.min("rank").alias("rank")).toArrow()
    rank = {(i, t): r for i, t, r in zip(*(got.column(c).to_pylist() for c in ("id", "t", "rank")))}
    apart = [min(abs(rank[a, t] - rank[b, t]) for t in range(curves.orderings)) for a, b in zip(q.tolist(), ids.tolist())]
    return max(1, int(np.quantile(apart, curves.recall, method="higher")))


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, curves: Curves = Curves()) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``queries`` (a condition on ``id``) selects.

    Columns: query_id, rank (from 1), vec_id, score (cosine in double precision); nearest first,
    ties to the smaller id. Rows that can't take part (see :func:`usable`) are neither queries nor
    found. Rows with the query's id are its own; other repeated ids count once, by their
    nearest row. Of equal vectors the k + 1 with the smallest ids are indexed: no query can
    return another. Ids are cast to long. An empty table gives no rows.

    Windows are made of cells of as many ranks as the window is wide, at least a 16th of the rows or 1,024:
    a query sees its own cell and both neighbours. Cells and their queries are dealt to blocks of bounded size.
    """
    rows, dim = usable(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    rows = checkpointed(rows.withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "h"]))
    first = Window.partitionBy("h").orderBy("id")
    data = checkpointed(rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).select("id", "h", "v"))
    total = data.count()
    if total < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def some(most: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """About ``most`` rows, chosen by hash, at least two."""
        h = F.shiftrightunsigned(F.xxhash64("id", F.lit(salt)), 34)
        got = data.filter(h < F.lit(round(min(1.0, most / total) * (1 << 30)))).select("id", "v").toArrow()
        got = got if len(got) > 1 else data.select("id", "v").limit(2).toArrow()
        return got.column("id").to_numpy(), _matrix(got.column("v"), dim)

    fitted = prepare(_unit(some(curves.sample, curves.seed)[1]), curves)
    shared = spark.sparkContext.broadcast(fitted)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = shared.value.keys(_unit(_matrix(batch.column("v"), dim)))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1]), pa.int32()), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("id"), batch.column("h"), keys], ["d", "id", "h", "keys"])

    asked = rows.filter(F.coalesce(queries, F.lit(False)))
    both = data.select(F.lit(True).alias("d"), "id", "h", "v").union(asked.select(F.lit(False).alias("d"), "id", "h", "v"))
    ranked = checkpointed(_ranked(both.mapInArrow(locate, "d boolean, id long, h long, keys array<long>"), curves.orderings))
    cell = max(_reach(data, ranked, some(curves.asked, curves.seed + 1), k, curves, dim), min(1024, total // 16), 4 * k)
    cells = (total - 1) // cell + 1
    # Blocks: the rows of a cell by rank, the queries of an ordering by rank among themselves.
    of_data = ranked.filter("d").select("t", "id", "h", F.floor(F.col("rank") / cell).alias("cell"), F.floor(F.col("rank") % cell / curves.block).alias("r"))
    of_asked = ranked.filter("not d").select("t", "id", "h", F.least(F.floor(F.col("rank") / cell), F.lit(cells - 1)).alias("own"))
    of_asked = of_asked.withColumn("cell", F.explode(F.sequence(F.greatest(F.col("own") - 1, F.lit(0)), F.least(F.col("own") + 1, F.lit(cells - 1))))).drop("own")
    many = of_asked.groupBy("t", "cell").agg(F.ceil(F.count("*") / curves.block).cast("int").alias("parts"))
    many = near(checkpointed(many))
    upto = (cell - 1) // curves.block
    of_data = of_data.join(many, ["t", "cell"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("t", "cell", "r", "b", "id", "h")
    of_asked = of_asked.join(many, ["t", "cell"]).withColumn("b", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(upto)))).select("t", "cell", "r", "b", "id", "h")
    of_data = of_data.join(data, ["id", "h"]).select("t", "cell", F.col("r").cast("int").alias("r"), "b", F.lit(False).alias("q"), "id", "v")
    of_asked = of_asked.join(asked, ["id", "h"]).select("t", "cell", "r", "b", F.lit(True).alias("q"), "id", "v")

    def block(table: pa.Table) -> pa.Table:
        q = table.column("q").to_numpy()
        ids, v = table.column("id").to_numpy(), _matrix(table.column("v"), dim)
        a, b, s = best(ids[q], v[q], ids[~q], v[~q], k) if not q.all() else best(ids[:0], v[:0], ids, v, k)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    found = of_data.union(of_asked).groupBy("t", "cell", "r", "b").applyInArrow(block, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
