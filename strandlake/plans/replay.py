"""Bounded replays of many batches in one plan: what the stateful operators show after each batch.

Every row carries the number of its batch (column ``batch``). The results are closed forms over whole
tables, not loops over batches; they equal what :mod:`strandlake.operators.stateful` shows batch by batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Aggregate, Aggregation
from ..operators.relational import WINDOW_END, WINDOW_START, interval_join, windowed
from ..records import PARTITION, TIMESTAMP

BATCH = "batch"


def replay_group_by(df: DataFrame, keys: Sequence[str], aggregations: Sequence[Aggregation], size: int | None = None, retention: int | None = None) -> DataFrame:
    """The output of a cumulative grouping after each batch: batch, partition, keys (and window), aggregates.

    Rows are combined to one state a batch and group first; running states follow from a window over
    a group's own batches, and each is shown until the next one. With ``size``, a window is shown as
    long as its end is not before the partition's stream time less ``retention``.
    """
    rows = windowed(df, size) if size else df
    groups = [PARTITION, *[k for k in keys if k != PARTITION], *([WINDOW_START, WINDOW_END] if size else [])]
    names = [f"__s{i}" for i in range(len(aggregations))]
    states = rows.groupBy(BATCH, *groups).agg(*[a.partial(df.schema).alias(n) for a, n in zip(aggregations, names)])
    # A partition's batches, numbered without gaps: it is evaluated only where it has rows.
    batches = df.groupBy(F.col(PARTITION).alias("__p"), F.col(BATCH).alias("__b"))
    batches = batches.agg(F.max(TIMESTAMP).alias("__max")) if size else batches.agg(F.lit(0).alias("__max"))
    in_order = Window.partitionBy("__p").orderBy("__b")
    batches = batches.withColumn("__n", F.row_number().over(in_order)).withColumn("__st", F.max("__max").over(in_order)).withColumn("__last", F.count("*").over(Window.partitionBy("__p")))
    numbered = states.join(batches.select("__p", "__b", "__n", "__last"), F.col(PARTITION).eqNullSafe(F.col("__p")) & (F.col(BATCH) == F.col("__b"))).drop("__p", "__b")
    upto = Window.partitionBy(*groups).orderBy("__n")
    running = {Aggregate.COUNT: F.sum, Aggregate.SUM: F.sum, Aggregate.MIN: F.min, Aggregate.MAX: F.max}
    for a, n in zip(aggregations, names):
        numbered = numbered.withColumn(n, running[a.function](n).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    until = F.coalesce(F.lead("__n").over(upto) - 1, F.col("__last"))
    shown = numbered.withColumn("__until", until).withColumn("__at", F.explode(F.sequence("__n", "__until"))).drop(BATCH, "__n", "__last", "__until")
    times = batches.select("__p", F.col("__n").alias("__at2"), F.col("__b").alias(BATCH), "__st")
    out = shown.join(times, F.col(PARTITION).eqNullSafe(F.col("__p")) & (F.col("__at") == F.col("__at2")))
    if size:
        out = out.filter(F.col(WINDOW_END) >= F.col("__st") - (size if retention is None else retention))
    return out.select(BATCH, *groups, *[a.result(F.col(n).cast(a.state_type(df.schema)), df.schema).alias(a.output) for a, n in zip(aggregations, names)])


def replay_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, left_prefix: str = "left_", right_prefix: str = "right_") -> DataFrame:
    """All pairs of an interval join over batches, with the batch that shows them.

    A pair of batches i and j shows when the later one comes, if they are one, or the earlier row's
    retained batch was not dropped: its latest timestamp is not before the stream time then, less
    the window. ``batch`` is a payload column on both sides.
    """
    both = left.select(PARTITION, BATCH, TIMESTAMP).union(right.select(PARTITION, BATCH, TIMESTAMP))
    in_order = Window.partitionBy("__p").orderBy("__b")
    times = both.groupBy(F.col(PARTITION).alias("__p"), F.col(BATCH).alias("__b")).agg(F.max(TIMESTAMP).alias("__m")).select("__p", "__b", F.max("__m").over(in_order).alias("__st"))

    def with_latest(df: DataFrame) -> DataFrame:
        latest = df.groupBy(F.col(PARTITION).alias("__p"), F.col(BATCH).alias("__b")).agg(F.max(TIMESTAMP).alias("__latest"))
        return df.join(latest, F.col(PARTITION).eqNullSafe(F.col("__p")) & (F.col(BATCH) == F.col("__b"))).drop("__p", "__b")

    pairs = interval_join(with_latest(left), with_latest(right), left_key, right_key, window, left_prefix, right_prefix)
    i, j = F.col(left_prefix + BATCH), F.col(right_prefix + BATCH)
    pairs = pairs.withColumn("__shown", F.greatest(i, j)).withColumn("__kept", F.when(i < j, F.col(f"{left_prefix}__latest")).otherwise(F.col(f"{right_prefix}__latest")))
    out = pairs.join(times, F.col(PARTITION).eqNullSafe(F.col("__p")) & (F.col("__shown") == F.col("__b"))).filter((i == j) | (F.col("__kept") >= F.col("__st") - window))
    return out.drop("__p", "__b", "__st", "__kept", f"{left_prefix}__latest", f"{right_prefix}__latest").withColumnRenamed("__shown", BATCH)
