"""Spark's own streaming operators for the same questions: cheaper, with Spark's rules for late data.

The watermark is one for all partitions and moves after a batch; a window is dropped when its end is
not after it. Append mode shows closed windows once, update mode the groups that changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.aggregates import Aggregation
from ..operators.relational import WINDOW_END, WINDOW_START
from ..records import PARTITION, TIMESTAMP

EVENT_TIME = "__event_time"


def with_event_time(df: DataFrame, retention: int) -> DataFrame:
    return df.withColumn(EVENT_TIME, F.timestamp_millis(TIMESTAMP)).withWatermark(EVENT_TIME, f"{retention} milliseconds")


def windowed_group_by(df: DataFrame, keys: Sequence[str], size: int, *aggregations: Aggregation, retention: int | None = None) -> DataFrame:
    """Tumbling windows of a streaming frame of records."""
    rows = with_event_time(df, size if retention is None else retention)
    grouped = rows.groupBy(*keys, PARTITION, F.window(EVENT_TIME, f"{size} milliseconds").alias("__w"))
    states = grouped.agg(*[a.partial(df.schema).alias(f"__s{i}") for i, a in enumerate(aggregations)])
    return states.select(*keys, F.unix_millis("__w.start").alias(WINDOW_START), F.unix_millis("__w.end").alias(WINDOW_END), *[a.result(F.col(f"__s{i}"), df.schema).alias(a.output) for i, a in enumerate(aggregations)], PARTITION)


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, how: str = "inner") -> DataFrame:
    """Stream-stream interval join with watermarks as wide as the window. Columns get the prefixes left_ and right_."""
    a, b = (with_event_time(d, window).select(*[F.col(c).alias(p + c) for c in [*d.columns, EVENT_TIME]]) for d, p in ((left, "left_"), (right, "right_")))
    span = F.expr(f"INTERVAL '{window / 1000:.3f}' SECOND")
    lt, rt = F.col("left_" + EVENT_TIME), F.col("right_" + EVENT_TIME)
    on: Column = (F.col("left_" + PARTITION) == F.col("right_" + PARTITION)) & (F.col("left_" + left_key) == F.col("right_" + right_key)) & (rt >= lt - span) & (rt <= lt + span)
    return a.join(b, on, how).drop("left_" + EVENT_TIME, "right_" + EVENT_TIME)


class _Blob(StatefulProcessor):
    """A partition's custom operator with its snapshot in a state variable, and timers if asked."""

    def __init__(self, factory: Callable, columns: list[str], every: int | None, wall: bool):
        self.factory, self.columns, self.every, self.wall = factory, columns, every, wall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("snapshot", T.StructType([T.StructField("data", T.BinaryType())]))

    def _own(self):
        processor = self.factory()
        if self.state.exists():
            processor.restore(bytes(self.state.get()[0]))
        return processor

    def _now(self, timer_values) -> int:
        return timer_values.getCurrentProcessingTimeInMs() if self.wall else timer_values.getCurrentWatermarkInMs()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)  # the whole micro-batch of the partition, before anything is processed
        processor = self._own()
        outs = processor.process(pd.concat(frames, ignore_index=True)) if frames else []
        self.state.update((processor.snapshot(),))
        if self.every:
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(max(self._now(timerValues), 0) + self.every)
        for o in outs:
            yield o[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        processor = self._own()
        outs = processor.punctuate(expiredTimerInfo.getExpiryTimeInMs()) if hasattr(processor, "punctuate") else []
        self.state.update((processor.snapshot(),))
        self.handle.registerTimer(max(self._now(timerValues), 0) + self.every)
        for o in outs:
            yield o[self.columns]

    def close(self) -> None:
        return None


def stateful_operator(df: DataFrame, factory: Callable, schema: T.StructType, output_mode: str = "append", every: int | None = None, wall_clock: bool = True) -> DataFrame:
    """A custom operator with state for each logical partition of a streaming frame.

    ``factory`` makes objects with process(frame) -> frames, snapshot() -> bytes, restore(bytes) and, with
    timers ``every`` so many milliseconds, punctuate(ms) -> frames. Timers go by wall-clock time, or by
    stream time (then ``df`` needs a watermark, as :func:`with_event_time` sets it). Needs the RocksDB state
    store provider.
    """
    mode = "None" if not every else "ProcessingTime" if wall_clock else "EventTime"
    return df.groupBy(PARTITION).transformWithStateInPandas(_Blob(factory, schema.names, every, wall_clock), schema, output_mode, mode)


def read_state(spark, checkpoint: str, **options) -> DataFrame:
    """The state store of a streaming query, by its checkpoint: keys and values of an operator (interactive queries).

    Options as the state reader has them: operatorId, batchId, storeName, joinSide, stateVarName.
    """
    return spark.read.format("statestore").options(**{k: str(v) for k, v in options.items()}).load(checkpoint)
