"""Operators that keep state from batch to batch, as DataFrames keyed by logical partition.

``process(batches, state)`` gets one frame for each parent and the frames it returned as state last
time (none at first), and returns its output and its new state. State is whatever combines: partial
aggregates and stream times for groupings, retained rows for joins. Each partition's rows carry
its number, so one job serves all partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LakeError
from ..functions.aggregates import Aggregation
from ..records import PARTITION, require
from .relational import WINDOW_END, WINDOW_START, _own, _sides, interval_join, stream_time, windowed

State = dict[str, DataFrame]


class Operator:
    """Base: one output batch for each evaluation."""

    #: Whether :meth:`process` uses state.
    stateful = False

    def process(self, batches: list[DataFrame], state: State) -> tuple[DataFrame, State]:
        raise NotImplementedError


@dataclass
class Stateless(Operator):
    """A function from a batch to a batch."""

    function: Callable[[DataFrame], DataFrame]

    def process(self, batches: list[DataFrame], state: State) -> tuple[DataFrame, State]:
        return self.function(batches[0]), {}


@dataclass
class GroupBy(Operator):
    """Cumulative aggregates: each batch's output has every group seen so far.

    With ``size``: by tumbling windows of event time. A partition's stream time takes in the whole
    batch first; then windows that end before it less ``retention`` go, old and new.
    """

    keys: Sequence[str]
    aggregations: Sequence[Aggregation]
    size: int | None = None
    retention: int | None = None
    #: Emit only the groups that the batch touched (and that are retained).
    changed_only: bool = False
    stateful = True
    _schema: T.StructType | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not self.keys:
            raise LakeError("group_by needs at least one key")
        if self.size is not None:
            self.retention = self.size if self.retention is None else self.retention
            if self.size < 1 or self.retention < self.size:
                raise LakeError("a window needs a millisecond at least, and retention at least the window size")

    def process(self, batches: list[DataFrame], state: State) -> tuple[DataFrame, State]:
        (df,) = batches
        require(df, *self.keys, *[a.input for a in self.aggregations])
        self._schema = self._schema or df.schema
        scope = [PARTITION] if PARTITION in df.columns else []
        rows = windowed(df, self.size) if self.size else df
        groups = [*self.keys, *([WINDOW_START, WINDOW_END] if self.size else []), *[c for c in scope if c not in self.keys]]
        names = [f"__s{i}" for i in range(len(self.aggregations))]
        partial = rows.groupBy(*groups).agg(*[a.partial(df.schema).alias(n) for a, n in zip(self.aggregations, names)])
        new = partial.withColumn("__new", F.lit(True))
        if "groups" in state:
            new = new.unionByName(state["groups"].withColumn("__new", F.lit(False)))
        merged = new.groupBy(*groups).agg(*[a.merged(n).alias(n) for a, n in zip(self.aggregations, names)], F.max("__new").alias("__new"))
        keep: State = {}
        if self.size:
            own = F.col(PARTITION) if scope else F.lit(0)
            time = stream_time(df)
            if "time" in state:
                time = time.union(state["time"]).groupBy("__p").agg(F.max("__st").alias("__st"))
            keep["time"] = time
            merged = merged.join(F.broadcast(time), own.eqNullSafe(F.col("__p"))).filter(F.col(WINDOW_END) >= F.col("__st") - self.retention).drop("__p", "__st")
        keep["groups"] = merged.drop("__new")
        shown = merged.filter("__new") if self.changed_only else merged
        # A partition without rows in this batch is not evaluated, and shows nothing.
        if scope and "groups" in state:
            here = df.select(F.col(PARTITION).alias("__here")).distinct()
            shown = shown.join(F.broadcast(here), F.col(PARTITION).eqNullSafe(F.col("__here")), "left_semi")
        out = shown.select(*self.keys, *([WINDOW_START, WINDOW_END] if self.size else []), *[a.result(F.col(n), self._schema).alias(a.output) for a, n in zip(self.aggregations, names)], *[c for c in scope if c not in self.keys])
        return out, keep


@dataclass
class IntervalJoin(Operator):
    """Event-time interval join across batches.

    A batch's rows advance their partition's one stream time on both sides; retained batches whose
    latest row lies before it less the window are dropped whole; then new rows meet retained and
    new ones of the other side. Late rows still meet what is retained.
    """

    left_key: str
    right_key: str
    window: int
    left_prefix: str = "left_"
    right_prefix: str = "right_"
    stateful = True

    def __post_init__(self) -> None:
        if self.window < 0:
            raise LakeError("a join window can't be negative")

    def process(self, batches: list[DataFrame], state: State) -> tuple[DataFrame, State]:
        left, right = batches
        _sides(left, right, self.left_key, self.right_key, self.window, self.left_prefix, self.right_prefix)

        new_left, new_right = stream_time(left), stream_time(right)
        times = [new_left, new_right, *([state["time"]] if "time" in state else [])]
        time = reduce(DataFrame.union, times).groupBy("__p").agg(F.max("__st").alias("__st"))

        def stamped(df: DataFrame, its: DataFrame) -> DataFrame:
            return df.join(F.broadcast(its.withColumnRenamed("__st", "__batch_max")), _own(df).eqNullSafe(F.col("__p"))).drop("__p")

        def retained(name: str) -> DataFrame | None:
            if name not in state:
                return None
            old = state[name]
            return old.join(F.broadcast(time), _own(old).eqNullSafe(F.col("__p")), "left").filter(F.coalesce(F.col("__batch_max") >= F.col("__st") - self.window, F.lit(True))).drop("__p", "__st")

        old_left, old_right = retained("left"), retained("right")

        def join(a: DataFrame, b: DataFrame) -> DataFrame:
            return interval_join(a.drop("__batch_max"), b.drop("__batch_max"), self.left_key, self.right_key, self.window, self.left_prefix, self.right_prefix)

        out = [join(left, right)]
        if old_right is not None:
            out.append(join(left, old_right))
        if old_left is not None:
            out.append(join(old_left, right))
        keep = {"time": time, "left": stamped(left, new_left), "right": stamped(right, new_right)}
        if old_left is not None:
            keep["left"] = keep["left"].unionByName(old_left)
        if old_right is not None:
            keep["right"] = keep["right"].unionByName(old_right)
        return reduce(DataFrame.union, out), keep


class Processor:
    """A custom stateful operator's code, one instance for each partition and batch.

    ``restore`` gets the bytes that ``snapshot`` gave after the partition's last batch.
    """

    def process(self, batch: pa.Table) -> list[pa.Table]:
        raise NotImplementedError

    def snapshot(self) -> bytes:
        return b""

    def restore(self, data: bytes) -> None:
        return None


@dataclass
class Custom(Operator):
    """A :class:`Processor` for each logical partition, its snapshots kept as state."""

    factory: Callable[[], Processor]
    schema: T.StructType
    stateful = True

    def process(self, batches: list[DataFrame], state: State) -> tuple[DataFrame, State]:
        from ..plans.storage import written

        (df,) = batches
        require(df, PARTITION)
        names = self.schema.names
        both = T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__snapshot", T.BinaryType()), *self.schema.fields])
        factory = self.factory
        old = state.get("snapshots") or df.sparkSession.createDataFrame([], "__p int, __snapshot binary")

        def run(key: tuple, rows: pa.Table, before: pa.Table) -> pa.Table:
            processor = factory()
            if len(before):
                processor.restore(before.column("__snapshot")[0].as_py())
            outs = processor.process(rows) if len(rows) else []
            n = sum(len(o) for o in outs)
            body = pa.concat_tables([o.select(names) for o in outs]) if outs else None
            columns = {"__p": pa.array([key[0].as_py()] * (n + 1), pa.int32()), "__snapshot": pa.array([processor.snapshot()] + [None] * n, pa.binary())}
            from pyspark.sql.pandas.types import to_arrow_schema

            for f in to_arrow_schema(self.schema):
                first = pa.nulls(1, f.type)
                columns[f.name] = pa.chunked_array([first, *(body.column(f.name).cast(f.type).chunks if body is not None else [])])
            return pa.table(columns)

        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in both.fields])
        done = written(df.groupBy(F.col(PARTITION).alias("__p")).cogroup(old.groupBy("__p")).applyInArrow(run, loose))
        return done.filter("__snapshot is null").select(*names), {"snapshots": done.filter("__snapshot is not null").select("__p", "__snapshot")}

