"""The operators on one bounded batch of records. Expressions are Spark columns, so Catalyst plans them.

Logical partitions are isolated: what groups, joins or ranks does so within a value of
``__partition`` (if there is such a column).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LakeError
from ..functions.aggregates import Aggregation
from ..functions.coerce import coerce
from ..records import PARTITION, RESERVED, TIMESTAMP, metadata, payload, require

WINDOW_START, WINDOW_END = "__window_start", "__window_end"


def filter_rows(df: DataFrame, predicate: Column | str | Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The rows that ``predicate`` accepts, in their order. A null predicate does not accept.

    A Column or SQL text is pushed down as far as the source allows. A function of an Arrow batch
    that gives a boolean array is the fallback for what columns can't express.
    """
    if not callable(predicate) or isinstance(predicate, Column):
        return df.filter(predicate)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(predicate(b))

    return df.mapInArrow(task, df.schema)


def select(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in the order given, later repeats ignored; reserved columns present follow unless named."""
    names = list(dict.fromkeys(columns))
    require(df, *names)
    return df.select(*names, *[m for m in metadata(df) if m not in names])


@dataclass(frozen=True)
class Derived:
    """A column to derive: its name, an expression, and its type (None: the expression's own)."""

    name: str
    value: Column
    type: T.DataType | None = None

    def __post_init__(self) -> None:
        if self.name in RESERVED:
            raise LakeError(f"reserved column name: {self.name}")


def with_columns(df: DataFrame, *derived: Derived) -> DataFrame:
    """Derived columns replace their namesakes in place or follow the payload.

    All expressions see the input. Of several with one name the last counts. Reserved columns keep
    their place after the payload.
    """
    last = {d.name: d for d in derived}
    kinds = df.select(*[d.value.alias(d.name) for d in last.values()]).schema
    made = {n: (coerce(d.value, kinds[n].dataType, d.type, n) if d.type else d.value).alias(n) for n, d in last.items()}
    new = [made[n] for n in last if n not in df.columns]
    return df.select(*[made.get(c, F.col(c)) for c in payload(df)], *new, *metadata(df))


def _scope(df: DataFrame) -> list[str]:
    return [PARTITION] if PARTITION in df.columns else []


def group_by(df: DataFrame, keys: Sequence[str], *aggregations: Aggregation) -> DataFrame:
    """Aggregates of each group of a partition: keys, outputs, then ``__partition`` unless it is a key.

    Null keys are a group. Spark combines before the shuffle. No order is promised.
    """
    if not keys:
        raise LakeError("group_by needs at least one key")
    require(df, *keys, *[a.input for a in aggregations])
    rest = [c for c in _scope(df) if c not in keys]
    states = df.groupBy(*keys, *rest).agg(*[a.partial(df.schema).alias(f"__s{i}") for i, a in enumerate(aggregations)])
    return states.select(*keys, *[a.result(F.col(f"__s{i}"), df.schema).alias(a.output) for i, a in enumerate(aggregations)], *rest)


def event_time() -> Column:
    """The timestamp; null is an error."""
    return F.when(F.col(TIMESTAMP).isNull(), F.raise_error(F.lit("event timestamp is null"))).otherwise(F.col(TIMESTAMP))


def windowed(df: DataFrame, size: int) -> DataFrame:
    """``df`` with the start and end of each row's tumbling window; a null timestamp is an error."""
    if size < 1:
        raise LakeError("a window must have at least one millisecond")
    require(df, TIMESTAMP)
    taken = {WINDOW_START, WINDOW_END} & set(df.columns)
    if taken:
        raise LakeError(f"column exists: {sorted(taken)[0]}")
    ts = event_time()
    start = ts - F.pmod(ts, F.lit(size))
    return df.withColumn(WINDOW_START, start).withColumn(WINDOW_END, F.col(WINDOW_START) + size)


def windowed_group_by(df: DataFrame, keys: Sequence[str], size: int, *aggregations: Aggregation, retention: int | None = None) -> DataFrame:
    """Aggregates by tumbling event-time windows of ``size`` milliseconds: keys, window bounds, outputs, partition.

    Windows that end before the partition's latest timestamp less ``retention`` (at least ``size``,
    which it is by default) are gone; one that ends right then is kept.
    """
    keep = size if retention is None else retention
    if keep < size:
        raise LakeError("retention must be at least the window size")
    scope = _scope(df)
    rows = windowed(df, size)
    require(df, *keys, *[a.input for a in aggregations])
    if not keys:
        raise LakeError("windowed_group_by needs at least one key")
    rest = [c for c in scope if c not in keys]
    groups = [*keys, WINDOW_START, WINDOW_END, *rest]
    kept = rows.join(F.broadcast(stream_time(df)), _own(df).eqNullSafe(F.col("__p"))).filter(F.col(WINDOW_END) >= F.col("__st") - keep)
    states = kept.groupBy(*groups).agg(*[a.partial(df.schema).alias(f"__s{i}") for i, a in enumerate(aggregations)])
    return states.select(*groups[: len(keys) + 2], *[a.result(F.col(f"__s{i}"), df.schema).alias(a.output) for i, a in enumerate(aggregations)], *rest)


def _own(df: DataFrame) -> Column:
    return F.col(PARTITION) if PARTITION in df.columns else F.lit(0)


def stream_time(df: DataFrame) -> DataFrame:
    """``__p, __st``: each logical partition's latest timestamp.

    One row a partition, and a topic has few thousand partitions at most, so this may be broadcast: rows of
    windows that are over are then dropped before anything is shuffled, for a second look at two columns.
    """
    return df.groupBy(_own(df).cast("int").alias("__p")).agg(F.max(event_time()).alias("__st"))


def _sides(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, left_prefix: str, right_prefix: str) -> tuple[list[str], list[str]]:
    if window < 0:
        raise LakeError("a join window can't be negative")
    require(left, left_key, TIMESTAMP)
    require(right, right_key, TIMESTAMP)
    kinds = left.schema[left_key].dataType, right.schema[right_key].dataType
    if kinds[0] != kinds[1]:
        raise LakeError(f"join keys differ in type: {kinds[0].simpleString()} and {kinds[1].simpleString()}")
    names = [left_prefix + c for c in payload(left)], [right_prefix + c for c in payload(right)]
    every = [*names[0], *names[1], *metadata(left)]
    for n in every:
        if every.count(n) > 1:
            raise LakeError(f"join output column is ambiguous: {n}")
    return names


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, window: int, left_prefix: str = "left_", right_prefix: str = "right_", condition: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Pairs with equal keys, in one partition, whose timestamps are at most ``window`` milliseconds apart.

    Inner. Null keys match nothing; a null timestamp is an error. Key types must be equal. Columns:
    the left payload and the right payload, prefixed, then the left row's reserved columns.

    The rows meet by key and time bucket as wide as the window, the right side in three buckets, so
    a key with very many rows is spread over its time span instead of lying in one task.
    ``condition(left, right)`` may add to the match, given the aliases of the two sides.
    """
    left_names, right_names = _sides(left, right, left_key, right_key, window, left_prefix, right_prefix)

    def timed(df: DataFrame) -> DataFrame:
        return df.withColumn("__ts", event_time())

    width = max(window, 1)
    bucket = F.expr(f"(__ts - pmod(__ts, {width}L)) div {width}L")
    l = timed(left).withColumn("__b", bucket).alias("l")  # noqa: E741
    r = timed(right).withColumn("__b", bucket)
    r = (r.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1))) if window else r).alias("r")
    match = (F.col(f"l.{left_key}") == F.col(f"r.{right_key}")) & (F.col("l.__b") == F.col("r.__b")) & (F.abs(F.col("l.__ts") - F.col("r.__ts")) <= window)
    if PARTITION in left.columns and PARTITION in right.columns:
        match &= F.col(f"l.{PARTITION}") == F.col(f"r.{PARTITION}")
    if condition is not None:
        match &= condition("l", "r")
    columns = [F.col(f"l.`{c}`").alias(n) for c, n in zip(payload(left), left_names)] + [F.col(f"r.`{c}`").alias(n) for c, n in zip(payload(right), right_names)]
    return l.join(r, match).select(*columns, *[F.col(f"l.{m}") for m in metadata(left)])


def merge(*parents: DataFrame) -> DataFrame:
    """All rows of all parents (at least two), whose schemas must be equal in names, types, nullability and metadata."""
    if len(parents) < 2:
        raise LakeError("merge needs at least two parents")
    for p in parents[1:]:
        if p.schema != parents[0].schema or [f.metadata for f in p.schema] != [f.metadata for f in parents[0].schema]:
            raise LakeError(f"batch schemas differ: {parents[0].schema.simpleString()} and {p.schema.simpleString()}")
    return reduce(DataFrame.union, parents)


def split(df: DataFrame, *predicates: Column) -> list[DataFrame]:
    """The rows by the first predicate that accepts them; those that none accepts are left out."""
    out, before = [], F.lit(False)
    for p in predicates:
        accepted = F.coalesce(p, F.lit(False))
        out.append(df.filter(accepted & ~before))
        before = before | accepted
    return out


def top_n(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of each partition with the largest ``by``, nulls last, ties by the columns ``ties``. Spark keeps n a task before the shuffle."""
    require(df, by, *ties)
    order = Window.partitionBy(*_scope(df)).orderBy(F.col(by).desc_nulls_last(), *ties)
    return df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).drop("__rank")


def arrow_operator(df: DataFrame, function: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: T.StructType | str) -> DataFrame:
    """A custom operator: ``function()`` is called once a task, and what it gives maps each batch to any number of batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = function()
        for b in batches:
            yield from process(b)

    return df.mapInArrow(task, schema)


def partition_operator(df: DataFrame, function: Callable[[pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """A custom operator that sees a whole logical partition's batch at once."""
    require(df, PARTITION)
    return df.groupBy(PARTITION).applyInArrow(function, schema)

