"""Folds over each key's rows in order: state is carried from row to row, a key's history is never held.

Rows are dealt by key and sorted within their task (Spark spills as it must), and pass through as Arrow batches. With
``merge`` (which must be associative) rows are dealt by ranges of key and order instead, so a key that holds much of the table is spread
over tasks; each gives one state for each key that it meets, at most two of which go on elsewhere, and these are merged in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

State = tuple


def fold(df: DataFrame, key: str, order: Sequence[str], zero: State, step: Callable[[State, dict], State], schema: T.StructType, merge: Callable[[State, State], State] | None = None) -> DataFrame:
    """One row for each key: the key, then the columns of ``schema`` with what ``step(state, row)`` makes of ``zero`` over the key's rows.

    ``row`` maps column names to values. ``order`` should leave no ties, else these come in any order. A null key is one of its own.
    ``merge(a, b)``: the state of the rows of ``a`` followed by those of ``b``, each folded from ``zero``. No rows give no rows.
    """
    names = schema.names
    kind = T.StructField("__k", df.schema[key].dataType)
    partial = T.StructType([kind, T.StructField("__part", T.IntegerType()), *schema.fields])
    dealt = (df.repartition(F.col(key)) if merge is None else df.repartitionByRange(F.col(key).asc_nulls_first(), *order)).sortWithinPartitions(F.col(key).asc_nulls_first(), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, part = to_arrow_schema(partial), TaskContext.get().partitionId()
        state, at, began, done = zero, None, False, []
        for batch in batches:
            for row in batch.to_pylist():
                k = row[key]
                if not began or k != at:
                    if began:
                        done.append((at, part, *state))
                    state, at, began = zero, k, True
                state = step(state, row)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, d)) for d in done], arrow)
                done = []
        if began:
            done.append((at, part, *state))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, d)) for d in done], arrow)

    parts = dealt.mapInArrow(run, partial)
    if merge is None:
        return parts.select(F.col("__k").alias(key), *names)

    # A key's states are as many as the tasks that it is spread over.
    together = parts.groupBy("__k").agg(F.sort_array(F.collect_list(F.struct("__part", *names))).alias("__states"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(T.StructType([kind, *schema.fields]))
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                states = [tuple(s[n] for n in names) for s in row["__states"]]
                state = states[0]
                for s in states[1:]:
                    state = merge(state, s)
                out.append(dict(zip(arrow.names, (row["__k"], *state))))
            yield pa.RecordBatch.from_pylist(out, arrow)

    return together.mapInArrow(join, T.StructType([kind, *schema.fields])).select(F.col("__k").alias(key), *names)
