"""Splits and custom operators as table functions: for ``df.lateralJoin`` and for SQL, with PARTITION BY and ORDER BY.

A custom operator is an object made for each partition of its table, with ``row(r)``, called in the given order, and perhaps ``end()``; both
return rows (tuples) to show. Its state lives as long as its partition's rows come; Spark shuffles and sorts them, and
spills, so an operator only keeps what it wants to. A partition is served by one task.

    register(spark, "numbered", Numbered, "user_id long, n long")
    spark.sql("SELECT * FROM numbered(TABLE(events) PARTITION BY user_id ORDER BY ts)")
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..errors import LakeError

#: What a custom operator returns for a row or at the end.
Rows = Iterable[tuple] | None


def table_function(factory: Callable[[], Any], schema: T.StructType | str):
    """A table function of one table argument that gives each partition's rows to an operator of its own."""

    class Function:
        def __init__(self) -> None:
            self.operator = factory()

        def eval(self, row: Row) -> Iterator[tuple]:
            yield from self.operator.row(row) or ()

        def terminate(self) -> Iterator[tuple]:
            end = getattr(self.operator, "end", None)
            yield from (end() if end else None) or ()

    return udtf(Function, returnType=schema)


def splitter(branches: Mapping[str, Callable[[Row], bool]], schema: T.StructType, first_only: bool = True):
    """A table function that shows each row under the branches that accept it (``first_only``: the first one), as column ``branch`` before its own of ``schema``.

    Rows that no branch accepts are not shown. It keeps no state and needs no partitioning.
    """
    if "branch" in schema.names:
        raise LakeError("column exists: branch")

    class Function:
        def eval(self, row: Row) -> Iterator[tuple]:
            values = tuple(row[n] for n in schema.names)
            for name, accepts in branches.items():
                if accepts(row):
                    yield (name, *values)
                    if first_only:
                        return

    return udtf(Function, returnType=T.StructType([T.StructField("branch", T.StringType()), *schema.fields]))


def register(spark: SparkSession, name: str, factory: Callable[[], Any] | Any, schema: T.StructType | str | None = None) -> None:
    """Makes an operator (or what :func:`splitter` and :func:`table_function` give, without ``schema``) known to SQL as ``name``."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise LakeError(f"not a name for SQL: {name}")
    spark.udtf.register(name, factory if schema is None else table_function(factory, schema))
