"""Columnar micro-batch analytics over keyed, partitioned record streams, on Spark DataFrames."""

from .errors import LakeError
from .functions.aggregates import Aggregate, Aggregation
from .operators.relational import (
    Derived,
    filter_rows,
    group_by,
    interval_join,
    merge,
    select,
    split,
    top_n,
    windowed_group_by,
    with_columns,
)
from .plans.topology import Topology
from .records import RESERVED, as_records, payload, restore

__all__ = [
    "RESERVED", "Aggregate", "Aggregation", "Derived", "LakeError", "Topology", "as_records", "filter_rows", "group_by",
    "interval_join", "merge", "payload", "restore", "select", "split", "top_n", "windowed_group_by", "with_columns",
]
