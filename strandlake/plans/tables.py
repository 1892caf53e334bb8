"""The test tables as bounded topics: each row a record, its envelope made from the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..records import as_records, millis

#: Logical partitions of a table topic, and events in a replay batch.
PARTITIONS, REPLAY = 4, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: keyed by user, partitioned by user, the event id as offset. ``cents`` is the value in whole cents."""
    df = table(spark, sf_dir, "events")
    payload = df.select("event_id", "user_id", "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("cents"), "props", "ts")
    out = as_records(payload, key=F.col("user_id"), timestamp=millis(F.col("ts")), partition=(F.col("user_id") % PARTITIONS).cast("int"), offset=F.col("event_id"))
    return out.drop("ts")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    out = as_records(df, key=F.col("o_custkey"), timestamp=millis(F.col("o_orderdate")), partition=(F.col("o_custkey") % PARTITIONS).cast("int"), offset=F.col("o_orderkey"))
    return out.drop("o_orderdate")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    out = as_records(df, key=F.col("l_orderkey"), timestamp=millis(F.col("l_shipdate")), partition=(F.col("l_orderkey") % PARTITIONS).cast("int"), offset=F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return out.drop("l_shipdate")
