"""Kafka topics as raw records, where the connector is on the class path (it is not part of Spark's core)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.topology import Topology
from ..records import HEADER_TYPE, millis


#: Header with a record's event time, milliseconds in 8 bytes: Spark's Kafka writer leaves a record's own timestamp to the broker.
EVENT_TIME = "event-time"


def records(df: DataFrame, topic: str) -> DataFrame:
    """Raw records as Spark's Kafka writer takes them: key, value, headers, partition, topic.

    A timestamp goes along as a header and comes back from there; a null or negative one is left to the broker.
    A negative partition is left to the partitioner, as is a null one.
    """
    stamp = F.struct(F.lit(EVENT_TIME).alias("key"), F.unhex(F.lpad(F.hex("timestamp"), 16, "0")).alias("value"))
    own = F.coalesce(F.col("headers"), F.array().cast(HEADER_TYPE))
    stamped = F.when(F.col("timestamp") >= 0, F.concat(own, F.array(stamp).cast(HEADER_TYPE))).otherwise(own)
    return df.select("key", "value", stamped.alias("headers"), F.when(F.col("partition") >= 0, F.col("partition")).alias("partition"), F.lit(topic).alias("topic"))


def _raw(df: DataFrame) -> DataFrame:
    """Kafka's source schema as schema ``RAW``, the topic kept beside it. A null value stays null. The header of :func:`records` is the timestamp."""
    every = F.col("headers").cast(HEADER_TYPE)
    sent = F.get(F.filter(every, lambda h: h["key"] == EVENT_TIME), F.lit(0))["value"]
    told = F.conv(F.hex(sent), 16, 10).cast("long")
    rest = F.filter(every, lambda h: ~h["key"].eqNullSafe(F.lit(EVENT_TIME)))
    return df.select("topic", "key", "value", F.coalesce(told, millis(F.col("timestamp"))).alias("timestamp"), "partition", "offset", rest.alias("headers"))


def subscription(topology: Topology) -> str:
    """The topics of a topology's sources, for the option ``subscribe``."""
    return ",".join(topology.source_topics())


def read(spark: SparkSession, servers: str, topics: Sequence[str], start: Mapping[str, Mapping[int, int]] | str = "earliest", end: Mapping[str, Mapping[int, int]] | str = "latest", **options: str) -> dict[str, DataFrame]:
    """A bounded read by topic, from and to offsets by topic and partition (or earliest and latest)."""
    def text(o: Mapping | str) -> str:
        return o if isinstance(o, str) else json.dumps({t: {str(p): n for p, n in ps.items()} for t, ps in o.items()})

    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("includeHeaders", "true")
    df = _raw(reader.option("startingOffsets", text(start)).option("endingOffsets", text(end)).options(**options).load())
    return {t: df.filter(F.col("topic") == t).drop("topic") for t in topics}


def read_stream(spark: SparkSession, servers: str, topics: Sequence[str], **options: str) -> dict[str, DataFrame]:
    """Streaming frames by topic; offsets are kept in the query's checkpoint."""
    def one(topic: str) -> DataFrame:
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true")
        return _raw(reader.options(**options).load()).drop("topic")

    return {t: one(t) for t in topics}
