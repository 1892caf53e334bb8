import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake import Aggregate, Aggregation, Topology
from strandlake.records import HEADER_TYPE, RAW
from strandlake.sources import kafka
from strandlake.sources.codecs import GzipCodec, JsonCodec
from strandlake.sources.registry import RegistryClient, RegistryStub, SchemaCache, TopicCodec, avro_codec

#: What Spark's Kafka source gives.
SOURCE = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("timestampType", T.IntegerType()), T.StructField("headers", HEADER_TYPE)])


def test_records_come_back_with_their_event_time(spark):
    rows = [(b"k", b"v", 1_700_000_000_123, 3, 9, [("h", b"1")]), (None, None, 0, None, None, None), (b"", b"x", -5, -1, 1, []), (b"n", b"x", None, 0, 2, [("h", None), ("h", b"2")])]
    sent = kafka.records(spark.createDataFrame(rows, RAW), "out")
    assert sent.columns == ["key", "value", "headers", "partition", "topic"]
    broker = dt.datetime(2001, 1, 1, tzinfo=dt.timezone.utc)
    got = sent.withColumns({"offset": F.lit(77).cast("long"), "timestamp": F.lit(broker), "timestampType": F.lit(0)}).select(*[F.col(f.name).cast(f.dataType) for f in SOURCE.fields])
    back = [tuple(r) for r in kafka._raw(got).collect()]
    told = int(broker.timestamp() * 1000)
    want = [("out", b"", told, None, []), ("out", None, 0, None, []), ("out", b"k", 1_700_000_000_123, 3, [("h", b"1")]), ("out", b"n", told, 0, [("h", None), ("h", b"2")])]
    got = [(r[0], r[1] if r[1] is None else bytes(r[1]), r[3], r[4], [(h["key"], h["value"] if h["value"] is None else bytes(h["value"])) for h in r[6]]) for r in back]
    assert sorted(got, key=repr) == sorted(want, key=repr)


class Reader:
    """Stands for a session's reader: notes the options, and gives records of two topics."""

    def __init__(self, df):
        self.df, self.said = df, {}

    @property
    def read(self):
        return self

    readStream = read

    def format(self, name):
        self.said["format"] = name
        return self

    def option(self, key, value):
        self.said[key] = value
        return self

    def options(self, **more):
        self.said |= more
        return self

    def load(self):
        return self.df


def test_bounded_reads_by_topic_and_offset(spark):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    df = spark.createDataFrame([(b"k", b"1", "a", 0, 5, at, 0, []), (b"k", b"2", "b", 1, 6, at, 0, None)], SOURCE)
    reader = Reader(df)
    got = kafka.read(reader, "host:1", ["a", "b"], start={"a": {0: 5}, "b": {1: 6}}, end={"a": {0: 6}, "b": {1: 7}}, groupIdPrefix="g")
    assert {t: [bytes(r["value"]) for r in d.collect()] for t, d in got.items()} == {"a": [b"1"], "b": [b"2"]} and got["a"].columns == [f.name for f in RAW.fields]
    assert reader.said["subscribe"] == "a,b" and reader.said["includeHeaders"] == "true" and reader.said["groupIdPrefix"] == "g"
    assert json.loads(reader.said["startingOffsets"]) == {"a": {"0": 5}, "b": {"1": 6}} and json.loads(reader.said["endingOffsets"])["b"] == {"1": 7}
    kafka.read(reader, "host:1", ["a"])
    assert (reader.said["startingOffsets"], reader.said["endingOffsets"]) == ("earliest", "latest")
    assert set(kafka.read_stream(reader, "host:1", ["a"])) == {"a"}


def raw(spark, *values):
    """Records (user, amount, partition)."""
    return spark.createDataFrame([(None, json.dumps({"user": u, "amount": a}).encode(), 1, p, i, []) for i, (u, a, p) in enumerate(values)], RAW)


def totals(built, frame):
    out = built.run_batches({"in": frame})["out"]
    return {(r["partition"], *json.loads(bytes(r["value"])).values()) for r in out.collect()}


def build(codec):
    t = Topology()
    sums = t.add_group_by("sums", ["user"], [Aggregation("amount", "total", Aggregate.SUM)], t.add_source("s", ["in"], codec))
    t.add_sink("o", "out", codec.out if hasattr(codec, "out") else JsonCodec(), sums)
    return t


ROW = T.StructType([T.StructField("user", T.StringType()), T.StructField("amount", T.LongType())])


def test_one_partition_is_restored_by_itself(spark, tmp_path):
    t = build(JsonCodec(ROW))
    assert kafka.subscription(t) == "in"
    first = t.build()
    totals(first, raw(spark, ("a", 1, 0), ("a", 10, 1)))
    first.snapshot(str(tmp_path / "s"))
    totals(first, raw(spark, ("a", 2, 0), ("a", 20, 1)))
    first.restore(spark, str(tmp_path / "s"), first.parts(), partition=1)
    assert totals(first, raw(spark, ("a", 4, 0), ("a", 40, 1))) == {(0, "a", 7), (1, "a", 50)}
    other = t.build()  # takes a partition over that it never saw
    other.restore(spark, str(tmp_path / "s"), first.parts() | {"nobody": ["x"]}, partition=0)
    assert totals(other, raw(spark, ("a", 4, 0), ("a", 40, 1))) == {(0, "a", 5), (1, "a", 40)}


@pytest.mark.parametrize("zipped", [False, True])
def test_codecs_follow_the_topic(spark, zipped):
    stub = RegistryStub()
    try:
        cache = SchemaCache(RegistryClient(stub.url))
        schema = json.dumps({"type": "record", "name": "Sale", "fields": [{"name": "user", "type": "string"}, {"name": "amount", "type": "long"}]})
        codec = TopicCodec(cache, avro_codec, schema)
        codec.intern("in", "out")
        cache.prewarm()
        assert sorted(stub.subjects) == ["in-value", "out-value"]
        whole = GzipCodec(codec) if zipped else codec
        t = Topology()
        t.add_sink("o", "out", whole, t.add_filter("large", F.col("amount") > 2, t.add_source("s", ["in"], whole)))
        sent = whole.for_topic("in").encode(JsonCodec(ROW).decode(raw(spark, ("a", 1, 0), ("b", 3, 0))))
        got = t.build().run_batches({"in": sent})["out"]
        assert [(r["user"], r["amount"]) for r in whole.for_topic("out").decode(got).collect()] == [("b", 3)]
    finally:
        stub.close()
