import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake import Aggregate, Aggregation, LakeError, Topology
from strandlake.errors import SchemaPending
from strandlake.operators.stateful import IntervalJoin
from strandlake.records import RAW
from strandlake.sources.codecs import BlobCodec, FrameCodec, GzipCodec, JsonCodec, ipc_batch, ipc_bytes, string_codec
from strandlake.streaming.native import interval_join as native_join
from strandlake.streaming.native import stateful_operator, with_event_time
from strandlake.streaming.native import windowed_group_by as native_windows
from strandlake.streaming.runner import PREFIX, ErrorPolicy, Metrics, Runner, TestDriver, memory_sink, parquet_sink, with_defaults

ROW = T.StructType([T.StructField("user", T.StringType()), T.StructField("amount", T.LongType())])


def raw(spark, *rows):
    """(json or bytes, ts, partition)"""
    return spark.createDataFrame([(None, r if isinstance(r, (bytes, type(None))) else json.dumps(r).encode(), t, p, i, [("trace-id", b"abc")]) for i, (r, t, p) in enumerate(rows)], RAW)


def tx(user, amount):
    return {"user": user, "amount": amount}


def pipeline():
    t = Topology()
    s = t.add_source("in", ["tx"], JsonCodec(ROW))
    f = t.add_filter("large", F.col("amount") > 4, s)
    g = t.add_group_by("sum", ["user"], [Aggregation("amount", "total", Aggregate.SUM)], f)
    t.add_sink("out", "totals", JsonCodec(), g)
    return t


def values(rows):
    return sorted(bytes(r["value"]).decode() for r in rows)


def test_validation():
    t = Topology()
    with pytest.raises(LakeError, match="needs a source"):
        t.build()
    s = t.add_source("a", "x", FrameCodec())
    with pytest.raises(LakeError, match="needs a sink"):
        t.build()
    with pytest.raises(LakeError, match="duplicate"):
        t.add_source("a", "y", FrameCodec())
    with pytest.raises(ValueError):
        Topology().add_filter("f", "true", s)
    with pytest.raises(LakeError):
        t.add_merge("m", [s])
    with pytest.raises(LakeError):
        t.add_pass_through_sink("p", "y", t.add_filter("f", "true", s))
    with pytest.raises(LakeError):
        t.add_source("none", [], FrameCodec())
    assert t.source_topics() == ["x"]


def test_state_across_runs_snapshot_release(spark, tmp_path):
    built = pipeline().build()
    out = built.run_batch("tx", raw(spark, (tx("a", 5), 1, 0), (tx("a", 3), 2, 0), (tx("b", 9), 3, 1)))["totals"]
    assert values(out.collect()) == ['{"user":"a","total":5}', '{"user":"b","total":9}']
    built.snapshot(str(tmp_path / "s"))
    again = pipeline().build()
    again.restore(spark, str(tmp_path / "s"), built.parts() | {"unknown": ["x"]})
    assert values(again.run_batch("tx", raw(spark, (tx("a", 6), 4, 0)))["totals"].collect()) == ['{"user":"a","total":11}']
    again.release(0)
    assert values(again.run_batch("tx", raw(spark, (tx("a", 6), 4, 0)))["totals"].collect()) == ['{"user":"a","total":6}']
    assert built.run_batches({"other": raw(spark)}) == {}


def test_snapshots_may_replace_what_was_restored(spark, tmp_path):
    """Restored and released state doesn't read the snapshot any more, and carries no plan along."""
    path, built = str(tmp_path / "s"), pipeline().build()
    built.run_batch("tx", raw(spark, (tx("a", 5), 1, 0), (tx("b", 9), 3, 1)))
    built.snapshot(path)
    for turn in range(3):
        built.restore(spark, path, built.parts())
        built.restore(spark, path, built.parts(), partition=1)
        built.release(7)
        built.snapshot(path)
        plan = next(s for s in built.state.values() if "groups" in s)["groups"]._jdf.queryExecution().logical().toString()
        assert len(plan.strip().splitlines()) == 1, plan
    assert values(built.run_batch("tx", raw(spark, (tx("a", 6), 4, 0), (tx("b", 7), 4, 1)))["totals"].collect()) == ['{"user":"a","total":11}', '{"user":"b","total":16}']


def test_fanout_merge_join_and_pass_through(spark):
    t = Topology()
    a, b = t.add_source("a", "ta", JsonCodec(ROW)), t.add_source("b", "tb", JsonCodec(ROW))
    t.add_sink("m", "merged", JsonCodec(), t.add_merge("both", [a, b]))
    t.add_sink("j", "joined", JsonCodec(), t.add_join("pairs", IntervalJoin("user", "user", 10), a, b))
    t.add_pass_through_sink("p", "copy", a)
    built = t.build()
    out = built.run_batches({"ta": raw(spark, (tx("a", 5), 100, 0)), "tb": raw(spark, (tx("a", 9), 105, 0), (tx("a", 9), 105, 1))})
    assert out["merged"].count() == 3 and out["copy"].count() == 1
    assert values(out["joined"].collect()) == ['{"left_user":"a","left_amount":5,"right_user":"a","right_amount":9}']
    later = built.run_batches({"tb": raw(spark, (tx("a", 1), 101, 0))})
    assert values(later["joined"].collect()) == ['{"left_user":"a","left_amount":5,"right_user":"a","right_amount":1}']


def test_pass_through_alone_is_never_decoded(spark):
    t = Topology()
    t.add_pass_through_sink("p", "copy", t.add_source("a", "ta", JsonCodec(ROW)))
    rows = t.build().run_batch("ta", raw(spark, (b"\x01\x02\x03", 7, 0), (None, 8, 0)))["copy"].collect()
    assert sorted(r["timestamp"] for r in rows) == [7, 8] and {bytes(r["value"]) if r["value"] is not None else None for r in rows} == {b"\x01\x02\x03", None}


def test_blob_codec(spark):
    import pyarrow as pa

    def blob(*rows):
        return ipc_bytes(pa.table({"user": [r[0] for r in rows], "amount": pa.array([r[1] for r in rows], pa.int64())}))

    frame = spark.createDataFrame([(None, blob(("a", 1), ("b", 2)), 10, 0, 5, []), (b"\x07", blob(("c", 3)), 11, 0, 6, [])], RAW)
    df = BlobCodec().decode(frame)
    assert sorted((r["user"], r["__timestamp"], r["__offset"]) for r in df.collect()) == [("a", 10, 5), ("b", 10, 5), ("c", 11, 6)]
    back = BlobCodec().encode(df).collect()
    assert sorted((ipc_batch(bytes(r["value"])).num_rows, r["timestamp"]) for r in back) == [(1, 11), (2, 10)]
    many = spark.createDataFrame([(None, blob(*[(f"user-{i}-" + "x" * 32, i) for i in range(64)]), 1, 0, 0, [])], RAW)
    cut = BlobCodec(most=1024).encode(BlobCodec().decode(many)).collect()
    assert len(cut) > 1 and all(len(r["value"]) <= 1024 for r in cut) and sum(ipc_batch(bytes(r["value"])).num_rows for r in cut) == 64
    with pytest.raises(Exception, match="one row takes"):
        BlobCodec(most=1).encode(df).collect()
    reserved = spark.createDataFrame([(None, ipc_bytes(pa.table({"__key": [b"k"]})), 1, 0, 0, [])], RAW)
    escaped = BlobCodec().decode(reserved)
    assert "__payload___key" in escaped.columns
    assert ipc_batch(bytes(BlobCodec().encode(escaped).head()["value"])).schema.names == ["__key"]
    with pytest.raises(Exception, match="not an Arrow IPC stream"):
        BlobCodec(schema=ROW).decode(raw(spark, (b"junk", 1, 0))).collect()


def test_json_codec(spark):
    codec = JsonCodec()
    df = codec.decode(raw(spark, ({"id": "a", "amount": 5, "tags": ["new", "paid"]}, 1, 0), ({"id": "b", "amount": 7, "tags": ["new"], "late": 1.5}, 2, 0)))
    assert df.columns[:4] == ["id", "amount", "tags", "late"]
    assert sorted((r["id"], r["amount"], r["tags"], r["late"]) for r in df.collect()) == [("a", 5, '["new","paid"]', None), ("b", 7, '["new"]', 1.5)]
    assert values(codec.encode(df.drop("late")).collect())[0] == '{"id":"a","amount":5,"tags":["new","paid"]}'
    scalar = JsonCodec()
    first = scalar.decode(raw(spark, (b"null", 1, 0)))
    assert first.schema["value"].dataType == T.StringType()
    assert scalar.decode(raw(spark, (b"7", 1, 0))).head()["value"] == "7"
    schema = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "amount": {"type": "integer"}, "blob": {"type": "string", "contentEncoding": "base64"}, "deep": {"$ref": "#/$defs/d"}}, "$defs": {"d": {"type": "object"}}}
    struct = JsonCodec(json_schema=schema).schema
    assert [f.nullable for f in struct] == [False, True, True, True] and struct["blob"].dataType == T.BinaryType() and struct["deep"].metadata["strandlake.json"]
    decoded = JsonCodec(json_schema=schema).decode(raw(spark, ({"id": "a", "blob": "eHk=", "deep": {"x": 1}}, 1, 0)))
    assert bytes(decoded.head()["blob"]) == b"xy"
    assert values(JsonCodec().encode(decoded).collect()) == ['{"id":"a","amount":null,"blob":"eHk=","deep":{"x":1}}']
    with pytest.raises(Exception, match="MALFORMED|parse"):
        JsonCodec(ROW).decode(raw(spark, (b"{", 1, 0))).collect()


def test_strings_and_gzip(spark):
    codec = GzipCodec(string_codec())
    packed = codec.encode(string_codec().decode(raw(spark, (b"a", 10, 0), (b"b", 11, 0))))
    assert all(bytes(r["value"])[:2] == b"\x1f\x8b" and r["headers"][0]["key"] == "trace-id" for r in packed.collect())
    assert sorted(r["value"] for r in codec.decode(packed).collect()) == ["a", "b"]
    bomb = GzipCodec(string_codec()).encode(string_codec().decode(raw(spark, (b"0" * 10_000, 1, 0))))
    with pytest.raises(Exception, match="inflates to more"):
        GzipCodec(string_codec(), 100).decode(bomb).collect()


def fails_on_b(df):
    return df.withColumn("user", F.when(F.col("user") == "b", F.raise_error(F.lit("boom"))).otherwise(F.col("user")))


def failing():
    t = Topology()
    s = t.add_source("in", ["tx"], JsonCodec(ROW))
    t.add_sink("out", "out", JsonCodec(), t.add_operator("op", fails_on_b, s))
    return t.build()


@pytest.mark.parametrize("policy,letters", [(ErrorPolicy.DEAD_LETTER, 1), (ErrorPolicy.SKIP, 0)])
def test_error_policies(spark, policy, letters):
    store = {}
    runner = Runner(failing(), memory_sink(store), policy)
    runner.run({"tx": raw(spark, (tx("a", 1), 1, 0), (tx("b", 2), 2, 1))})
    assert values(store["out"]) == ['{"user":"a","amount":1}']
    assert len(store.get("dead-letters", [])) == letters
    if letters:
        headers = {h["key"]: bytes(h["value"]) for h in store["dead-letters"][0]["headers"]}
        assert headers["trace-id"] == b"abc" and headers[PREFIX + "topic"] == b"tx" and headers[PREFIX + "partition"] == b"1" and b"boom" in headers[PREFIX + "message"]
    m = runner.metrics
    assert (m.batches, m.input, m.output, m.failures, m.dead_letters) == (1, 2, 1, 1, letters) and m.nanos > 0


def test_fail_and_retriable_are_raised(spark):
    with pytest.raises(Exception, match="boom"):
        Runner(failing(), memory_sink({})).run({"tx": raw(spark, (tx("b", 2), 2, 1))})
    t = Topology()

    def pending(df):
        raise SchemaPending(7)

    t.add_sink("out", "out", JsonCodec(), t.add_operator("op", pending, t.add_source("in", "tx", JsonCodec(ROW))))
    store = {}
    runner = Runner(t.build(), memory_sink(store), ErrorPolicy.DEAD_LETTER)
    with pytest.raises(SchemaPending):
        runner.run({"tx": raw(spark, (tx("b", 2), 2, 1))})
    assert not store and runner.metrics == Metrics(failures=1, nanos=runner.metrics.nanos)


def test_resume_does_not_count_twice(spark, tmp_path):
    sink = parquet_sink(str(tmp_path / "out"))
    first = Runner(pipeline().build(), sink, state_path=str(tmp_path / "state"))
    first.run({"tx": raw(spark, (tx("a", 5), 1, 0))})
    second = Runner(pipeline().build(), sink, state_path=str(tmp_path / "state"))
    second.resume(spark, 0)
    second.run({"tx": raw(spark, (tx("a", 5), 1, 0))}, 0)  # delivered again
    second.run({"tx": raw(spark, (tx("a", 6), 1, 0))}, 1)
    rows = spark.read.parquet(str(tmp_path / "out/totals"))
    assert sorted((r["batch"], bytes(r["value"]).decode()) for r in rows.collect()) == [(0, '{"user":"a","total":5}'), (1, '{"user":"a","total":11}')]


def test_exact_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    for i, amount in enumerate((5, 6)):
        raw(spark, (tx("a", amount), i, 0)).coalesce(1).write.mode("append").parquet(src)
    store = {}
    frame = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(src)
    query = Runner(pipeline().build(), memory_sink(store)).stream({"tx": frame}, str(tmp_path / "ckpt"))
    assert query.awaitTermination(120)
    assert values(store["totals"])[0] == '{"user":"a","total":11}' and len(store["totals"]) == 2


def stream(spark, tmp_path, name, rows):
    df = JsonCodec(ROW).decode(raw(spark, *rows))
    df.coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def run_memory(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_native_windows_and_join(spark, tmp_path):
    rows = [(tx("a", 5), 1_000, 0), (tx("a", 3), 2_000, 0), (tx("a", 1), 100_000, 0)]
    out = native_windows(stream(spark, tmp_path, "w", rows), ["user"], 10_000, Aggregation("amount", "total", Aggregate.SUM))
    assert [(r["__window_start"], r["total"]) for r in run_memory(out, "append", "native_w")] == [(0, 8)]
    pairs = native_join(stream(spark, tmp_path, "l", rows[:1]), stream(spark, tmp_path, "r", [(tx("a", 9), 1_500, 0)]), "user", "user", 1000)
    assert [(r["left_amount"], r["right_amount"]) for r in run_memory(pairs, "append", "native_j")] == [(5, 9)]


class Totals:
    def __init__(self):
        self.n = 0

    def process(self, frame):
        self.n += len(frame)
        return [frame.assign(n=self.n)[["n"]].tail(1)]

    def snapshot(self):
        return str(self.n).encode()

    def restore(self, data):
        self.n = int(data)


def test_stateful_operator(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", with_defaults({})["spark.sql.streaming.stateStore.providerClass"])
    out = stateful_operator(stream(spark, tmp_path, "s", [(tx("a", 5), 1, 0), (tx("a", 5), 1, 0)]), Totals, T.StructType([T.StructField("n", T.LongType())]))
    assert [r["n"] for r in run_memory(out, "append", "stateful")] == [2]


class Ticks(Totals):
    def punctuate(self, at):
        import pandas as pd

        return [pd.DataFrame({"n": [-at]})]


def test_stream_time_punctuator(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", with_defaults({})["spark.sql.streaming.stateStore.providerClass"])
    df = with_event_time(stream(spark, tmp_path, "t", [(tx("a", 5), 1_000, 0), (tx("a", 5), 20_000, 0)]), 0)
    out = stateful_operator(df, Ticks, T.StructType([T.StructField("n", T.LongType())]), every=5_000, wall_clock=False)
    assert sorted(r["n"] for r in run_memory(out, "append", "ticks")) == [-5_000, 2]


def test_driver(spark):
    driver = TestDriver(spark, pipeline().build())
    driver.pipe("tx", b'{"user":"a","amount":5}')
    driver.pipe("tx", b'{"user":"a","amount":6}')
    assert driver.output_size("totals") == 2
    assert bytes(driver.read("totals")["value"]) == b'{"user":"a","total":5}'
    assert len(driver.drain("totals")) == 1 and driver.read("totals") is None
    driver.fail_next(LakeError("once"))
    with pytest.raises(LakeError, match="once"):
        driver.pipe("tx", b"{}")


def test_defaults():
    assert with_defaults({"spark.sql.session.timeZone": "CET"}, x="1") == {**with_defaults({}), "spark.sql.session.timeZone": "CET", "x": "1"}
