import random

import pytest
from pyspark.sql import functions as F

from strandlake.errors import LakeError
from strandlake.streaming.dsl import Stream, Table
from strandlake.streaming.native import read_state

SCHEMA = "key string, ts long, v string"


def frame(spark, *rows):
    return Stream(spark.createDataFrame(list(rows), SCHEMA))


def source(spark, tmp_path, name, rows, delay=0):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
    return Stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))).watermark(delay)


def run(df, name, mode="append", checkpoint=None):
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    assert q.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_filter_count(spark):
    s = frame(spark, ("x", 7, "+1"), ("y", 8, "-2"), ("x", 9, "+3"), ("x", 9, "-4"), ("y", 10, "-5"))
    counts = s.filter(F.col("v").startswith("+")).map_values(v=F.reverse("v")).group_by_key().count()
    assert [tuple(r) for r in counts.df.collect()] == [("x", 2)] and counts.get("x")[0]["count"] == 2 and counts.get("y") == []


@pytest.mark.parametrize("before,after", [(5, 5), (0, 7), (0, 0), (3, 0)])
def test_bounded_stream_joins(spark, before, after):
    """Against all pairs: a hot key over a long time, and null keys and times."""
    rng = random.Random(before * 10 + after)
    left = [("hot", rng.randint(-40, 40), f"l{i}") for i in range(40)] + [("k", 5, "l"), (None, 5, "l-null"), ("k", None, "l-late")]
    right = [("hot", rng.randint(-40, 40), f"r{i}") for i in range(40)] + [("k", 5, "r"), (None, 5, "r-null"), ("k", None, "r-late"), ("other", 1, "r")]
    pairs = [(a, b) for a in left for b in right if a[0] and a[0] == b[0] and None not in (a[1], b[1]) and a[1] - before <= b[1] <= a[1] + after]
    alone = [(a, (None,) * 3) for a in left if a not in [x for x, _ in pairs]], [((None,) * 3, b) for b in right if b not in [y for _, y in pairs]]
    for how, want in (("inner", pairs), ("left", pairs + alone[0]), ("full", pairs + alone[0] + alone[1])):
        got = frame(spark, *left).join(frame(spark, *right), before, after, how)
        assert got.columns == ["left_key", "left_ts", "left_v", "right_key", "right_ts", "right_v"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((*a, *b)) for a, b in want)


def test_to_and_print(spark, capfd):
    sent = []
    s = frame(spark, ("a", 1, "one"))
    assert s.print(5) is s
    s.to("topic", lambda topic, df, batch: sent.append((topic, batch, df.count())), 3)
    assert sent == [("topic", 3, 1)]


def test_versions_and_deletes(spark):
    s = frame(spark, ("a", 100, "old"), ("a", 200, "new"), ("b", 100, "x"), ("b", 150, None))
    assert {r["key"]: r["v"] for r in Table.latest(s).df.collect()} == {"a": "new"}
    assert {r["key"]: r["v"] for r in Table.as_of(s, 120).df.collect()} == {"a": "old", "b": "x"}


def test_table_joins_and_errors(spark):
    a = frame(spark, ("a", 1, "l"), ("b", 1, "l")).to_table()
    b = frame(spark, ("b", 1, "r"), ("c", 1, "r")).to_table()
    assert sorted((r["key"], r["v"], r["right_v"]) for r in a.join(b, "left").df.collect()) == [("a", "l", None), ("b", "l", "r")]
    assert sorted(r["key"] for r in a.join(b, "full").df.collect()) == ["a", "b", "c"]
    with pytest.raises(LakeError):
        frame(spark, ("a", 1, "x")).flat_map(F.array(F.struct("v")))


def test_sessions_one_gap_apart_merge(spark):
    s = frame(spark, ("a", 0, ""), ("a", 5000, ""), ("a", 10_001, ""))
    assert sorted(tuple(r) for r in s.group_by_key().session(5000).collect()) == [("a", 0, 5000, 2), ("a", 10_001, 10_001, 1)]


def test_streaming_suppressed_windows(spark, tmp_path):
    s = source(spark, tmp_path, "w", [("a", 0, ""), ("a", 9_000, ""), ("a", 11_000, "advance")])
    assert run(s.group_by_key().windowed_by(10_000).count(), "dsl_windows") == [("a", 0, 10_000, 2)]


def test_streaming_hopping_and_session(spark, tmp_path):
    rows = [("a", 10_000, ""), ("a", 12_000, ""), ("a", 60_000, "advance")]
    hop = source(spark, tmp_path, "h", rows).group_by_key().windowed_by(10_000, 5_000).count()
    assert sorted(run(hop, "dsl_hop")) == [("a", 5_000, 15_000, 2), ("a", 10_000, 20_000, 2)]
    assert run(source(spark, tmp_path, "s", rows).group_by_key().session(5_000), "dsl_session") == [("a", 10_000, 12_000, 2)]


def test_streaming_join(spark, tmp_path):
    left = source(spark, tmp_path, "l", [("a", 10_000, "L"), ("b", 10_000, "M"), ("z", 90_000, "advance")])
    right = source(spark, tmp_path, "r", [("a", 11_000, "R"), ("z", 90_000, "advance")])
    out = left.join(right, 5_000, how="left").select("left_key", "left_v", "right_v")
    got = set(run(out, "dsl_join"))
    assert ("a", "L", "R") in got and ("b", "M", None) in got


def test_state_can_be_read(spark, tmp_path):
    s = source(spark, tmp_path, "c", [("a", 0, ""), ("a", 1, ""), ("b", 0, "")])
    run(s.group_by_key().count().df, "dsl_state", "complete", str(tmp_path / "ckpt"))
    rows = read_state(spark, str(tmp_path / "ckpt")).select("key.key", "value.count").collect()
    assert sorted(map(tuple, rows)) == [("a", 2), ("b", 1)]


def test_stateless_surface(spark):
    s = frame(spark, ("a", 1, "x,y"), ("b", 2, "z"))
    assert sorted(r["w"] for r in s.flat_map_values("w", F.split("v", ",")).df.collect()) == ["x", "y", "z"]
    assert s.repartition(3).df.rdd.getNumPartitions() == 3
    assert s.peek("seen").merge(s).df.count() == 4
    assert sorted(r["key"] for r in s.select_key(F.upper("key")).df.collect()) == ["A", "B"]
    counted = spark.sparkContext.accumulator(0)
    s.foreach(lambda _: counted.add(1))
    assert counted.value == 2


def test_expressions_reach_the_scan(spark, tmp_path):
    from strandlake import filter_rows, select
    from strandlake.records import as_records

    spark.range(100).selectExpr("id", "id * 2 AS v", "'long text' AS unused").write.parquet(str(tmp_path / "t"))
    df = as_records(spark.read.parquet(str(tmp_path / "t")), key=F.col("id"), partition=(F.col("id") % 4).cast("int"))
    plan = select(filter_rows(df, F.col("v") > 50), "v").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,50)]" in plan and "ReadSchema: struct<v:bigint>" in plan
