import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake import Aggregate, Aggregation, Derived, LakeError, filter_rows, group_by, interval_join, merge, select, top_n, windowed_group_by, with_columns
from strandlake.functions.coerce import coerce, fixed_list, fixed_width, unsigned
from strandlake.operators.stateful import Custom, GroupBy, IntervalJoin, Processor
from strandlake.plans.replay import replay_group_by, replay_join
from strandlake.plans.storage import written
from strandlake.records import ENVELOPE, ORIGINAL, RESERVED, as_records, decode_headers, encode_headers, restore

SCHEMA = T.StructType([T.StructField("user", T.StringType()), T.StructField("amount", T.LongType()), *ENVELOPE.fields])
SUM, COUNT, MIN, MAX = Aggregate.SUM, Aggregate.COUNT, Aggregate.MIN, Aggregate.MAX
TOTALS = (Aggregation("amount", "total", SUM), Aggregation("amount", "n", COUNT))


def batch(spark, *rows):
    """(user, amount, ts, partition)"""
    return spark.createDataFrame([(u, a, None, t, p, i, []) for i, (u, a, t, p) in enumerate(rows)], SCHEMA)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_filter_select_with_columns(spark):
    df = batch(spark, ("a", 5, 1, 0), ("a", 3, 2, 0), ("b", 9, 3, 0), ("c", None, 4, 0))
    assert filter_rows(df, F.col("amount") > 4).count() == 2
    assert filter_rows(df, lambda b: pa.compute.greater(b.column("amount"), 4)).count() == 2
    assert select(df, "user", "user").columns == ["user", *RESERVED]
    with pytest.raises(LakeError, match="column does not exist: x"):
        select(df, "x")
    out = with_columns(df, Derived("amount", F.col("amount") * 2), Derived("more", F.col("amount") + 1, T.IntegerType()), Derived("more", F.col("amount") + 2, T.IntegerType()))
    assert out.columns == ["user", "amount", "more", *RESERVED]
    assert got(out, "amount", "more") == sorted([(10, 7), (6, 5), (18, 11), (None, None)], key=repr)
    with pytest.raises(LakeError, match="reserved"):
        Derived("__key", F.lit(1))


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    df = filter_rows(spark.read.parquet(str(tmp_path / "t")), F.col("v") > 50).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,50)" in plan


def test_sum_is_exact_and_result_is_checked(spark):
    top = 2**63 - 1
    df = batch(spark, ("a", top, 1, 0), ("a", 1, 2, 0), ("a", -5, 3, 0))
    assert group_by(df, ["user"], TOTALS[0]).head()["total"] == top - 4
    with pytest.raises(Exception, match="out of range|OVERFLOW"):
        group_by(batch(spark, ("a", top, 1, 0), ("a", 1, 2, 0)), ["user"], TOTALS[0]).collect()


def test_group_nulls_partitions_and_errors(spark):
    df = batch(spark, (None, None, 1, 0), (None, 2, 1, 0), ("a", None, 1, 1), ("a", 4, 1, 0))
    out = group_by(df, ["user"], *TOTALS, Aggregation("amount", "low", MIN), Aggregation("user", "top", MAX))
    assert got(out, "user", "total", "n", "low", "top", "__partition") == sorted([(None, 2, 2, 2, None, 0), ("a", None, 1, None, "a", 1), ("a", 4, 1, 4, "a", 0)], key=repr)
    with pytest.raises(LakeError):
        group_by(df, [], TOTALS[0])
    with pytest.raises(LakeError, match="SUM needs numbers"):
        group_by(df, ["user"], Aggregation("user", "x", SUM))


def test_windows_keep_the_one_that_ends_at_the_cutoff(spark):
    df = batch(spark, ("a", 5, 1, 0), ("a", 3, 12, 0), ("a", 1, 20, 0), ("a", 9, -3, 1))
    assert got(windowed_group_by(df, ["user"], 10, *TOTALS), "__window_start", "total", "__partition") == sorted([(0, 5, 0), (10, 3, 0), (20, 1, 0), (-10, 9, 1)], key=repr)
    assert got(windowed_group_by(df.filter("__partition = 0").unionByName(batch(spark, ("a", 1, 21, 0))), ["user"], 10, *TOTALS), "__window_start") == [(10,), (20,)]
    with pytest.raises(Exception, match="event timestamp is null"):
        windowed_group_by(batch(spark, ("a", 1, None, 0)), ["user"], 10, *TOTALS).collect()
    with pytest.raises(LakeError):
        windowed_group_by(df, ["user"], 10, *TOTALS, retention=9)


def test_join_rules(spark):
    left = batch(spark, ("a", 5, 100, 0), (None, 1, 100, 0))
    right = batch(spark, ("a", 9, 110, 0), ("a", 7, 111, 0), ("a", 9, 105, 1), (None, 1, 100, 0))
    out = interval_join(left, right, "user", "user", 10)
    assert out.columns == ["left_user", "left_amount", "right_user", "right_amount", *RESERVED]
    assert got(out, "left_amount", "right_amount") == [(5, 9)]
    with pytest.raises(LakeError, match="differ in type"):
        interval_join(left, right, "user", "amount", 10)
    with pytest.raises(LakeError, match="ambiguous"):
        interval_join(left, right, "user", "user", 10, "", "")
    with pytest.raises(LakeError):
        interval_join(left, right, "user", "user", -1)


def test_merge_is_strict_and_top_n(spark):
    df = batch(spark, ("a", 5, 1, 0), ("b", 7, 1, 0), ("c", 6, 1, 1))
    assert merge(df, df).count() == 6
    with pytest.raises(LakeError, match="schemas differ"):
        merge(df, df.withColumn("amount", F.col("amount").cast("int")))
    with pytest.raises(LakeError):
        merge(df)
    assert got(top_n(df, "amount", 1), "user") == [("b",), ("c",)]


def test_escape_and_headers(spark):
    df = spark.createDataFrame([(b"x", 1)], "__key binary, v long")
    out = as_records(df, timestamp=F.lit(5))
    assert out.columns == ["__payload___key", "v", *RESERVED] and out.schema["__payload___key"].metadata == {ORIGINAL: "__key"}
    assert restore(out.filter("v = 1")).columns == ["__key", "v"]
    h = [("a", b"1"), ("a", None), ("ü", b"")]
    row = spark.createDataFrame([(h,), (None,)], "h array<struct<key:string,value:binary>>").select(encode_headers(F.col("h")).alias("b"))
    back = [r[0] for r in row.select(decode_headers(F.col("b"))).collect()]
    assert [(x["key"], bytes(x["value"]) if x["value"] is not None else None) for x in back[0]] == h and back[1] == []


@pytest.mark.parametrize("value,kind,target,ok", [("2.0", "double", "long", 2), ("1.5", "double", "int", None), ("300", "int", "byte", None), ("'17'", "string", "int", 17), ("'1.5'", "string", "int", None), ("5", "int", "string", "5"), ("1e30", "double", "long", None)])
def test_coerce(spark, value, kind, target, ok):
    df = spark.sql(f"SELECT CAST({value} AS {kind}) AS v")
    types = {"long": T.LongType(), "int": T.IntegerType(), "byte": T.ByteType(), "string": T.StringType()}
    out = df.select(coerce(F.col("v"), df.schema["v"].dataType, types[target]))
    if ok is None:
        with pytest.raises(Exception, match="integral|range|CAST"):
            out.collect()
    else:
        assert out.head()[0] == ok


def test_sized_kinds(spark):
    df = spark.sql("SELECT 18446744073709551615BD AS u, X'01020304' AS f, array(1, 2) AS l")
    assert str(df.select(unsigned(F.col("u"), "uint64")).head()[0]) == "18446744073709551615"
    assert df.select(fixed_width(F.col("f"), 4), fixed_list(F.col("l"), 2)).count() == 1
    for bad in (unsigned(F.col("u"), "uint32"), fixed_width(F.col("f"), 3), fixed_list(F.col("l"), 3)):
        with pytest.raises(Exception, match="range|bytes|elements"):
            df.select(bad).collect()


class Simulator:
    """Batch by batch, row by row, as plain loops."""

    def __init__(self, size, retention):
        self.size, self.retention, self.st, self.groups = size, retention, {}, {}

    def feed(self, rows):
        out = {}
        for _, _, t, p in rows:
            self.st[p] = max(self.st.get(p, t), t)
        for p in {r[3] for r in rows}:
            keep = {k: v for k, v in self.groups.items() if k[0] != p or k[2] + self.size >= self.st[p] - self.retention}
            self.groups = keep
        for u, a, t, p in rows:
            start = t // self.size * self.size
            if start + self.size >= self.st[p] - self.retention:
                total, n = self.groups.get((p, u, start), (0, 0))
                self.groups[p, u, start] = (total + a, n + 1)
        for p in {r[3] for r in rows}:
            out |= {k: v for k, v in self.groups.items() if k[0] == p}
        return out


def random_batches(seed, n=4):
    rng = random.Random(seed)
    return [[(rng.choice("ab"), rng.randint(1, 9), rng.randint(-20, 60) + 10 * b, rng.randint(0, 1)) for _ in range(rng.randint(1, 6))] for b in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_incremental_and_replayed_windows_equal_the_simulation(spark, seed):
    batches = random_batches(seed)
    sim, op, state = Simulator(10, 20), GroupBy(["user"], TOTALS, 10, 20), {}
    want = []
    for i, rows in enumerate(batches):
        expected = sim.feed(rows)
        out, state = op.process([batch(spark, *rows)], state)
        state = {k: written(v) for k, v in state.items()}
        assert {(r["__partition"], r["user"], r["__window_start"]): (r["total"], r["n"]) for r in out.collect()} == expected
        want += [(i, *k, *v) for k, v in expected.items()]
    rows = batch(spark, *batches[0]).withColumn("batch", F.lit(0))
    for i, b in enumerate(batches[1:], 1):
        rows = rows.union(batch(spark, *b).withColumn("batch", F.lit(i)))
    rows = rows.select("user", "amount", "batch", *RESERVED)
    out = replay_group_by(rows, ["user"], TOTALS, 10, 20)
    assert got(out, "batch", "__partition", "user", "__window_start", "total", "n") == sorted(want, key=repr)


def test_cumulative_group_re_emits_everything(spark):
    op, state = GroupBy(["user"], TOTALS), {}
    _, state = op.process([batch(spark, ("a", 5, 1, 0), ("b", 1, 1, 0))], state)
    out, state = op.process([batch(spark, ("a", 2, 2, 0))], state)
    assert got(out, "user", "total", "n") == [("a", 7, 2), ("b", 1, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_incremental_join_equals_replay(spark, seed):
    rng, window = random.Random(seed), 15
    op, state, seen = IntervalJoin("user", "user", window), {}, []
    frames = {"l": [], "r": []}
    for b in range(4):
        sides = {}
        for s in "lr":
            rows = [(rng.choice("ab"), 100 * b + 10 * i + (s == "r"), rng.randint(0, 60) + 12 * b, rng.randint(0, 1)) for i in range(rng.randint(1, 4))]
            sides[s] = batch(spark, *rows)
            frames[s].append(sides[s].withColumn("batch", F.lit(b)).select("user", "amount", "batch", *RESERVED))
        out, state = op.process([sides["l"], sides["r"]], state)
        state = {k: written(v) for k, v in state.items()}
        seen += [(b, r["left_amount"], r["right_amount"], r["__partition"]) for r in out.collect()]
    whole = {s: frames[s][0].union(frames[s][1]).union(frames[s][2]).union(frames[s][3]) for s in "lr"}
    replayed = replay_join(whole["l"], whole["r"], "user", "user", window)
    assert sorted(seen) == got(replayed, "batch", "left_amount", "right_amount", "__partition")


class Counter(Processor):
    def __init__(self):
        self.n = 0

    def process(self, rows):
        self.n += len(rows)
        return [pa.table({"partition": [rows.column("__partition")[0].as_py()], "n": [self.n]})]

    def snapshot(self):
        return self.n.to_bytes(4, "big")

    def restore(self, data):
        self.n = int.from_bytes(data, "big")


def test_custom_operator_keeps_state_by_partition(spark):
    op, state = Custom(Counter, T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("n", T.LongType())])), {}
    _, state = op.process([batch(spark, ("a", 1, 1, 0), ("a", 1, 1, 0), ("a", 1, 1, 1))], state)
    out, _ = op.process([batch(spark, ("a", 1, 1, 0))], state)
    assert got(out, "partition", "n") == [(0, 3)]
