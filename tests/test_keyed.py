"""State in Spark's store, against replays, recomputation and simulations, over random cuts into batches."""

import datetime
import decimal
import random
from collections import Counter

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.errors import LakeError
from strandlake.functions.aggregates import Aggregate, Aggregation
from strandlake.operators import folds
from strandlake.plans import replay
from strandlake.streaming import bounded, keyed

COUNT, SUM, MIN, MAX = Aggregate.COUNT, Aggregate.SUM, Aggregate.MIN, Aggregate.MAX
AGGREGATIONS = [Aggregation("v", "n", COUNT), Aggregation("v", "total", SUM), Aggregation("w", "low", MIN), Aggregation("w", "high", MAX)]
BATCHES = 5


@pytest.fixture(autouse=True)
def few_partitions(spark):
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", had)


def records(spark, seed, cuts, rows=60):
    """Records of ``cuts`` random cuts, each a partition of its own, so that one run of a stream tests them all."""
    rng, out = random.Random(seed), []
    for cut in range(cuts):
        bounds = sorted(rng.random() for _ in range(BATCHES - 1))
        for i in range(rows):
            batch = sum(i / rows >= b for b in bounds)
            ts = int(i * 10 + rng.choice([0, 0, -60, -300, 40]))
            out.append((cut, ts, rng.choice(["a", "b", None]), rng.choice([1, 2**62, -5, None]), rng.choice([0.5, -1.5, float("nan"), None]), batch, i))
    return spark.createDataFrame(out, "__partition int, __timestamp long, k string, v long, w double, batch long, i long")


def feed(df):
    return bounded.Feed(df, F.col("batch"))


def counted(df, *names):
    return Counter(str(tuple(r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("size,retention", [(None, None), (50, None), (30, 100)])
def test_groupings_equal_replays_for_20_cuts(spark, size, retention):
    aggregations = [Aggregation("v", "n", COUNT), Aggregation("v", "total", SUM, T.DecimalType(38, 0)), *AGGREGATIONS[2:]]
    df = records(spark, size or 1, 20)
    f = feed(df)
    got = bounded.run(keyed.group_by(f.frame.drop("batch"), ["k"], *aggregations, size=size, retention=retention), f, batches=BATCHES)
    want = replay.replay_group_by(df, ["k"], aggregations, size, retention)
    names = ["__partition", "batch", "k", *(["__window_start", "__window_end"] if size else []), "n", "total", "low", "high"]
    # A micro-batch without rows for a partition shows nothing for it; batches are numbered as they come.
    assert counted(got, *names) == counted(want, *names) and sum(counted(want, *names).values()) > 300


def test_interval_joins_equal_replays_for_20_cuts(spark):
    for window in (0, 200):
        df = records(spark, window, 20, 40)
        left, right = df.filter("i % 3 > 0").drop("w"), df.filter("i % 3 < 2").select("__partition", "__timestamp", "k", "batch", "i")
        f = feed(df)
        s = f.frame
        joined = keyed.interval_join(s.filter("i % 3 > 0").drop("w"), s.filter("i % 3 < 2").select("__partition", "__timestamp", "k", "batch", "i"), "k", "k", window)
        want = replay.replay_join(left, right, "k", "k", window)
        got = bounded.run(joined, f, batches=BATCHES)
        names = ["__partition", "left_i", "right_i", "left_v", "__timestamp"]
        assert counted(got, *names) == counted(want, *names) and want.count() > 50


def test_every_type_keeps_its_value(spark):
    at = datetime.datetime(2024, 3, 31, 1, 30, 0, 123457)
    rows = [(0, i, i % 2 == 0, i, decimal.Decimal("12345678901234567890.123"), at, at.date(), bytes([i, 255]), [1, None], 1e-300 * i, "ü\n\"") for i in range(4)]
    schema = "__partition int, __timestamp long, b boolean, i int, d decimal(30,3), t timestamp, day date, raw binary, many array<int>, x double, s string"
    df = spark.createDataFrame(rows, schema)
    f = bounded.Feed(df, F.col("i") % 2)
    s = f.frame
    names = ["b", "i", "d", "t", "day", "raw", "many", "x", "s"]
    got = bounded.run(keyed.interval_join(s, s.select("__partition", "__timestamp", "i"), "i", "i", 0), f, batches=2)
    assert counted(got, *["left_" + n for n in names]) == counted(df, *names)
    g = bounded.Feed(df, F.col("i") % 2)
    grouped = bounded.run(keyed.group_by(g.frame, ["d", "t", "day", "raw"], Aggregation("i", "n", COUNT), changed_only=True), g, batches=2)
    assert counted(grouped, "d", "t", "day", "raw", "n") == counted(df.withColumn("n", F.lit(1)), "d", "t", "day", "raw", "n")


def test_windows_are_evicted_and_state_is_typed(spark, tmp_path):
    rows = [(0, t, "k", 1, None, b, t) for b, t in enumerate([5, 15, 400, 401])]
    df = spark.createDataFrame(rows, "__partition int, __timestamp long, k string, v long, w double, batch long, i long")
    checkpoint = str(tmp_path / "c")
    f = feed(df)
    bounded.run(keyed.group_by(f.frame, ["k"], *AGGREGATIONS, size=10, retention=20), f, batches=4, checkpoint=checkpoint)
    state = keyed.read_map(spark, checkpoint, "groups")
    assert [(r["k_k"], r["k___window_start"], r["count_0"], r["sum_1"]) for r in state.collect()] == [("k", 400, 2, 2)]
    assert keyed.read_value(spark, checkpoint, "time").select("latest").collect()[0][0] == 401


CHANGELOG = "key long, name string, ref long, version long, deleted boolean, batch long"


def changelog(rng, keys, rows, refs=5):
    out = []
    for v in range(rows):
        batch = rng.randrange(BATCHES)
        out.append((rng.randrange(keys), f"n{rng.randrange(9)}", rng.choice([None, *range(refs)]), v, rng.random() < 0.25, batch))
    return out


def latest(rows):
    last = {}
    for r in sorted(rows, key=lambda r: r[3]):
        last[r[0]] = None if r[4] else r
    return {k: r for k, r in last.items() if r}


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_table_joins_equal_recomputation(spark, how):
    """Versions come in any order; the largest counts, tombstones too."""
    rng = random.Random(len(how))
    a, b = changelog(rng, 12, 120), changelog(rng, 12, 90)
    feeds = [feed(spark.createDataFrame(x, CHANGELOG)) for x in (a, b)]
    left, right = (f.frame.drop("batch", "ref") for f in feeds)
    changes = bounded.run(keyed.table_join(left, right, how=how), *feeds, batches=BATCHES)
    got = sorted(str(tuple(r)) for r in keyed.settled_rows(changes.select("key", "left_name", "right_name", "change")).collect())
    la, lb = latest(a), latest(b)
    keys = {"inner": la.keys() & lb.keys(), "left": la.keys(), "full": la.keys() | lb.keys()}[how]
    assert got == sorted(str((k, la[k][1] if k in la else None, lb[k][1] if k in lb else None)) for k in keys)
    assert {r["change"] for r in changes.select("change").distinct().collect()} == {1, -1}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_foreign_joins_equal_recomputation_after_every_batch(spark, how):
    """Updates, moves from key to key, deletes on both sides."""
    rng = random.Random(40 + len(how))
    a, b = changelog(rng, 15, 150), changelog(rng, 5, 60)
    a = [(k, n, r, v, d, v * BATCHES // 150) for k, n, r, v, d, _ in a]
    b = [(k, n, r, v, d, v * BATCHES // 60) for k, n, r, v, d, _ in b]
    feeds = [feed(spark.createDataFrame(x, CHANGELOG)) for x in (a, b)]
    left, right = (f.frame.drop("batch") for f in feeds)
    changes = bounded.run(keyed.foreign_join(left, right, F.col("ref"), how=how), *feeds, batches=BATCHES)
    for upto in range(BATCHES):
        part = changes.filter(f"batch <= {upto}").select("key", "left_name", "left_ref", "right_name", "change")
        got = sorted(str(tuple(r)) for r in keyed.settled_rows(part).collect())
        la, lb = latest([r for r in a if r[5] <= upto]), latest([r for r in b if r[5] <= upto])
        want = [(k, r[1], r[2], lb[r[2]][1] if r[2] in lb else None) for k, r in la.items() if how == "left" or r[2] in lb]
        assert got == sorted(map(str, want)), upto


def test_a_foreign_key_that_all_rows_name_lies_in_leaves(spark, tmp_path, monkeypatch):
    """20,000 rows name one key, a third move to another, some go, and both keys' rows change: all in one group, whose leaves double; each is one entry of the store."""
    monkeypatch.setattr(keyed, "GROUPS", 1)
    n, checkpoint = 20_000, str(tmp_path / "c")
    steps = spark.range(n).selectExpr("id AS key", "explode(sequence(0, 2)) AS version").filter("version = 0 or version = 1 and key % 3 = 0 or version = 2 and key % 5 = 0")
    left = steps.selectExpr("key", "3 * key AS amount", "if(version > 0 and key % 3 = 0, 2, 1) AS ref", "version", "version = 2 AS deleted")
    right = spark.createDataFrame([(1, "a", 0, False), (1, "b", 1, False), (2, "c", 1, False), (2, None, 2, True), (3, "d", 0, False)], "key int, name string, version int, deleted boolean")
    feeds = [bounded.Feed(df, F.col("version")) for df in (left, right)]
    changes = bounded.run(keyed.foreign_join(feeds[0].frame, feeds[1].frame, F.col("ref"), how="left"), *feeds, batches=3, checkpoint=checkpoint)
    got = keyed.settled_rows(changes.select("key", "left_amount", "left_ref", "right_name", "change"))
    want = spark.range(n).filter("id % 5 <> 0").selectExpr("id", "3 * id", "if(id % 3 = 0, 2, 1)", "if(id % 3 = 0, null, 'b')")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    leaves = keyed.read_map(spark, checkpoint, "subscriptions", operatorId=0).selectExpr("leaf", "size(pk) AS n").collect()
    assert 1 < len(leaves) <= 4 and sum(r["n"] for r in leaves) == 16_000 and max(r["n"] for r in leaves) < keyed.LEAF


@pytest.mark.parametrize("kind,keys", [("double", [-0.0, 0.0, float("nan"), 1.5]), ("binary", [b"\xff", b"\xfe", b"a", b"b"]), ("date", ["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-04"])])
def test_keys_of_a_foreign_join_keep_their_type(spark, kind, keys):
    """Keys of any type come back as they were; -0.0 is 0.0, and a row without a version comes before all others."""
    rows = [(str(k) if kind == "date" else k, i, None if i < 4 else 2**53 + i, "x") for i, k in enumerate(keys + keys)]
    left = spark.createDataFrame(rows, f"key {'string' if kind == 'date' else kind}, n int, version long, ref string").withColumn("key", F.col("key").cast(kind))
    right = spark.createDataFrame([("x", "r", 1)], "key string, name string, version long")
    feeds = [bounded.Feed(df, F.lit(0)) for df in (left, right)]
    got = keyed.settled_rows(bounded.run(keyed.foreign_join(feeds[0].frame, feeds[1].frame, F.col("ref")), *feeds).select("key", "left_n", "right_name", "change"))
    want = left.filter("n >= 5" if kind == "double" else "n >= 4").selectExpr("key", "n", "'r'")
    assert got.schema["key"].dataType == left.schema["key"].dataType
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("how,history", [("inner", 10_000), ("left", 10_000), ("left", 60)])
def test_as_of_joins_equal_recomputation(spark, how, history):
    """Versions and records come late, up to the history and beyond it."""
    rng = random.Random(history + len(how))
    late = 200 if history > 1000 else 20
    rows = []
    for i in range(200):
        ts = max(0, i * 5 - rng.choice([0, 0, rng.randrange(late)]))
        rows.append((rng.choice("ab"), ts, i % 2, i, rng.random() < 0.2, i * BATCHES // 200))
    df = spark.createDataFrame(rows, "key string, ts long, kind int, version long, deleted boolean, batch long")
    f = feed(df)
    s = f.frame
    joined = keyed.as_of_join(s.filter("kind = 0").select("key", "ts", F.col("version").alias("id")), s.filter("kind = 1").select("key", "ts", "version", "deleted", F.col("version").alias("id")), history, how=how)
    changes = bounded.run(joined, f, batches=BATCHES)
    got = sorted(str((r["id"], r["version_id"])) for r in keyed.settled_rows(changes.select("id", "version_id", "change")).collect())
    want = []
    for key, ts, kind, i, _, _ in rows:
        if kind == 0:
            known = [(t, v, d) for k, t, q, v, d, _ in rows if k == key and q == 1 and t <= ts]
            version = max(known)[1] if known and not max(known)[2] else None
            if how == "left" or version is not None:
                want.append(str((i, version)))
    assert got == sorted(want)


def test_old_versions_and_records_leave_the_state(spark, tmp_path):
    rows = [("a", t, k, t, t // 120) for t in range(0, 600, 10) for k in (0, 1)]
    f = feed(spark.createDataFrame(rows, "key string, ts long, kind int, id long, batch long"))
    checkpoint, s = str(tmp_path / "c"), f.frame
    bounded.run(keyed.as_of_join(s.filter("kind = 0").select("key", "ts", "id"), s.filter("kind = 1").select("key", "ts", "id"), 50), f, batches=BATCHES, checkpoint=checkpoint)
    assert sorted(r["valid_from"] for r in keyed.read_map(spark, checkpoint, "versions").collect()) == [540, 550, 560, 570, 580, 590]
    assert keyed.read_map(spark, checkpoint, "versions").filter("valid_from = 540").collect()[0]["valid_to"] == 550


@pytest.mark.parametrize("gap", [0, 7, 40])
def test_sessions_equal_recomputation(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice(["a", "b"]), rng.randrange(800), rng.randrange(100), rng.randrange(BATCHES)) for _ in range(150)]
    f = feed(spark.createDataFrame(rows, "key string, ts long, v long, batch long"))
    changes = bounded.run(keyed.sessions(f.frame, gap, Aggregation("v", "n", COUNT), Aggregation("v", "total", SUM), Aggregation("v", "low", MIN)), f, batches=BATCHES)
    got = sorted(tuple(r) for r in keyed.settled_rows(changes.drop("batch")).collect())
    want = []
    for key in "ab":
        times = sorted((t, v) for k, t, v, _ in rows if k == key)
        groups = []
        for t, v in times:
            if groups and t - groups[-1][-1][0] <= gap:
                groups[-1].append((t, v))
            else:
                groups.append([(t, v)])
        want += [(key, g[0][0], g[-1][0], len(g), sum(v for _, v in g), min(v for _, v in g)) for g in groups]
    assert got == sorted(want)


@pytest.mark.parametrize("difference", [0, 9, 60])
def test_sliding_windows_equal_recomputation(spark, difference):
    rng = random.Random(difference)
    rows = [(rng.choice(["a", "b"]), rng.randrange(400), rng.randrange(100), rng.randrange(BATCHES)) for _ in range(90)]
    f = feed(spark.createDataFrame(rows, "key string, ts long, v long, batch long"))
    changes = bounded.run(keyed.sliding(f.frame, difference, Aggregation("v", "n", COUNT), Aggregation("v", "total", SUM), retention=1000), f, batches=BATCHES)
    got = sorted(tuple(r) for r in keyed.settled_rows(changes.drop("batch")).collect())
    want = []
    for key in "ab":
        mine = [(t, v) for k, t, v, _ in rows if k == key]
        for s in {t - difference for t, _ in mine} | {t + 1 for t, _ in mine}:
            inside = [v for t, v in mine if s <= t <= s + difference]
            if inside:
                want.append((key, s, s + difference, len(inside), sum(inside)))
    assert got == sorted(want)


TEXT = T.StructType([T.StructField("n", T.LongType()), T.StructField("path", T.StringType())])


def test_folds_carry_state(spark):
    """In order within a batch and from batch to batch; a bounded fold, plain and merged, says the same."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.choice("xyz"), i * BATCHES // 300) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, ts long, v string, batch long")
    step = lambda s, r: (s[0] + 1, s[1] + r["v"])
    want = {k: (sum(r[0] == k for r in rows), "".join(r[2] for r in rows if r[0] == k)) for k in ("hot", "a", "b")}
    f = feed(df)
    changes = bounded.run(keyed.fold(f.frame, "key", ["ts"], (0, ""), step, TEXT), f, batches=BATCHES)
    assert {r["key"]: (r["n"], r["path"]) for r in keyed.settled_rows(changes.drop("batch")).collect()} == want
    for merge in (None, lambda a, b: (a[0] + b[0], a[1] + b[1])):
        got = folds.fold(df.repartition(7), "key", ["ts"], (0, ""), step, TEXT, merge)
        assert {r["key"]: (r["n"], r["path"]) for r in got.collect()} == want
    assert folds.fold(df.limit(0), "key", ["ts"], (0, ""), step, TEXT).collect() == []
    null = spark.createDataFrame([(None, 2, "b", 0), (None, 1, "a", 0), ("k", 1, "c", 0)], df.schema)
    assert sorted(((r["key"], r["path"]) for r in folds.fold(null, "key", ["ts"], (0, ""), step, TEXT, lambda a, b: (a[0] + b[0], a[1] + b[1])).collect()), key=repr) == [("k", "c"), (None, "ab")]


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(20_000).selectExpr("'hot' AS key", "id AS ts", "'x' AS v")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seen = folds.fold(df, "key", ["ts"], (0, ""), lambda s, r: (s[0] + 1, str(TaskContext.get().partitionId())), TEXT, lambda a, b: (max(a[0], b[0]), f"{a[1]},{b[1]}"))
        n, tasks = seen.select("n", "path").head()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert n < 10_000 and len(set(tasks.split(","))) > 4


def test_errors(spark):
    df = records(spark, 1, 1)
    for call in (lambda: keyed.group_by(df, []), lambda: keyed.group_by(df, ["k"], size=5, retention=1), lambda: keyed.table_join(df, df, how="outer"), lambda: keyed.foreign_join(df, df, F.col("k"), how="full"), lambda: keyed.as_of_join(df, df, -1), lambda: keyed.interval_join(df, df, "k", "v", 1)):
        with pytest.raises(LakeError):
            call()
