"""Registered queries of the engine and the SQL that says the same on the same tables.

Sums are of whole numbers, times are milliseconds, bytes are hexadecimal text, so both sides agree to the last digit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.aggregates import Aggregate, Aggregation
from .operators import relational as R
from .operators import stateful as S
from .operators import folds, table_functions
from .plans import replay
from .plans.tables import REPLAY, events, lineitem, orders
from .plans.topology import Topology
from .records import decode_headers, encode_headers, to_raw
from .sources import framing
from .sources.codecs import BlobCodec, FrameCodec, GzipCodec, JsonCodec, infer_json
from .streaming import bounded, dsl, keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY, HOUR = 86_400_000, 3_600_000
SUM, COUNT, MIN, MAX = Aggregate.SUM, Aggregate.COUNT, Aggregate.MIN, Aggregate.MAX

#: The events topic in SQL; SQL texts below name it E (and O, L for orders, lineitem).
_E = """E AS (SELECT event_id, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents, props,
 epoch_us(ts) // 1000 AS t, CAST(user_id %% 4 AS INTEGER) AS p, event_id AS o, CAST(event_id // %d AS BIGINT) AS batch FROM events)""" % REPLAY
_O = "O AS (SELECT *, epoch_us(o_orderdate) // 1000 AS t, CAST(o_custkey % 4 AS INTEGER) AS p FROM orders)"
_L = "L AS (SELECT *, epoch_us(l_shipdate) // 1000 AS t, CAST(l_orderkey % 4 AS INTEGER) AS p FROM lineitem)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            used = [d for d, n in ((_E, "E"), (_O, "O"), (_L, "L")) if f" {n} " in sql.replace("\n", " ") + " "]
            extra = ""
            if sql.lstrip().startswith("WITH"):
                extra, sql_ = sql.lstrip()[4:], ""
            else:
                sql_ = sql
            SQL[f.__name__] = ("WITH " + ", ".join([*used, extra.strip()] if extra else used) + " " + sql_) if used or extra else sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a topology: filter, group by user, one sink."""
    return topology_flagship(spark, sf_dir)


@query("SELECT user_id, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n, p AS __partition FROM E WHERE value > 4 GROUP BY user_id, p")
def topology_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Topology()
    source = t.add_source("events", "events", FrameCodec())
    large = t.add_filter("large", F.col("value") > 4, source)
    totals = t.add_group_by("totals", ["user_id"], [Aggregation("cents", "total", SUM), Aggregation("cents", "n", COUNT)], large)
    t.add_sink("out", "totals", FrameCodec(), totals)
    return t.build().run_batch("events", events(spark, sf_dir))["totals"]


@query("SELECT event_id, user_id, value, t AS ts, p AS part FROM E WHERE value > 4")
def filter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_rows(events(spark, sf_dir), F.col("value") > 4).select("event_id", "user_id", "value", F.col("__timestamp").alias("ts"), F.col("__partition").alias("part"))


@query("SELECT user_id, event_type, lower(hex(CAST(user_id AS VARCHAR)::BLOB)) AS key_hex, t AS ts, p AS part, o AS off, 0 AS n_headers FROM E")
def select_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.select(events(spark, sf_dir), "user_id", "event_type", "user_id")
    return out.select("user_id", "event_type", F.lower(F.hex("__key")).alias("key_hex"), F.col("__timestamp").alias("ts"), F.col("__partition").alias("part"), F.col("__offset").alias("off"), F.size("__headers").alias("n_headers"))


@query("SELECT event_id, cents + 1 AS cents, cents * 2 AS double_cents, CAST(user_id AS VARCHAR) AS user_text, CAST(user_id AS INTEGER) AS user_id FROM E")
def with_columns_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.with_columns(events(spark, sf_dir), R.Derived("cents", F.col("cents") + 1), R.Derived("double_cents", F.col("cents") * 2, T.LongType()), R.Derived("user_text", F.col("user_id"), T.StringType()), R.Derived("user_id", F.col("user_id"), T.IntegerType()))
    return out.select("event_id", "cents", "double_cents", "user_text", "user_id")


@query("SELECT user_id, event_type, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n, p AS __partition FROM E GROUP BY ALL")
def group_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_by(events(spark, sf_dir), ["user_id", "event_type"], Aggregation("cents", "total", SUM), Aggregation("cents", "n", COUNT))


@query("SELECT user_id, min(CASE WHEN cents % 3 <> 0 THEN cents END) AS low, max(CASE WHEN cents % 3 <> 0 THEN cents END) AS high, min(event_type) AS first_type, p AS __partition FROM E GROUP BY user_id, p")
def group_min_max_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_columns(events(spark, sf_dir), R.Derived("some", F.when(F.col("cents") % 3 != 0, F.col("cents"))))
    return R.group_by(rows, ["user_id"], Aggregation("some", "low", MIN), Aggregation("some", "high", MAX), Aggregation("event_type", "first_type", MIN))


@query("SELECT k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, p AS __partition FROM (SELECT CASE WHEN event_type <> 'click' THEN event_type END AS k, CASE WHEN cents % 2 = 0 THEN cents END AS v, p FROM E ) GROUP BY k, p")
def group_count_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_columns(events(spark, sf_dir), R.Derived("k", F.when(F.col("event_type") != "click", F.col("event_type"))), R.Derived("v", F.when(F.col("cents") % 2 == 0, F.col("cents"))))
    return R.group_by(rows, ["k"], Aggregation("v", "n", COUNT), Aggregation("v", "total", SUM))


@query("SELECT p AS __partition, CAST(sum(CAST(CASE WHEN event_id % 2 = 0 THEN 9223372036854775807 - event_id ELSE event_id - 9223372036854775807 END AS HUGEINT)) AS VARCHAR) AS total FROM E GROUP BY p")
def group_sum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.lit(9223372036854775807)
    rows = R.with_columns(events(spark, sf_dir), R.Derived("v", F.when(F.col("event_id") % 2 == 0, big - F.col("event_id")).otherwise(F.col("event_id") - big)))
    return R.group_by(rows, ["__partition"], Aggregation("v", "total", SUM, T.DecimalType(38, 0))).select("__partition", F.col("total").cast("string").alias("total"))


@query("SELECT o_orderpriority, CAST(sum(q) AS BIGINT) AS total, CAST(sum(q) AS DOUBLE) AS total_double, p AS __partition FROM (SELECT o_orderpriority, CAST(o_custkey AS INTEGER) AS q, p FROM O ) GROUP BY o_orderpriority, p")
def group_output_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_columns(orders(spark, sf_dir), R.Derived("q", F.col("o_custkey"), T.IntegerType()))
    return R.group_by(rows, ["o_orderpriority"], Aggregation("q", "total", SUM, T.LongType()), Aggregation("q", "total_double", SUM, T.DoubleType()))


@query("SELECT event_type, CAST(round(sum(value), 4) AS DOUBLE) AS total, p AS __partition FROM E GROUP BY event_type, p")
def group_sum_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.group_by(events(spark, sf_dir), ["event_type"], Aggregation("value", "total", SUM))
    return out.withColumn("total", F.round("total", 4))


@query("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total, p AS __partition FROM O GROUP BY o_orderstatus, p")
def group_sum_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_columns(orders(spark, sf_dir), R.Derived("price", F.col("o_totalprice").cast("decimal(18,2)")))
    return R.group_by(rows, ["o_orderstatus"], Aggregation("price", "total", SUM)).withColumn("total", F.col("total").cast("string"))


_WINDOWS = """WITH W AS (SELECT event_type, t - ((t %% %(s)d) + %(s)d) %% %(s)d AS ws, p, cents, max(t) OVER (PARTITION BY p) AS st FROM E )
 SELECT event_type, ws AS __window_start, ws + %(s)d AS __window_end, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n, p AS __partition
 FROM W WHERE ws + %(s)d >= st - %(r)d GROUP BY event_type, ws, p"""
_TOTALS = (Aggregation("cents", "total", SUM), Aggregation("cents", "n", COUNT))


@query(_WINDOWS % {"s": DAY, "r": DAY})
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.windowed_group_by(events(spark, sf_dir), ["event_type"], DAY, *_TOTALS)


@query(_WINDOWS % {"s": DAY, "r": 7 * DAY})
def window_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.windowed_group_by(events(spark, sf_dir), ["event_type"], DAY, *_TOTALS, retention=7 * DAY)


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    return R.with_columns(df, R.Derived("batch", F.expr(f"event_id div {REPLAY}L")))


@query("""WITH B AS (SELECT DISTINCT p, batch FROM E )
 SELECT B.batch AS batch, B.p AS __partition, event_type, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM B JOIN E ON E.p = B.p AND E.batch <= B.batch GROUP BY B.batch, B.p, event_type""")
def replay_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_group_by(_replayed(spark, sf_dir), ["event_type"], _TOTALS)


@query(f"""WITH B AS (SELECT p, batch, max(m) OVER (PARTITION BY p ORDER BY batch) AS st FROM (SELECT p, batch, max(t) AS m FROM E GROUP BY p, batch)),
 W AS (SELECT *, t - ((t % {DAY}) + {DAY}) % {DAY} AS ws FROM E )
 SELECT B.batch AS batch, B.p AS __partition, event_type, ws AS __window_start, ws + {DAY} AS __window_end, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n
 FROM B JOIN W ON W.p = B.p AND W.batch <= B.batch AND ws + {DAY} >= st - {3 * DAY} GROUP BY B.batch, B.p, event_type, ws""")
def replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_group_by(_replayed(spark, sf_dir), ["event_type"], _TOTALS, size=DAY, retention=3 * DAY)


def _clicks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return R.select(R.filter_rows(df, F.col("event_type") == "click"), "event_id", "user_id", "cents"), R.select(R.filter_rows(df, F.col("event_type") == "purchase"), "event_id", "user_id", "cents")


_JOIN = "SELECT l.event_id AS left_event_id, l.user_id AS left_user_id, l.cents AS left_cents, r.event_id AS right_event_id, r.user_id AS right_user_id, r.cents AS right_cents, l.t AS ts, l.p AS part FROM E l JOIN E r ON l.p = r.p AND l.user_id = r.user_id AND abs(l.t - r.t) <= %d WHERE l.event_type = 'click' AND r.event_type = 'purchase'"


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("__timestamp")).withColumn("part", F.col("__partition")).drop("__key", "__timestamp", "__partition", "__offset", "__headers")


@query(_JOIN % HOUR)
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(R.interval_join(*_clicks(events(spark, sf_dir)), "user_id", "user_id", HOUR))


@query("SELECT l.event_id AS left_event_id, r.event_id AS right_event_id FROM E l JOIN E r ON l.p = r.p AND l.user_id = r.user_id AND l.t = r.t")
def join_zero_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.select(events(spark, sf_dir), "event_id", "user_id")
    return R.interval_join(rows, rows, "user_id", "user_id", 0).select("left_event_id", "right_event_id")


@query(f"""WITH T AS (SELECT p, batch, max(m) OVER (PARTITION BY p ORDER BY batch) AS st FROM (SELECT p, batch, max(t) AS m FROM E WHERE event_type IN ('click', 'purchase') GROUP BY p, batch)),
 C AS (SELECT *, max(t) OVER (PARTITION BY p, batch) AS latest FROM E WHERE event_type = 'click'),
 P AS (SELECT *, max(t) OVER (PARTITION BY p, batch) AS latest FROM E WHERE event_type = 'purchase')
 SELECT C.event_id AS left_event_id, P.event_id AS right_event_id, greatest(C.batch, P.batch) AS batch
 FROM C JOIN P ON C.p = P.p AND C.user_id = P.user_id AND abs(C.t - P.t) <= {HOUR * 12} JOIN T ON T.p = C.p AND T.batch = greatest(C.batch, P.batch)
 WHERE C.batch = P.batch OR CASE WHEN C.batch < P.batch THEN C.latest ELSE P.latest END >= st - {HOUR * 12}""")
def replay_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _replayed(spark, sf_dir)
    left = R.select(R.filter_rows(df, F.col("event_type") == "click"), "event_id", "user_id", "batch")
    right = R.select(R.filter_rows(df, F.col("event_type") == "purchase"), "event_id", "user_id", "batch")
    return replay.replay_join(left, right, "user_id", "user_id", 12 * HOUR).select("left_event_id", "right_event_id", "batch")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def merge_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.select(orders(spark, sf_dir), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return R.merge(R.filter_rows(rows, F.col("o_orderstatus") == "F"), R.filter_rows(rows, F.col("o_totalprice") > 100000)).select("o_orderkey", "o_custkey")


@query("SELECT 'large' AS sink, event_id FROM E WHERE value > 50 UNION ALL SELECT 'all' AS sink, event_id FROM E")
def fanout_two_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Topology()
    source = t.add_source("events", "events", FrameCodec())
    t.add_sink("a", "large", FrameCodec(), t.add_filter("f", F.col("value") > 50, source))
    t.add_sink("b", "all", FrameCodec(), source)
    out = t.build().run_batch("events", events(spark, sf_dir))
    return out["large"].select(F.lit("large").alias("sink"), "event_id").union(out["all"].select(F.lit("all").alias("sink"), "event_id"))


@query("SELECT CASE WHEN value > 50 THEN 'high' ELSE 'clicks' END AS branch, event_id FROM E WHERE value > 50 OR event_type = 'click'")
def split_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, clicks = R.split(events(spark, sf_dir), F.col("value") > 50, F.col("event_type") == "click")
    return high.select(F.lit("high").alias("branch"), "event_id").union(clicks.select(F.lit("clicks").alias("branch"), "event_id"))


@query("SELECT event_id, cents, p AS part FROM E QUALIFY row_number() OVER (PARTITION BY p ORDER BY cents DESC NULLS LAST, event_id) <= 10")
def top_n_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_n(events(spark, sf_dir), "cents", 10, "event_id").select("event_id", "cents", F.col("__partition").alias("part"))


def _raw(df: DataFrame) -> DataFrame:
    return to_raw(df.withColumn("__value", F.col("props").cast("binary")))


@query("SELECT o AS off, p AS part, t AS ts, lower(hex(CAST(user_id AS VARCHAR)::BLOB)) AS key_hex, lower(hex(props::BLOB)) AS value_hex FROM E")
def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Topology()
    t.add_pass_through_sink("out", "copy", t.add_source("raw", "raw", JsonCodec()))
    out = t.build().run_batch("raw", _raw(events(spark, sf_dir)))["copy"]
    return out.select(F.col("offset").alias("off"), F.col("partition").alias("part"), F.col("timestamp").alias("ts"), F.lower(F.hex("key")).alias("key_hex"), F.lower(F.hex("value")).alias("value_hex"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM E")
def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = JsonCodec(T.StructType([T.StructField("k", T.LongType())])).decode(_raw(events(spark, sf_dir)))
    return decoded.select(F.col("__offset").alias("event_id"), "k")


@query("SELECT event_id, event_type, user_id, cents, p AS part, t AS ts FROM E")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.select(events(spark, sf_dir), "event_id", "event_type", "user_id", "cents")
    back = JsonCodec(T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("cents", T.LongType())]))
    return back.decode(back.encode(rows)).select("event_id", "event_type", "user_id", "cents", F.col("__partition").alias("part"), F.col("__timestamp").alias("ts"))


@query("SELECT event_id, 7 + event_id AS schema_id, props AS body, lower('00' || lpad(to_hex(7 + event_id), 8, '0') || hex(props::BLOB)) AS framed FROM E")
def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = events(spark, sf_dir).select("event_id", framing.frame(F.col("props").cast("binary"), F.col("event_id") + 7).alias("f"))
    return framed.select("event_id", framing.schema_id(F.col("f")).cast("long").alias("schema_id"), framing.body(F.col("f")).cast("string").alias("body"), F.lower(F.hex("f")).alias("framed"))


@query("SELECT event_id, 2 AS n, event_type AS v0, '0000000200000001610000000' || length(event_type) || lower(hex(event_type::BLOB)) || '0000000162ffffffff' AS blob FROM E")
def headers_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.array(F.struct(F.lit("a").alias("key"), F.col("event_type").cast("binary").alias("value")), F.struct(F.lit("b").alias("key"), F.lit(None).cast("binary").alias("value")))
    rows = events(spark, sf_dir).select("event_id", encode_headers(h).alias("b"))
    back = rows.withColumn("h", decode_headers(F.col("b")))
    return back.select("event_id", F.size("h").alias("n"), F.col("h")[0]["value"].cast("string").alias("v0"), F.lower(F.hex("b")).alias("blob"))


@query("SELECT event_id, user_id, event_type, value, p AS part, t AS ts FROM E")
def blob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.select(events(spark, sf_dir), "event_id", "user_id", "event_type", "value")
    codec = BlobCodec(schema=rows.select("event_id", "user_id", "event_type", "value").schema)
    return codec.decode(codec.encode(rows)).select("event_id", "user_id", "event_type", "value", F.col("__partition").alias("part"), F.col("__timestamp").alias("ts"))


@query("SELECT event_id, user_id, cents FROM E")
def gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.select(events(spark, sf_dir), "event_id", "user_id", "cents")
    codec = GzipCodec(JsonCodec(T.StructType([T.StructField(n, T.LongType()) for n in ("event_id", "user_id", "cents")])))
    return codec.decode(codec.encode(rows)).select("event_id", "user_id", "cents")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(*) AS n, max(t) AS latest, p AS __partition FROM L GROUP BY l_returnflag, l_linestatus, p")
def group_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_columns(lineitem(spark, sf_dir), R.Derived("q", F.col("l_quantity"), T.LongType()), R.Derived("ts", F.col("__timestamp")))
    return R.group_by(rows, ["l_returnflag", "l_linestatus"], Aggregation("q", "qty", SUM), Aggregation("q", "n", COUNT), Aggregation("ts", "latest", MAX))


def _stream(spark: SparkSession, sf_dir: str) -> dsl.Stream:
    df = events(spark, sf_dir)
    return dsl.Stream(df.select(F.col("user_id").alias("key"), F.col("__timestamp").alias("ts"), "event_id", "event_type", "cents"))


@query("SELECT user_id AS key, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM E WHERE event_type <> 'click' GROUP BY user_id")
def dsl_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir).filter_not(F.col("event_type") == "click")
    return s.group_by_key().aggregate(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("total")).df


@query("SELECT event_type AS key, t AS ts, upper(event_type) AS label, cents * 2 AS twice FROM E WHERE user_id % 2 = 0")
def dsl_map_select_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).filter(F.col("key") % 2 == 0).map(F.col("event_type"), label=F.upper("event_type"), twice=F.col("cents") * 2).df


@query("SELECT user_id AS key, event_id, t AS ts FROM E UNION ALL SELECT user_id AS key, -event_id AS event_id, t AS ts FROM E")
def dsl_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).flat_map(F.array(F.struct("key", "event_id"), F.struct("key", (-F.col("event_id")).alias("event_id")))).df.select("key", "event_id", "ts")


@query("SELECT user_id AS key, t AS ts, event_id, event_type, cents FROM E QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1")
def ktable_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).to_table("event_id").df


_MID = 1_705_276_800_000


@query(f"SELECT user_id AS key, t AS ts, event_id, event_type, cents FROM E WHERE t <= {_MID} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1")
def versioned_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsl.Table.as_of(_stream(spark, sf_dir), _MID, "event_id").df


@query("SELECT c.event_id, v.event_id AS version_event_id FROM E c ASOF JOIN (SELECT user_id, t, max(event_id) AS event_id FROM E WHERE event_type = 'view' GROUP BY user_id, t) v ON c.user_id = v.user_id AND c.t >= v.t WHERE c.event_type = 'purchase'")
def temporal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir)
    views = s.filter(F.col("event_type") == "view")
    views = views._with(views.df.groupBy("key", "ts").agg(F.max("event_id").alias("event_id")))
    return s.filter(F.col("event_type") == "purchase").join_as_of(views).select("event_id", "version_event_id")


@query("SELECT o_orderkey AS order_key, c_name AS table_c_name, c_mktsegment AS table_c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def global_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = dsl.Stream(orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), F.col("__timestamp").alias("ts"), "o_custkey"))
    customers = dsl.Table(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return o.join_global(customers, F.col("o_custkey")).select(F.col("key").alias("order_key"), "table_c_name", "table_c_mktsegment")


@query("SELECT user_id AS key, E.event_id, n AS table_n FROM E LEFT JOIN (SELECT user_id AS u, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) > 12) x ON u = user_id")
def stream_table_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir)
    counts = s.filter(F.col("event_type") == "purchase").group_by_key().count("n").filter(F.col("n") > 12)
    return s.join_table(counts, "left").select("key", "event_id", "table_n")


@query("SELECT coalesce(a.k, b.k) AS key, a.n AS n, b.n AS right_n FROM (SELECT user_id AS k, count(*) AS n FROM E WHERE event_type = 'click' GROUP BY 1 HAVING count(*) > 12) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM E WHERE event_type = 'view' GROUP BY 1 HAVING count(*) > 12) b ON a.k = b.k")
def table_table_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir)
    a = s.filter(F.col("event_type") == "click").group_by_key().count("n").filter(F.col("n") > 12)
    b = s.filter(F.col("event_type") == "view").group_by_key().count("n").filter(F.col("n") > 12)
    return a.join(b, "full").df


@query("SELECT s_suppkey AS key, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def foreign_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = dsl.Table(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), "s_nationkey"))
    nations = dsl.Table(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"), "n_nationkey")
    return suppliers.join_foreign(nations, F.col("s_nationkey")).df.select("key", "n_name")


_SIDES = "(SELECT * FROM E WHERE event_type = 'click') a %s JOIN (SELECT * FROM E WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 3600000 AND a.t + 7200000"


def _windowed_join(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    s = _stream(spark, sf_dir)
    out = s.filter(F.col("event_type") == "click").join(s.filter(F.col("event_type") == "purchase"), HOUR, 2 * HOUR, how)
    return out.select("left_event_id", "right_event_id")


@query("SELECT a.event_id AS left_event_id, b.event_id AS right_event_id FROM " + _SIDES % "INNER")
def stream_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed_join(spark, sf_dir, "inner")


@query("SELECT a.event_id AS left_event_id, b.event_id AS right_event_id FROM " + _SIDES % "LEFT")
def stream_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed_join(spark, sf_dir, "left")


@query("SELECT a.event_id AS left_event_id, b.event_id AS right_event_id FROM " + _SIDES % "FULL")
def stream_join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed_join(spark, sf_dir, "full")


@query(f"SELECT user_id AS key, ws AS window_start, ws + {2 * HOUR} AS window_end, count(*) AS n FROM (SELECT user_id, t, unnest([t - t % {HOUR}, t - t % {HOUR} - {HOUR}]) AS ws FROM E ) GROUP BY 1, 2")
def hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).group_by_key().windowed_by(2 * HOUR, HOUR).count("n")


@query(f"""WITH S AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM
 (SELECT user_id, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM E ))
 SELECT user_id AS key, min(t) AS window_start, max(t) AS window_end, count(*) AS n FROM S GROUP BY user_id, g""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).group_by_key().session(HOUR, F.count(F.lit(1)).alias("n"))


@query(f"""WITH A AS (SELECT DISTINCT user_id, t - {HOUR} AS s FROM E UNION SELECT DISTINCT user_id, t + 1 AS s FROM E )
 SELECT A.user_id AS key, s AS window_start, s + {HOUR} AS window_end, count(*) AS n FROM A JOIN E ON A.user_id = E.user_id AND E.t BETWEEN s AND s + {HOUR} GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).group_by_key().sliding(HOUR, lambda w: F.count(F.lit(1)).over(w), "n")


@query(f"SELECT user_id AS key, t - t % {DAY} AS window_start, t - t % {DAY} + {DAY} AS window_end, count(*) AS count FROM E GROUP BY 1, 2 HAVING t - t % {DAY} + {DAY} + {HOUR} <= (SELECT max(t) FROM E )".replace("HAVING t - t %", "HAVING any_value(t - t %").replace(f"{DAY} + {DAY} + {HOUR} <=", f"{DAY}) + {DAY} + {HOUR} <="))
def suppressed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).group_by_key().windowed_by(DAY).suppressed(grace=HOUR)


@query("SELECT user_id AS key, string_agg(event_type, '>' ORDER BY t, event_type) AS path FROM E GROUP BY user_id")
def dsl_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).group_by_key().reduce(F.col("event_type"), lambda a, v: F.concat(a, F.lit(">"), v), "path").df


_EVENT_AVRO = {"type": "record", "name": "Event", "fields": [
    {"name": "event_id", "type": "long"}, {"name": "event_type", "type": {"type": "enum", "name": "Kind", "symbols": ["click", "error", "purchase", "signup", "view"]}},
    {"name": "user_id", "type": ["null", "int"], "default": None}, {"name": "cents", "type": "long"}, {"name": "tags", "type": {"type": "array", "items": "string"}},
]}


@query("SELECT event_id, event_type, CAST(CASE WHEN user_id % 2 = 0 THEN user_id END AS INTEGER) AS user_id, cents, event_type || '/x' AS tags, t AS ts FROM E")
def avro_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.avro import AvroCodec

    rows = R.with_columns(events(spark, sf_dir), R.Derived("user_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id")), T.IntegerType()), R.Derived("tags", F.array("event_type", F.lit("x"))))
    rows = R.select(rows, "event_id", "event_type", "user_id", "cents", "tags")
    sent = AvroCodec(_EVENT_AVRO, write_id=7).encode(rows)
    back = AvroCodec(_EVENT_AVRO).decode(sent)
    return back.select("event_id", "event_type", "user_id", "cents", F.array_join("tags", "/").alias("tags"), F.col("__timestamp").alias("ts"))


@query("SELECT event_id, event_type, user_id, cents FROM E")
def avro_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with one more field and narrower types than the reader has."""
    from .sources.avro import AvroCodec

    written = {"type": "record", "name": "Event", "fields": [{"name": "event_id", "type": "int"}, {"name": "note", "type": "string"}, {"name": "event_type", "type": "string"}, {"name": "user_id", "type": "int"}, {"name": "cents", "type": "long"}]}
    read = {"type": "record", "name": "Event", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": "string"}, {"name": "user_id", "type": "long"}, {"name": "cents", "type": "long"}]}
    rows = R.with_columns(events(spark, sf_dir), R.Derived("note", F.concat(F.lit("n"), F.col("event_id"))))
    back = AvroCodec(read, lambda i: json.dumps(written)).decode(AvroCodec(written, write_id=3).encode(R.select(rows, "event_id", "note", "event_type", "user_id", "cents")))
    return back.select("event_id", "event_type", "user_id", "cents")


def _event_descriptor():
    from google.protobuf import descriptor_pb2 as d

    from .sources.protobuf import load

    f = d.FileDescriptorProto(name="event.proto", package="e", syntax="proto3")
    m = f.message_type.add(name="Event")
    for i, (name, kind) in enumerate((("event_id", 3), ("event_type", 9), ("user_id", 13), ("cents", 18)), 1):
        m.field.add(name=name, number=i, type=kind, label=1)
    return load([f.SerializeToString()], "e.Event")


@query("SELECT event_id, event_type, user_id, cents, p AS part FROM E")
def proto_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.protobuf import ProtobufCodec

    codec = ProtobufCodec(_event_descriptor(), 5)
    rows = R.select(events(spark, sf_dir), "event_id", "event_type", "user_id", "cents")
    return codec.decode(codec.encode(rows)).select("event_id", "event_type", "user_id", "cents", F.col("__partition").alias("part"))


@query("SELECT user_id AS key, count(*) FILTER (WHERE event_type = 'click') AS clicks, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN CAST(sum(cents) FILTER (WHERE event_type = 'view') AS BIGINT) END AS viewed FROM E WHERE event_type IN ('click', 'view') GROUP BY user_id")
def dsl_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir)
    clicks, views = s.filter(F.col("event_type") == "click").group_by_key(), s.filter(F.col("event_type") == "view").group_by_key()
    out = clicks.cogroup([F.count(F.lit(1)).alias("clicks")], views, [F.sum("cents").alias("viewed")])
    return out.df.select("key", F.coalesce("clicks", F.lit(0)).alias("clicks"), "viewed")


@query("SELECT CASE WHEN value > 50 THEN 'high' WHEN event_type = 'click' THEN 'click' ELSE 'merged' END AS branch, event_id FROM E WHERE value > 50 OR event_type = 'click' UNION ALL SELECT 'merged' AS branch, event_id FROM E WHERE value > 50 OR event_type = 'click'")
def dsl_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, clicks = _branches(spark, sf_dir)
    both = high.merge(clicks)
    tag = lambda s, n: s.df.select(F.lit(n).alias("branch"), "event_id")
    return tag(high, "high").union(tag(clicks, "click")).union(tag(both, "merged"))


def _branches(spark: SparkSession, sf_dir: str) -> list[dsl.Stream]:
    df = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("__timestamp").alias("ts"), "event_id", "event_type", "value")
    return dsl.Stream(df).branch(F.col("value") > 50, F.col("event_type") == "click")


@query("SELECT user_id AS key, n FROM (SELECT user_id, count(*) AS n FROM E GROUP BY user_id) WHERE user_id BETWEEN 10 AND 20")
def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).group_by_key().count("n").range(10, 20)


@query("SELECT user_id, CAST(sum(cents) AS BIGINT) AS total, p AS __partition FROM E GROUP BY user_id, p HAVING p IN (SELECT p FROM E WHERE coalesce(event_id % 2 = 1, false))")
def topology_whole_in_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event, in two batches through one topology: what it shows after the second."""
    t = Topology()
    totals = t.add_group_by("totals", ["user_id"], [Aggregation("cents", "total", SUM)], t.add_source("events", "events", FrameCodec()))
    t.add_sink("out", "totals", FrameCodec(), totals)
    built, df = t.build(), events(spark, sf_dir)
    odd = F.coalesce(F.col("event_id") % 2 == 1, F.lit(False))
    for batch in (~odd, odd):
        out = built.run_batch("events", df.filter(batch))
    return out["totals"]


@query("SELECT event_id, event_type, p AS part FROM E")
def blob_many_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of many rows each, cut at a small limit; a record over the limit would be missing."""
    rows = R.select(events(spark, sf_dir), "event_id", "event_type").withColumns({"__key": F.lit(None).cast("binary"), "__timestamp": F.lit(0).cast("long")})
    codec = BlobCodec(4096, schema=rows.select("event_id", "event_type").schema)
    sent = codec.encode(rows).filter(F.octet_length("value") <= 4096)
    return codec.decode(sent).select("event_id", "event_type", F.col("__partition").alias("part"))


@query("SELECT event_id, event_type, cents FROM E")
def json_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of JSON records whose schema is taken from the records themselves."""
    raw = JsonCodec().encode(R.select(events(spark, sf_dir), "event_id", "event_type", "cents"))
    return JsonCodec(infer_json(raw)).decode(raw).select("event_id", "event_type", "cents")


@query("SELECT event_id, 2 * cents AS twice FROM E WHERE event_id % 2 = 0")
def custom_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom operator over Arrow batches."""

    def make():
        def process(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            kept = batch.filter(pc.equal(pc.bit_wise_and(batch.column("event_id"), 1), 0))
            yield pa.RecordBatch.from_arrays([kept.column("event_id"), pc.multiply(kept.column("cents"), 2)], ["event_id", "twice"])

        return process

    return R.arrow_operator(events(spark, sf_dir).select("event_id", "cents"), make, "event_id long, twice long")


class _Running(S.Processor):
    """Rows and cents of a partition so far, one row for each batch."""

    def __init__(self) -> None:
        self.n = self.total = 0

    def process(self, rows: pa.Table) -> list[pa.Table]:
        self.n += len(rows)
        self.total += pc.sum(rows.column("cents")).as_py() or 0
        return [pa.table({"part": pa.array([rows.column("__partition")[0].as_py()], pa.int32()), "n": [self.n], "total": [self.total]})]

    def snapshot(self) -> bytes:
        return json.dumps([self.n, self.total]).encode()

    def restore(self, data: bytes) -> None:
        self.n, self.total = json.loads(data)


@query("SELECT p AS part, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM E GROUP BY p")
def custom_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a custom processor says after the second of two batches, its state carried over."""
    df = events(spark, sf_dir)
    operator = S.Custom(_Running, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType())]))
    _, state = operator.process([df.filter(F.col("event_id") % 2 == 0)], {})
    return operator.process([df.filter(F.col("event_id") % 2 == 1)], state)[0]


# Streams: each table is fed in three pieces, and the state between them lies in Spark's store.

PIECES = 3


def _in_pieces(df: DataFrame, number: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    feed = bounded.Feed(df, F.expr(number))
    return bounded.run(operator(feed.frame), feed, batches=PIECES)


_E3 = "E3 AS (SELECT event_id, user_id, event_type, value, cents, t, p, event_id % 3 AS batch FROM E )"


@query(f"""WITH {_E3}, B AS (SELECT DISTINCT p, batch FROM E3)
 SELECT B.batch AS batch, B.p AS __partition, event_type, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM B JOIN E3 ON E3.p = B.p AND E3.batch <= B.batch GROUP BY B.batch, B.p, event_type""")
def live_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_pieces(events(spark, sf_dir), "event_id % 3", lambda df: keyed.group_by(df, ["event_type"], *_TOTALS))


@query(f"""WITH {_E3}, B AS (SELECT p, batch, max(m) OVER (PARTITION BY p ORDER BY batch) AS st FROM (SELECT p, batch, max(t) AS m FROM E3 GROUP BY p, batch)),
 W AS (SELECT *, t - ((t % {DAY}) + {DAY}) % {DAY} AS ws FROM E3)
 SELECT B.batch AS batch, B.p AS __partition, event_type, ws AS __window_start, ws + {DAY} AS __window_end, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n
 FROM B JOIN W ON W.p = B.p AND W.batch <= B.batch AND ws + {DAY} >= st - {3 * DAY} GROUP BY B.batch, B.p, event_type, ws""")
def live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_pieces(events(spark, sf_dir), "event_id % 3", lambda df: keyed.group_by(df, ["event_type"], *_TOTALS, size=DAY, retention=3 * DAY))


@query(f"""WITH {_E3}, T AS (SELECT p, batch, max(m) OVER (PARTITION BY p ORDER BY batch) AS st FROM (SELECT p, batch, max(t) AS m FROM E3 WHERE event_type IN ('click', 'purchase') GROUP BY p, batch)),
 C AS (SELECT *, max(t) OVER (PARTITION BY p, batch) AS latest FROM E3 WHERE event_type = 'click'),
 P AS (SELECT *, max(t) OVER (PARTITION BY p, batch) AS latest FROM E3 WHERE event_type = 'purchase')
 SELECT C.event_id AS left_event_id, P.event_id AS right_event_id, greatest(C.batch, P.batch) AS batch
 FROM C JOIN P ON C.p = P.p AND C.user_id = P.user_id AND abs(C.t - P.t) <= {HOUR * 12} JOIN T ON T.p = C.p AND T.batch = greatest(C.batch, P.batch)
 WHERE C.batch = P.batch OR CASE WHEN C.batch < P.batch THEN C.latest ELSE P.latest END >= st - {HOUR * 12}""")
def live_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_pieces(events(spark, sf_dir), "event_id % 3", lambda df: keyed.interval_join(*_clicks(df), "user_id", "user_id", 12 * HOUR)).select("left_event_id", "right_event_id", "batch")


def _table_changes(df: DataFrame, kind: str, gone: int) -> DataFrame:
    rows = df.filter(F.col("event_type") == kind)
    return rows.select(F.col("user_id").alias("key"), "cents", F.col("event_id").alias("version"), (F.col("event_id") % gone == 0).alias("deleted"))


@query("""SELECT coalesce(a.user_id, b.user_id) AS key, a.cents AS left_cents, b.cents AS right_cents FROM
 (SELECT * FROM (SELECT * FROM E WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_id % 5 <> 0) a FULL JOIN
 (SELECT * FROM (SELECT * FROM E WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_id % 7 <> 0) b ON a.user_id = b.user_id""")
def live_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changelogs with tombstones, whose rows come in any order; the signed changes of the join add up to its current rows."""
    changes = _in_pieces(events(spark, sf_dir), "2 - event_id % 3", lambda df: keyed.table_join(_table_changes(df, "click", 5), _table_changes(df, "view", 7), how="full"))
    return keyed.settled_rows(changes.drop("batch"))


@query("""SELECT o_orderkey AS key, o_totalprice AS left_o_totalprice, c.segment AS right_segment FROM
 (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 100 + 1 ELSE o_custkey END AS fk FROM orders WHERE o_orderkey % 10 <> 7) o LEFT JOIN
 (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 9 <> 0) c ON o.fk = c.c_custkey""")
def live_foreign_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers as changelogs: orders move to other customers or go, customers change or go; the join is kept up."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("version")
    o = orders(spark, sf_dir).select(F.col("o_orderkey").alias("key"), "o_totalprice", "o_custkey", steps)
    o = o.filter("version = 0 or (version = 1 and key % 3 = 0) or (version = 2 and key % 10 = 7)")
    o = o.select("key", "o_totalprice", F.when((F.col("key") % 3 == 0) & (F.col("version") > 0), F.col("o_custkey") % 100 + 1).otherwise(F.col("o_custkey")).alias("fk"), "version", (F.col("version") == 2).alias("deleted"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("key"), "c_mktsegment", steps)
    c = c.filter("version = 0 or (version = 1 and key % 4 = 0) or (version = 2 and key % 9 = 0)")
    c = c.select("key", F.when(F.col("version") > 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"), "version", (F.col("version") == 2).alias("deleted"))
    feeds = [bounded.Feed(df, F.col("version")) for df in (o, c)]
    joined = keyed.foreign_join(feeds[0].frame, feeds[1].frame, F.col("fk"), how="left")
    return keyed.settled_rows(bounded.run(joined, *feeds, batches=PIECES).select("key", "left_o_totalprice", "right_segment", "change"))


@query("SELECT c.user_id AS key, c.event_id, v.event_id AS version_event_id FROM E c ASOF JOIN (SELECT user_id, t, max(event_id) AS event_id FROM E WHERE event_type = 'view' GROUP BY user_id, t) v ON c.user_id = v.user_id AND c.t >= v.t WHERE c.event_type = 'purchase'")
def live_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions come up to the whole time late, and correct what was shown before."""

    def joined(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("user_id").alias("key"), F.col("__timestamp").alias("ts"), "event_id", "event_type")
        views = rows.filter("event_type = 'view'").select("key", "ts", "event_id", F.col("event_id").alias("version"))
        return keyed.as_of_join(rows.filter("event_type = 'purchase'").select("key", "ts", "event_id"), views, 3650 * DAY)

    changes = _in_pieces(events(spark, sf_dir), "event_id % 3", joined)
    return keyed.settled_rows(changes.select("key", "event_id", "version_event_id", "change"))


@query(f"""WITH S AS (SELECT user_id, t, cents, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM
 (SELECT user_id, event_id, t, cents, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM E ))
 SELECT user_id AS key, min(t) AS window_start, max(t) AS window_end, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM S GROUP BY user_id, g""")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that late records extend and connect."""

    def grouped(df: DataFrame) -> DataFrame:
        return keyed.sessions(df.select(F.col("user_id").alias("key"), F.col("__timestamp").alias("ts"), "cents"), HOUR, *_TOTALS)

    return keyed.settled_rows(_in_pieces(events(spark, sf_dir), "event_id % 3", grouped).drop("batch"))


@query("SELECT event_id, event_type, cents, t AS ts, p AS part FROM E")
def log_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent to an offset log by a stream of three micro-batches, and read back as a bounded topic."""
    from .plans.storage import shared_folder
    from .sources.log import OffsetLog

    spark.dataSource.register(OffsetLog)
    codec = JsonCodec()
    rows = R.select(events(spark, sf_dir), "event_id", "event_type", "cents")
    schema = rows.select("event_id", "event_type", "cents").schema
    raw, folder = codec.encode(rows).drop("offset"), f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    feed = bounded.Feed(raw, F.pmod(F.xxhash64("value"), F.lit(PIECES)))
    for i in range(PIECES):
        feed.push(i)
        feed.frame.writeStream.format("offset_log").option("folder", folder).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    back = JsonCodec(schema).decode(spark.read.format("offset_log").option("folder", folder).load())
    return back.select("event_id", "event_type", "cents", F.col("__timestamp").alias("ts"), F.col("__partition").alias("part"))


class _Visits:
    """Numbers a user's visits: a new one begins after an hour without an event."""

    def __init__(self) -> None:
        self.visit, self.last = 0, None

    def row(self, r) -> list[tuple]:
        if self.last is None or r["t"] - self.last > HOUR:
            self.visit += 1
        self.last = r["t"]
        return [(r["user_id"], r["event_id"], self.visit)]


@query(f"""SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS visit FROM
 (SELECT user_id, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM E )""")
def table_function_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom operator with state, in SQL, by partition and in order."""
    table_functions.register(spark, "visits", _Visits, "user_id long, event_id long, visit long")
    rows = events(spark, sf_dir).select("user_id", "event_id", F.col("__timestamp").alias("t"))
    return spark.sql("SELECT * FROM visits(TABLE({rows}) PARTITION BY user_id ORDER BY (t, event_id))", rows=rows)


@query("SELECT CASE WHEN cents > 5000 THEN 'large' ELSE 'click' END AS branch, event_id, cents FROM E WHERE cents > 5000 OR event_type = 'click'")
def table_function_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event to the first branch that accepts it, in SQL."""
    branches = {"large": lambda r: r["cents"] > 5000, "click": lambda r: r["event_type"] == "click"}
    rows = events(spark, sf_dir).select("event_id", "cents", "event_type")
    table_functions.register(spark, "routed", table_functions.splitter(branches, rows.select("event_id", "cents").schema))
    return spark.sql("SELECT * FROM routed(TABLE({rows}))", rows=rows)


@query(f"""WITH A AS (SELECT DISTINCT user_id, t - {HOUR} AS s FROM E UNION SELECT DISTINCT user_id, t + 1 AS s FROM E )
 SELECT A.user_id AS key, s AS window_start, s + {HOUR} AS window_end, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM A JOIN E ON A.user_id = E.user_id AND E.t BETWEEN s AND s + {HOUR} GROUP BY 1, 2""")
def live_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-aligned windows that late records change."""

    def windows(df: DataFrame) -> DataFrame:
        return keyed.sliding(df.select(F.col("user_id").alias("key"), F.col("__timestamp").alias("ts"), "cents"), HOUR, Aggregation("cents", "n", COUNT), Aggregation("cents", "total", SUM), retention=3650 * DAY)

    return keyed.settled_rows(_in_pieces(events(spark, sf_dir), "event_id % 3", windows).drop("batch"))


_PATH = T.StructType([T.StructField("n", T.LongType()), T.StructField("path", T.StringType())])


@query("SELECT user_id, count(*) AS n, string_agg(event_type, '>' ORDER BY t, event_id) AS path FROM E GROUP BY user_id")
def fold_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over each user's events in order of time, merged over tasks."""
    rows = events(spark, sf_dir).select("user_id", F.col("__timestamp").alias("t"), "event_id", "event_type")
    return folds.fold(rows, "user_id", ["t", "event_id"], (0, None), lambda s, r: (s[0] + 1, r["event_type"] if s[1] is None else f"{s[1]}>{r['event_type']}"), _PATH, lambda a, b: (a[0] + b[0], f"{a[1]}>{b[1]}"))
