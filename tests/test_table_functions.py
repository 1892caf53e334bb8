import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.errors import LakeError
from strandlake.operators.table_functions import register, splitter
from strandlake.streaming import bounded
from strandlake.streaming.metrics import QueryMetrics, measured


class Running:
    """Sums so far, and at the end how many rows there were."""

    def __init__(self):
        self.n = self.total = 0

    def row(self, r):
        self.n += 1
        self.total += r["v"] or 0
        return [(r["k"], r["i"], self.total)]

    def end(self):
        return [(None, -self.n, self.total)]


class Silent:
    def row(self, r):
        return None


def table(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, rng.choice([1, -2, None])) for i in range(300)]
    spark.createDataFrame(rows, "k string, i long, v long").repartition(5).createOrReplaceTempView("tf")
    return rows


def test_operator_by_partition_in_order(spark):
    rows = table(spark)
    register(spark, "running", Running, "k string, i long, total long")
    got = {(r["k"], r["i"]): r["total"] for r in spark.sql("SELECT * FROM running(TABLE(SELECT * FROM tf) PARTITION BY k ORDER BY i)").collect() if r["i"] >= 0}
    want, sums = {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + (v or 0)
        want[k, i] = sums[k]
    assert got == want
    ends = sorted(r["i"] for r in spark.sql("SELECT * FROM running(TABLE(SELECT * FROM tf) PARTITION BY k ORDER BY i)").collect() if r["i"] < 0 and r["k"] is None)
    assert ends == sorted(-sum(k == x for k, _, _ in rows) for x in {k for k, _, _ in rows})
    register(spark, "silent", Silent, "x int")
    assert spark.sql("SELECT * FROM silent(TABLE(SELECT * FROM tf))").collect() == []


def test_split(spark):
    rows = table(spark)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.LongType())])
    branches = {"hot": lambda r: r["k"] == "hot", "early": lambda r: r["i"] < 100}
    register(spark, "split_first", splitter(branches, schema))
    register(spark, "split_all", splitter(branches, schema, first_only=False))
    first = sorted((r["branch"], r["i"]) for r in spark.sql("SELECT * FROM split_first(TABLE(SELECT * FROM tf))").collect())
    every = sorted((r["branch"], r["i"]) for r in spark.sql("SELECT * FROM split_all(TABLE(SELECT * FROM tf))").collect())
    assert first == sorted(("hot" if k == "hot" else "early", i) for k, i, _ in rows if k == "hot" or i < 100)
    assert every == sorted([("hot", i) for k, i, _ in rows if k == "hot"] + [("early", i) for k, i, _ in rows if i < 100])
    with pytest.raises(LakeError):
        splitter({}, T.StructType([T.StructField("branch", T.LongType())]))
    with pytest.raises(LakeError):
        register(spark, "no name", Silent, "x int")


def test_metrics_of_a_query(spark, tmp_path):
    metrics = QueryMetrics().attach(spark)
    try:
        feed = bounded.Feed(spark.range(100), F.col("id") % 2)
        kept = measured(measured(feed.frame, "in", largest=F.sum("id")).filter("id % 5 = 0"), "out")
        for i in range(2):
            feed.push(i)
            query = kept.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
            totals = metrics.of(query, ended=30)
        assert (totals.batches, totals.input, totals.output, totals.failures) == (2, 100, 20, 0) and totals.nanos > 0
        assert totals.observed["in"] == {"rows": 100, "largest": 4950}
        broken = feed.frame.select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
        query = broken.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken"):
            query.awaitTermination()
        assert metrics.of(query, ended=30).failures == 1 and metrics.of("unknown").batches == 0
    finally:
        spark.streams.removeListener(metrics)
