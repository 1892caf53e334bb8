import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import mixing, queries
from strandlake.llm.mixing import mix, take
from tests.conftest import DATA


def filled(sizes, weights, share, most):
    """Water filling by bisection of the level."""
    total = share * sum(sizes)
    low, high = 0.0, 10 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(mid * w, most * s) for s, w in zip(sizes, weights)) < total:
            low = mid
        else:
            high = mid
    return [min(high * w, most * s) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = [None, *[f"s{i:02}" for i in range(6)]]
    sizes = {n: rng.choice([0, 5, 50, 1000]) for n in names}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
    order = sorted(names, key=lambda n: (n is None, n or ""))
    want = filled([sizes[n] for n in order], [(3, 1, 2)[i % 3] for i in range(7)], 1.5, 2.0)
    assert [got[n] for n in order] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_query_whole_table(spark):
    got = queries.op6_source_mixing(spark, str(DATA / "sf0.01")).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    size = {i: len((d["text"] or "").encode().split()) for i, d in docs.items()}
    sources = sorted({d["source"] for d in docs.values()})
    whole = [sum(size[i] for i, d in docs.items() if d["source"] == s) for s in sources]
    target = dict(zip(sources, filled(whole, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2.0)))
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == whole[sources.index(s)] and r["target"] == pytest.approx(target[s], rel=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for s in sources:
        taken = sum(r["taken"] for r in got if docs[r["doc_id"]]["source"] == s)
        # Off the target by half the next document of the hash order at most.
        assert abs(taken - target[s]) <= max(size[i] for i, d in docs.items() if d["source"] == s) / 2
    again = queries.op6_source_mixing(spark, str(DATA / "sf0.01")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_taken_rows_are_those_of_the_sorted_hash_order(spark):
    """What thresholds find without sorting, found by sorting."""
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).select("doc_id", "source", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), 4).alias("h"))
    told = {r["doc_id"]: r for r in queries.op6_source_mixing(spark, str(DATA / "sf0.01")).collect()}
    by = {}
    for r in docs.collect():
        by.setdefault(r["source"], []).append((r["h"], r["doc_id"]))
    for rows in by.values():
        one = told[rows[0][1]]
        whole = int(one["target"] // one["source_size"]) if one["source_size"] else 0
        left, more = one["target"] - whole * one["source_size"], set()
        for _, i in sorted(rows):
            n = told[i]["size"]
            if n > left:
                more |= {i} if n < 2 * left else set()
                break
            left -= n
            more.add(i)
        assert {i: told[i]["taken"] for _, i in rows} == {i: told[i]["size"] * (whole + (i in more)) for _, i in rows}


def test_budgets_are_nested(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    small, large = ({r["doc_id"] for r in mix(docs, share=s).filter("copies > 0").collect()} for s in (0.2, 0.5))
    assert small < large


def test_odd_rows(make, spark):
    docs = make((1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "x"), (None, "one two", None), (4, "w " * 5000, "y"))
    rows = mix(docs, weights=(1.0,), share=1.0, most=1.0).collect()
    assert len(rows) == 6 and sum(r["size"] for r in rows) == 3 + 3 + 2 + 5000
    assert all(r["taken"] == r["size"] for r in rows)  # the whole is the target
    assert mix(docs.limit(0)).collect() == []
    assert mix(make((1, None)), share=1.0).head()["taken"] == 0
    doubled = take(docs, share=2.0, most=2.0)
    assert doubled.columns == docs.columns and doubled.count() == 12
    assert take(docs, share=0.0).filter("text IS NOT NULL AND text != ''").count() == 0
    assert [r["n"] for r in doubled.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("doc_id").collect()] == [2, 4, 2, 2, 2]


def test_no_python_in_the_plan(spark):
    plan = queries.op6_source_mixing(spark, str(DATA / "sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
