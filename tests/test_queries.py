"""Every registered query that has SQL, against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandlake import queries as core
from tests.conftest import DATA

SF = DATA / "sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(v[i] for i in order) for v in values], key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, str(SF))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(core.SQL[name])
    want = rows(want.columns, want.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9) if isinstance(x, float) else x == y, (a, b)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
