"""Each query that has SQL against DuckDB on the smallest tables, if DuckDB is there."""

from __future__ import annotations

import pytest

from readloom import plans  # noqa: F401  # registers the queries
from readloom.plans import registry as Q

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "part lineitem events documents customer orders supplier nation benchmark".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def clean(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, oracle, name):
    got = Q.QUERIES[name](spark, SF)
    want = oracle.sql(Q.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    ours = sorted((tuple(clean(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert ours == sorted((tuple(clean(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_others_give_rows(spark):
    for name in sorted(set(Q.QUERIES) - set(Q.ORACLES)):
        assert Q.QUERIES[name](spark, SF).count() > 0
