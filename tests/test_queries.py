"""Every registered query against its SQL, and the driver contract."""

import compare
import pytest

import __spark_entry__ as entry_point
from feedloom.workload import catalog

# No query pairs all rows, and none runs Python per row or batch.
BANNED = [
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
]
QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in BANNED if word in plan]
    found = compare.spark_rows(df)
    if name in SQL:
        assert compare.difference(found, compare.sql_rows(con, SQL[name])) is None


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
