"""Registered queries against their SQL, and the style of the native ones."""

import compare
import pytest

import __spark_entry__ as entry_point
from feedloom.llm import queries

NATIVE = ("op4_", "op5_", "op8_", "op10_")


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(entry_point.queries())
    assert set(queries.SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    found = compare.spark_rows(queries.QUERIES[name](spark, sf))
    assert compare.difference(found, compare.sql_rows(compare.duck(sf), queries.SQL[name])) is None


@pytest.mark.parametrize("name", sorted(x for x in queries.QUERIES if x.startswith(NATIVE)))
def test_native_queries_run_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if x in plan]
