"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest
from oracle_check import canonical, compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).columns


def test_the_comparison_sees_a_difference(spark, con):
    assert canonical(["b", "a"], [(1, 2.0)]) == (["a", "b"], [(2, 1)])
    wrong = SQL["external_sources"].replace("count(*) AS events", "count(*)+1 AS events")
    assert "rows differ" in compare(spark, con, "x", entry.queries()["external_sources"], wrong, SF)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.explanation for r in rows)
