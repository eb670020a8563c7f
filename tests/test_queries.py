"""Every registered query against its SQL in DuckDB, and the register itself."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from bindings.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir, con):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_ten_rows(spark):
    assert entry.entry(spark).count() == 10


def test_comparison_sees_a_difference(spark, con):
    df = spark.sql("select 1L as a, 'x' as b")
    assert differences(df, con, "select 1::bigint as a, 'x' as b") == []
    assert differences(df, con, "select 2::bigint as a, 'x' as b")
    assert differences(df, con, "select 1::int as a, 'x' as b")
    assert differences(df, con, "select 1::bigint as a, 'x' as b union all select 1, 'x'")
    assert differences(df, con, "select 1::bigint as a, 'x' as c")


def test_every_panel_is_a_query(spark, sf_dir):
    from bindings import panels as bound

    for report in ("accounts", "customers", "employees", "market", "branches", "agents"):
        for panel in getattr(bound, f"build_{report}")(spark, sf_dir):
            assert f"{report}_{panel}" in QUERIES
