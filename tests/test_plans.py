"""What the optimizer makes of the operators."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from bindings.registry import QUERIES
from bindings.tables import table
from tillgrid import operators as op
from tillgrid import plans

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pairing_in_any_plan(name, spark, sf_dir, plan):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert operator not in text


@pytest.mark.parametrize("name", ["top_customers_by_revenue", "accounts_top_customers", "branches_top_profitability", "peak_year"])
def test_top_rows_need_no_full_sort(name, spark, sf_dir, plan):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_list_filter_reaches_the_scan(spark, sf_dir, plan):
    text = plan(op.filter_in(table(spark, sf_dir, "orders"), {"o_orderstatus": ["F", "O"]}).select("o_custkey"))
    assert "PushedFilters: [In(o_orderstatus, [F,O])]" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in text


def test_year_filter_prunes_staged_partitions(spark, sf_dir, plan):
    text = plan(QUERIES["staged_year_filter"](spark, sf_dir))
    assert "PartitionFilters: [order_year#" in text and "IN (1996,1999)" in text


def test_panels_read_only_their_columns(spark, sf_dir, plan):
    text = plan(QUERIES["accounts_product_interest"](spark, sf_dir))
    assert "o_custkey" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_literal_dimension_is_broadcast(spark, sf_dir, plan):
    assert "BroadcastHashJoin" in plan(QUERIES["branches_coverage"](spark, sf_dir))


def test_unbounded_dimension_is_left_to_the_planner(spark, sf_dir, plan):
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(op.join_dim(lines, parts, "l_partkey", "p_partkey"))
        assert "BroadcastHashJoin" in plan(op.join_dim(lines, parts, "l_partkey", "p_partkey", bounded=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_beyond_the_limit_are_not_broadcast(spark):
    groups = op.settle(spark.range(50).withColumnRenamed("id", "k"))
    assert op.broadcast_if_small(groups, 50) is not groups
    assert op.broadcast_if_small(groups, 49) is groups


def test_share_reads_its_table_once(spark, sf_dir):
    df = op.value_shares(table(spark, sf_dir, "orders"), "o_orderpriority")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_aggregates_combine_before_the_shuffle(spark, sf_dir, plan):
    text = plan(op.sum_by(table(spark, sf_dir, "lineitem"), "l_suppkey", {"s": "l_extendedprice"}))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_correlations_are_combined_before_the_shuffle(spark, sf_dir, plan):
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_discount")
    gaps = lines.withColumn("l_tax", F.nullif(F.col("l_tax"), F.lit(0.0)))
    for frame in (lines, gaps):
        text = plan(op.corr_matrix(frame, lines.columns))
        assert text.count("FileScan") == 1 and "partial_covar_pop" in text


def test_unasked_panels_are_not_planned(spark, sf_dir):
    calls = []
    panels = plans.panels.Panels({"a": lambda: calls.append("a"), "b": lambda: calls.append("b")})
    panels["b"]
    assert calls == ["b"] and list(panels) == ["a", "b"] and len(panels) == 2


def test_windows_see_aggregates_only(spark, sf_dir, plan):
    text = plan(QUERIES["pct_change_yearly"](spark, sf_dir))
    window = text.index("Window [")
    assert "HashAggregate" in text[window:]
