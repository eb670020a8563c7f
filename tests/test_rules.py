"""One small table per rule on nulls, ties, rounding, bins and dates, with the rows it must give."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillgrid import functions as fn
from tillgrid import operators as op
from tillgrid import plans
from tillgrid import sources as src


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_null_keys_are_left_out_of_groups(spark, rows):
    df = frame(spark, "k string, v double", ("a", 1.0), (None, 5.0), ("a", 2.0))
    assert rows(op.sum_by(df, "k", {"s": "v"})) == [("a", 3.0)]
    assert rows(op.sum_by(df, "k", {"s": "v"}, keep_null_key=True)) == [("a", 3.0), (None, 5.0)]


def test_shares_divide_by_known_rows(spark, rows):
    df = frame(spark, "k string", ("a",), ("a",), ("b",), (None,))
    got = {r["k"]: r["share"] for r in op.value_shares(df, "k").collect()}
    assert got == pytest.approx({"a": 200 / 3, "b": 100 / 3})


def test_sum_of_an_all_null_group_is_zero(spark, rows):
    df = frame(spark, "k string, v double, w bigint, m decimal(18,2)", ("a", None, None, None))
    assert rows(op.sum_by(df, "k", {"v": "v", "w": "w", "m": "m"})) == [("a", 0.0, 0, 0.0)]


def test_nan_becomes_null(spark):
    df = frame(spark, "v double", (1.0,), (float("nan"),), (None,), (3.0,))
    assert df.agg(F.avg(fn.nan_to_null(F.col("v")))).first()[0] == 2.0


@pytest.mark.parametrize("sort", [op.order_asc, op.order_desc])
def test_nulls_sort_last_both_ways(spark, sort):
    df = frame(spark, "k string, v double", ("a", None), ("b", 1.0), ("c", 2.0))
    assert sort(df, "v", "k").collect()[-1]["k"] == "a"


def test_ties_go_to_the_smallest_key(spark):
    df = frame(spark, "k string, v double", ("c", 5.0), ("a", 5.0), ("b", 5.0), ("d", 1.0), ("e", None))
    assert [r["k"] for r in op.top_k(df, "v", 2, "k").collect()] == ["a", "b"]
    assert tuple(op.arg_max(df, "k", "v").first()) == ("a", 5.0)
    assert [r["k"] for r in op.value_counts(df, "k").collect()] == ["a", "b", "c", "d", "e"]


def test_list_with_none_matches_null(spark, rows):
    df = frame(spark, "k string", ("a",), ("b",), (None,))
    assert rows(op.filter_in(df, {"k": ["a", None]})) == [("a",), (None,)]
    assert rows(op.filter_in(df, {"k": ["a"]})) == [("a",)]
    assert rows(op.filter_in(df, {"k": [None]})) == [(None,)]
    assert rows(op.filter_in(df, {"k": []})) == []


def test_optional_filter_skips_all(spark, rows):
    df = frame(spark, "k string, y int", ("a", 1), ("b", 2))
    assert rows(op.filter_eq_optional(df, {"k": "All", "y": 2})) == [("b", 2)]
    assert op.filter_eq_optional(df, {"k": "All", "y": "All"}).count() == 2


def test_lenient_dates_give_null_and_strict_dates_fail(spark):
    df = frame(spark, "t string", ("2024-01-31",), ("31/01/2024",), ("2024-02-30",), (None,))
    lenient = df.select(fn.parse_ts(F.col("t"), "yyyy-MM-dd")).collect()
    assert [r[0] for r in lenient] == [dt.datetime(2024, 1, 31), None, None, None]
    assert [r[0] for r in df.select(fn.parse_ts(F.col("t"))).collect()][:2] == [dt.datetime(2024, 1, 31), None]
    assert [r[0] for r in df.select(fn.parse_ts(F.col("t"), "dd/MM/yyyy")).collect()] == [
        None,
        dt.datetime(2024, 1, 31),
        None,
        None,
    ]
    odd = frame(spark, "t string", ("2024-1-31",), ("2024-01-31 10:00",), (" 2024-01-31",), ("2024-01-31\n",))
    assert [r[0] for r in odd.select(fn.parse_ts(F.col("t"), "yyyy-MM-dd")).collect()] == [None] * 4
    for fmt in ("yyyy-MM-dd", "dd/MM/yyyy", None):
        with pytest.raises(Exception, match="not a timestamp"):
            df.select(fn.parse_ts(F.col("t"), fmt, "strict")).collect()
    with pytest.raises(ValueError):
        fn.parse_ts(F.col("t"), mode="maybe")


def test_numbers_from_text(spark):
    df = frame(spark, "t string", ("1,200",), (" 7 ",), ("x",), ("1e3",), (None,))
    assert [r[0] for r in df.select(fn.to_number(F.col("t"))).collect()] == [None, 7.0, None, 1000.0, None]
    with pytest.raises(Exception, match="not a number"):
        df.select(fn.to_number(F.col("t"), "strict")).collect()


def test_division_by_zero_is_null(spark):
    df = frame(spark, "a double, b double", (1.0, 0.0), (0.0, 0.0), (1.0, 4.0))
    assert [r[0] for r in df.select(fn.ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 0.25]
    score = fn.engagement_score(F.col("a"), F.col("a"), F.col("b"))
    assert [r[0] for r in df.select(score).collect()] == [None, None, 0.5]


def test_rounding_is_half_even_on_the_binary_value(spark):
    values = (2.665, 0.125, 2.675, -0.125, 1.005, 0.285, 1.115, 1e9 + 0.125)
    df = frame(spark, "v double", *[(v,) for v in values])
    assert [r[0] for r in df.select(fn.round_even(F.col("v"), 2)).collect()] == [np.round(v, 2) for v in values]


def test_missing_value_tokens(spark, rows):
    df = frame(spark, "k string, n int", ("None", 1), ("NA", 2), ("", 3), ("n/a", 4), ("none", 5), (" NA", 6))
    assert rows(src.normalize_nulls(df).where("k is not null")) == [(" NA", 6), ("none", 5)]


def test_segments_are_open_below_and_closed_above(spark):
    months = (0.0, 1.0, 12.0, 13.0, 36.0, 60.0, 120.0, 240.0, 241.0, None)
    df = frame(spark, "m double", *[(m,) for m in months])
    edges = plans.customers.TENURE_EDGES

    def ordinals(**kw):
        years = fn.tenure_years_from_months(F.col("m"))
        return [r[0] for r in df.select(fn.cut_ordinal(years, edges, **kw)).collect()]

    assert ordinals() == [None, 0, 0, 1, 1, 2, 3, 4, None, None]
    assert ordinals(include_lowest=True)[0] == 0
    assert ordinals(open_top=True)[8] == 4
    assert ordinals(right=False) == [0, 0, 1, 1, 2, 3, 4, None, None, None]


def test_labels_of_segments(spark):
    df = frame(spark, "i int", (0,), (2,), (None,))
    assert [r[0] for r in df.select(fn.cut_label(F.col("i"), ["x", "y", "z"])).collect()] == ["x", "z", None]


def test_width_bands_keep_the_maximum_unless_told_otherwise(spark, rows):
    data = [(v, "A") for v in (0.0, 9999.0, 10000.0, 30000.0, -1.0, None)] + [(5.0, None)]
    df = frame(spark, "v double, e string", *data)
    kept = rows(op.band_crosstab(df, "v", "e", 10_000, ["A", "B"]).select("band_label", "e", "n"))
    assert kept == [
        ("0-10000", "A", 2),
        ("0-10000", "B", 0),
        ("10000-20000", "A", 1),
        ("10000-20000", "B", 0),
        ("30000-40000", "A", 1),
        ("30000-40000", "B", 0),
    ]
    dropped = rows(op.band_crosstab(df, "v", "e", 10_000, ["A"], drop_max_on_edge=True).select("band", "n"))
    assert dropped == [(0, 2), (1, 1)]


def test_declared_labels_keep_zero_counts(spark, rows):
    df = frame(spark, "i int", (0,), (0,), (2,), (None,))
    assert rows(op.dense_counts(df, F.col("i"), ["x", "y", "z"])) == [(0, "x", 2), (1, "y", 0), (2, "z", 1)]


def test_pivot_leaves_gaps_and_matrix_fills_them(spark, rows):
    df = frame(spark, "r string, t string, v double", ("n", "Yes", 2.0), ("n", "Yes", 4.0), ("s", "No", 1.0), (None, "No", 9.0))
    assert rows(op.mean_pivot(df, "r", "t", "v", ["No", "Yes"])) == [("n", None, 3.0), ("s", 1.0, None)]
    flags = frame(spark, "a string, b string, c string", ("Yes", "On", None), ("No", None, None))
    for values in (["No", "On", "Yes"], None):
        got = op.flag_matrix(flags, ["a", "b", "c"], values).select("flag", "No", "On", "Yes")
        assert rows(got) == [("a", 1, 0, 1), ("b", 0, 1, 0), ("c", 0, 0, 0)]


def test_flag_matrix_refuses_too_many_values(spark):
    df = frame(spark, "a string", *[(str(i),) for i in range(30)])
    spark.conf.set("spark.sql.pivotMaxValues", "20")
    try:
        with pytest.raises(ValueError, match="too many"):
            op.flag_matrix(df, ["a"])
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_tenure_counts_whole_days_to_the_given_day(spark):
    data = ["2001-12-31 00:00:00", "2001-12-31 12:00:00", "2002-01-01 12:00:00", "2001-01-01 00:00:00"]
    df = frame(spark, "t string", *[(t,) for t in data]).select(F.col("t").cast("timestamp_ntz").alias("t"))
    days = df.select(fn.tenure_years_as_of(F.col("t"), dt.date(2002, 1, 1)) * 365).collect()
    assert [round(r[0]) for r in days] == [1, 0, -1, 365]


def test_rows_and_customers_are_counted_apart(spark):
    data = [("1", "2020-01-01", 12.0, "A", "N", "Male"), ("1", "2021-01-01", 24.0, "A", "N", "Male")]
    schema = "customer_id string, customer_since string, tenure_months double, employment_sector string, region string, gender string"
    raw = frame(spark, schema, *data)
    report = plans.customers_report(plans.prepare_customers(src.conform(raw, src.CUSTOMERS)))
    assert tuple(report["kpis"].first()) == (2, 1, 1.5)


def test_coverage_join_is_many_to_one_and_keeps_unmatched(spark, rows):
    schema = "branch_name string, active_customers double"
    df = frame(spark, schema, ("Adum", 43026.0), ("Bantama", 4302.6), ("Elsewhere", 1.0))
    got = rows(plans.branches.district_coverage(df).select("branch_name", "population", "coverage_pct"))
    assert got == [("Adum", 43026, 100.0), ("Bantama", 43026, 10.0), ("Elsewhere", None, None)]
    dim = frame(spark, "k string", ("a",), ("a",), ("b",))
    assert rows(op.duplicate_keys(dim, "k")) == [("a", 2)]
    districts = frame(spark, "district string, n bigint", *plans.DISTRICT_POPULATION)
    assert op.duplicate_keys(districts, "district").count() == 0


def test_grouping_by_score_leaves_unknown_scores_out(spark, rows):
    schema = (
        "agent_id string, region string, performance_tier string, monthly_transactions double, "
        "monthly_volume_ghs decimal(18,2), monthly_commission_ghs decimal(18,2), commission_rate_pct double, "
        "active_customer_base double, working_hours string, training_completed string, months_active double, "
        "services_offered string, gps_latitude double, gps_longitude double"
    )

    def agent(i, tier, months, volume):
        return (i, "N", tier, 8.0, Decimal(volume), Decimal(1), 1.0, 2.0, "8", "Yes", months, "x", 1.0, 2.0)

    df = frame(
        spark, schema, agent("1", "G", 3.0, "10.00"), agent("2", "G", 0.0, "99.00"), agent("3", None, 3.0, "5.00"),
        agent("4", "G", 3.0, "2.50"),
    )
    assert rows(plans.agents_report(df)["engagement_summary"]) == [(10 / 3, "G", 12.5)]
    assert rows(plans.agents_report(df, score_places=1)["engagement_summary"]) == [(3.3, "G", 12.5)]


def test_null_matches_no_map_entry(spark):
    df = frame(spark, "k string", ("a",), ("z",), (None,))
    assert [r[0] for r in df.select(op.map_lookup(F.col("k"), {"a": 1})).collect()] == [1, None, None]


def test_url_rewrite_passes_other_links_through(spark):
    df = frame(spark, "u string", ("https://x/d/Ab_9-z/edit?usp=1",), ("https://x/file.csv",), (None,))
    assert [r[0] for r in df.select(fn.sheet_csv_url(F.col("u"))).collect()] == [
        "https://docs.google.com/spreadsheets/d/Ab_9-z/export?format=csv",
        "https://x/file.csv",
        None,
    ]


def test_lookup_of_an_absent_key_is_empty(spark, rows):
    df = frame(spark, "k string, v bigint", ("a", 3), ("a", 1))
    assert rows(op.lookup_one(df, "k", "a", "v")) == [("a", 1)]
    assert rows(op.lookup_one(df, "k", "zz", "v")) == []


def test_imbalance_counts_unknown_rows_in_the_whole(spark):
    data = [("Male",)] * 6 + [("Female",)] * 5 + [(None,)] * 9
    row = op.imbalance_flag(frame(spark, "g string", *data), "g").first()
    assert (row["n_left"], row["n_right"], row["n_rows"], row["gap"], row["imbalanced"]) == (6, 5, 20, 0.05, False)


def test_flags(spark, rows):
    df = frame(spark, "v string, p double", ("Yes", 9.0), ("No", 10.0), (None, None))
    got = df.select(fn.flag_value(F.col("v")), fn.flag_below(F.col("p"), 10)).collect()
    assert [tuple(r) for r in got] == [("blue", "Untapped"), ("gray", None), ("gray", None)]
    peaks = op.flag_max(frame(spark, "k string, n int", ("a", 2), ("b", 2), ("c", None)), "n")
    assert rows(peaks) == [("a", 2, True), ("b", 2, True), ("c", None, False)]


def test_describe_row_shows_missing_parts(spark):
    df = frame(spark, "a string, b double", ("x", None))
    assert df.select(fn.describe_row(["[", F.col("a"), "] ", F.col("b")])).first()[0] == "[x] nan"


def test_ensure_column_adds_only_when_absent(spark):
    df = frame(spark, "a string", ("x",))
    assert op.ensure_column(df, "a", "y").first()["a"] == "x"
    assert op.ensure_column(df, "b", 1, "int").first()["b"] == 1


def test_exact_money_does_not_drift(spark):
    df = spark.range(100_000).select(F.lit("k").alias("k"), F.lit(0.1).alias("v"))
    assert op.sum_by(df, "k", {"s": "v"}, money=True).first()["s"] == 10_000.0


def test_exact_money_goes_past_a_long(spark):
    df = spark.range(200).select(F.lit("k").alias("k"), F.lit(9e15).alias("v"))
    assert op.sum_by(df, "k", {"s": "v"}, money=True).first()["s"] == 200 * 9e15
