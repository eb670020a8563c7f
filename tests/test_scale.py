"""Plans and bounds: what reaches the scan, how often tables are read, and answers that do not depend on size."""

import random

import pytest
from pyspark.sql import functions as F

from bindings import operators as bound
from bindings import standins as st
from tillgrid import operators as op
from tillgrid import plans
from tillgrid import sources as src
from tillgrid.operators import statistics

PROBS = (0.0, 0.25, 0.3, 0.5, 0.75, 0.999, 1.0)


@pytest.fixture(scope="module")
def groups(spark):
    rng, inf = random.Random(1), float("inf")
    rows = [("ends", x) for x in (-inf, -inf, 5.0, 6.0, 7.0, inf)]
    rows += [("even", rng.random()) for _ in range(200)]
    rows += [("heavy", rng.random() ** -20) for _ in range(1500)]
    rows += [("tied", float(rng.randrange(2))) for _ in range(300)] + [("one", 1.0)] * 50 + [("single", 2.5)]
    return spark.createDataFrame(rows, "g string, v double").cache()


@pytest.mark.parametrize("gather", [5, 40])
def test_quantiles_do_not_depend_on_the_plan(groups, gather):
    gathered = {r.g: repr(r.q) for r in op.quantiles_by(groups, "g", "v", PROBS).collect()}
    bracketed = {r.g: repr(r.q) for r in op.quantiles_by(groups, "g", "v", PROBS, gather=gather).collect()}
    assert gathered == bracketed


def test_quantiles_take_few_passes_on_a_heavy_tail(spark, monkeypatch):
    settled = []
    plain = statistics.settle
    monkeypatch.setattr(statistics, "settle", lambda df: settled.append(1) or plain(df))
    rows = spark.range(20_000).select(
        F.lit("a").alias("g"), F.pow((F.xxhash64("id") % 1_000_003 + 1_000_004) / 2_000_008.0, F.lit(-20.0)).alias("v")
    )
    far = op.quantiles_by(rows, "g", "v", gather=100).first()
    assert (len(settled) - 1) / 2 <= 4  # sizes, then two tables for each pass
    near = op.quantiles_by(rows, "g", "v", gather=100_000).first()
    assert repr(far.q) == repr(near.q)


def test_csv_files_with_other_column_order_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Customer ID,Region,Gender\nC1,North,Male\n")
    (tmp_path / "b.csv").write_text("Customer ID,Gender,Region\nC2,Male,North\n")
    with pytest.raises(Exception, match="header"):
        src.read_table(spark, str(tmp_path)).collect()
    (tmp_path / "b.csv").write_text("Customer ID,Region,Gender\nC2,South,Male\n")
    assert sorted(r.Region for r in src.read_table(spark, str(tmp_path)).collect()) == ["North", "South"]


@pytest.mark.parametrize("amount, good", [(1.24, True), (1.239, False), (2.005, False), (None, True), (float("nan"), True)])
def test_parquet_amounts_are_never_rounded(spark, amount, good):
    dataset = src.Dataset("t", (src.Field("Total", "total", "decimal(18,2)"),))
    df = src.conform(spark.createDataFrame([(amount,)], "Total double"), dataset)
    if good:
        assert str(df.first().total) in ("1.24", "None")
    else:
        with pytest.raises(Exception, match="is not decimal"):
            df.collect()


def test_filters_reach_the_scan(spark, sf_dir, tmp_path, plan):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    pushed = plan(bound.filter_in_list(spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate" in pushed
    hired = plan(plans.employees_report(st.employees(spark, sf_dir), branch="Brand#7")["hiring"])
    assert "EqualTo(p_brand,Brand#7)" in hired
    path = str(tmp_path / "accounts")
    st.accounts(spark, sf_dir).drop("year_opened").write.parquet(path)
    accounts = plans.prepare_accounts(src.read_table(spark, path, src.ACCOUNTS, fmt="parquet", tokens=()))
    chosen = plan(plans.accounts.chosen_accounts(accounts, [1996, 1997, 1999], ["1-URGENT", "2-HIGH"]))
    assert "In(account_type, [1-URGENT,2-HIGH])" in chosen and "GreaterThanOrEqual(opening_date" in chosen
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_filter_years_is_the_year(spark):
    dates = "'1995-12-31 23:59:59'", "'1996-01-01'", "'1997-12-31 23:59:59'", "'1998-01-01'", "'1999-06-01'", "null"
    df = spark.sql("select * from values " + ",".join(f"(timestamp_ntz {d})" if d != "null" else "(null)" for d in dates) + " t(d)")
    for years in ([1996, 1997], [1999, None], [], [1997, 1999]):
        want = df.where(op.filters.is_in(F.year("d"), years))
        assert op.filter_years(df, "d", years).collect() == want.collect()


def test_correlations_and_insights_read_once(spark, sf_dir, plan):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = plan(op.corr_matrix(lines, ["l_quantity", "l_tax", "l_discount"]))
    assert text.count("FileScan") == 1 and "Generate" not in text[text.index("FileScan") :]
    customers = st.customers(spark, sf_dir)
    assert plan(plans.customers.customer_insights(customers)).count("FileScan") == plan(customers).count("FileScan")


def test_bootstrap_draws_from_blocks(spark, sf_dir, plan):
    text = plan(bound.mean_ci_bootstrap(spark, sf_dir))
    for part in text.split("Generate")[1:]:
        assert "HashAggregate" in part[: part.index("FileScan")]
    again = [bound.mean_ci_bootstrap(spark, sf_dir).collect() for _ in range(2)]
    assert sorted(again[0]) == sorted(again[1])


def test_insights_of_nothing(spark, sf_dir):
    found = plans.customers.customer_insights(st.customers(spark, sf_dir).limit(0)).collect()
    assert [(r.metric, r.value) for r in found] == [("first_year_share", None)]


def test_region_header_is_found_or_missed_aloud(spark, sf_dir):
    m = st.market(spark, sf_dir)
    spelled = m["region_industry"].withColumnRenamed("region", "Region")
    args = (m["ages"], m["industries"], m["regions"])
    assert plans.market_report(*args, spelled, "Brand#5")["industry_by_region"].columns[0] == "Region"
    with pytest.raises(ValueError, match="no column region"):
        plans.market_report(*args, spelled.drop("Region"), "Brand#5")


def test_a_district_listed_twice_is_refused(spark, sf_dir):
    twice = [("Accra", 1), ("Accra", 2)]
    with pytest.raises(ValueError, match="twice"):
        plans.branches.district_coverage(st.branches(spark, sf_dir), population=twice)


def test_outliers_are_those_counted(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("v", F.pow("l_extendedprice", F.lit(3.0)))
    stats = {r.l_returnflag: r.n_outliers for r in op.box_stats(lines, "l_returnflag", "v").collect()}
    listed = {r.l_returnflag: r["count"] for r in op.box_outliers(lines, "l_returnflag", "v").groupBy("l_returnflag").count().collect()}
    assert {k: n for k, n in stats.items() if n} == listed
