"""Reports from CSV files with the sources' own headers, end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillgrid import operators as op
from tillgrid import plans
from tillgrid import sources as src


def load(spark, tmp_path, dataset, lines, **kw):
    path = tmp_path / f"{dataset.name}.csv"
    header = ",".join(f'"{f.header}"' for f in dataset.fields if not f.optional)
    path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return src.read_table(spark, str(path), dataset, **kw)


def tuples(df):
    return [tuple(r) for r in df.collect()]


ACCOUNT_LINES = [
    "C1,Savings,2020-01-05,Yes,Active,4,Yes,No,No,Adum,P1,100.10,50.05,50.05,5.00,1000.00,7",
    "C2,Savings,2021-03-01,No,Dormant,3,No,No,,Adum,P1,10.00,,10.00,5.00,2000.00,9",
    "C1,Current,05/06/2021,Yes,Active,3,Yes,,Yes,Ho,P2,,,,2.50,500.00,1",
    "C3,,2021-07-07,NA,Active,3,No,Yes,No,,P3,1.00,1.00,0.00,9.00,-20.00,4",
    "C4,Current,2021-08-08,Yes,Closed,3,Yes,Yes,Yes,Ho,P1,7.00,2.00,5.00,,80.00,",
]


@pytest.fixture
def accounts(spark, tmp_path):
    return plans.prepare_accounts(load(spark, tmp_path, src.ACCOUNTS, ACCOUNT_LINES, date_format="yyyy-MM-dd"))


def test_accounts(accounts):
    report = plans.accounts_report(accounts)
    assert tuples(report["year_options"]) == [(2020,), (2021,)]
    assert sorted(tuples(report["type_options"]), key=repr) == [("Current",), ("Savings",), (None,)]
    # The row with an unreadable date is outside the filter, the one without a type inside.
    assert tuples(report["by_year"]) == [(2020, 1), (2021, 3)]
    assert tuples(report["by_type"]) == [("Savings", 2), ("Current", 1)]
    assert tuples(report["active_share"].select("active_account", "n")) == [("Yes", 2), ("No", 1)]
    alerts = {r["flag"]: (r["No"], r["Yes"]) for r in report["alerts"].collect()}
    assert alerts == {"mobile_banking": (2, 2), "sms_alerts": (2, 2), "email_alerts": (2, 1)}
    # Unfiltered panels.
    assert tuples(report["branch_flows"]) == [("Adum", 110.1, 50.05), ("Ho", 7.0, 2.0)]
    assert tuples(report["product_flows"]) == [("P1", 117.1, 52.05), ("P2", 0.0, 0.0), ("P3", 1.0, 1.0)]
    assert tuples(report["product_net_flow"]) == [("P1", 65.05), ("P2", 0.0), ("P3", 0.0)]
    assert tuples(report["product_interest"]) == [("P1", 10.0), ("P3", 9.0), ("P2", 2.5)]
    assert tuples(report["top_customers"]) == [("C3", 9.0), ("C1", 7.5), ("C2", 5.0), ("C4", 0.0)]
    assert tuples(report["age_by_status"]) == [(3.0, "Active", 1), (3.0, "Closed", 1), (3.0, "Dormant", 1), (4.0, "Active", 1)]
    assert tuples(report["activity_by_type"]) == [("Savings", 8.0), ("Current", None)]
    assert tuples(report["balance_by_year"])[0] == (2020, 1000.0)
    assert report["balance_growth"].orderBy("year_opened").collect()[1]["growth_pct"] == pytest.approx(-31.333333)
    assert sum(r.n for r in report["balance_histogram"].collect()) == 4
    assert report["balance_density"].count() == 200
    assert report["balance_interest_points"].count() == 4
    assert sum(r.n for r in report["balance_interest_grid"].collect()) == 4


def test_account_filter(accounts):
    report = plans.accounts_report(accounts, years=[2021], types=["Savings", None])
    assert tuples(report["by_year"]) == [(2021, 2)]
    assert tuples(report["product_interest"])[0] == ("P1", 10.0)
    assert plans.accounts_report(accounts, years=[2021], types=["Savings"])["by_year"].first()["n"] == 1


def test_customers(spark, tmp_path):
    lines = [
        "1,2020-05-01,0,Tech,North,Male",
        "1,2020-06-01,12,Tech,North,Female",
        "2,2021-05-01,13,Trade,North,Other",
        "3,2021-06-01,241,None,South,",
        "4,bad,60,Trade,South,Male",
    ]
    frame = plans.prepare_customers(load(spark, tmp_path, src.CUSTOMERS, lines))
    report = plans.customers_report(frame)
    assert "income_fit" not in report
    growth = report["growth"].first()
    assert (growth["n_customers"], growth["years_active"], growth["avg_annual_growth"]) == (4, 2, 2.0)
    assert tuples(report["sector_penetration"]) == [("Tech", 2, 50.0, None), ("Trade", 2, 50.0, None)]
    assert tuples(report["regions"]) == [("North", 3, True), ("South", 2, False)]
    assert tuples(report["strongest_region"]) == [("North", 3)]
    assert [r["n"] for r in report["segments"].orderBy("ordinal").collect()] == [1, 1, 1, 0, 0]
    # Two years tie for the peak: the earlier one is named.
    assert tuples(report["peak_year"]) == [(2020, 2)]
    assert report["gender_balance"].first()["gap"] == 0.2
    insights = {r["metric"]: (r["label"], r["value"]) for r in report["insights"].collect()}
    assert insights["first_year_share"] == ("New (<1yr)", 20.0)
    assert insights["lowest_sector_share"] == ("Tech", 50.0)
    assert insights["peak_year_change"] == ("2020", None)
    with_income = plans.customers_report(frame.withColumn("income", F.col("tenure_years") * 3 + 1))
    fit = with_income["income_fit"].first()
    assert (fit["slope"], fit["intercept"]) == pytest.approx((3.0, 1.0))


def test_employees(spark, tmp_path):
    lines = [
        "E1,2001-01-01,Adum,IT,Clerk,Female,30,0,BSc",
        "E2,2002-01-01,Ho,IT,Boss,Male,50,9999,BSc",
        ",2003-02-01,Ho,HR,Clerk,Male,40,10000,MSc",
        "E2,2001-07-01,Ho,IT,Clerk,,NA,30000,MSc",
        "E5,2001-08-01,Ho,,Clerk,Male,20,-5,BSc",
    ]
    frame = plans.prepare_employees(load(spark, tmp_path, src.EMPLOYEES, lines), dt.date(2002, 1, 1))
    assert "attrition_risk" in frame.columns
    report = plans.employees_report(frame, branch="Ho", department="IT", education_levels=["BSc", "MSc"])
    assert tuples(report["branch_options"]) == [(0, "All"), (1, "Adum"), (1, "Ho")]
    assert tuples(report["year_options"])[1:] == [(1, "2001"), (1, "2002"), (1, "2003")]
    kpis = report["kpis"].first()
    assert (kpis["n_employees"], kpis["mean_age"]) == (1, 50.0)
    assert kpis["mean_tenure"] == pytest.approx(184 / 365 / 2)
    assert tuples(report["hiring"]) == [(2001, 1), (2002, 1)]
    assert tuples(report["gender"]) == [("Male", 1, 100.0)]
    bands = {(r.band_label, r.education_level): r.n for r in report["education_by_income"].collect()}
    assert bands == {
        ("0-10000", "BSc"): 2,
        ("0-10000", "MSc"): 0,
        ("10000-20000", "BSc"): 0,
        ("10000-20000", "MSc"): 1,
        ("30000-40000", "BSc"): 0,
        ("30000-40000", "MSc"): 1,
    }
    everyone = plans.employees_report(frame)
    assert tuples(everyone["hiring"]) == [(2001, 3), (2002, 1), (2003, 0)]
    assert tuples(plans.employees_report(frame, joining_year=2003)["age_by_position"]) == [("Clerk", 40.0)]
    assert min(r.tenure_years for r in frame.collect()) < 0


def test_market(spark, tmp_path):
    files = {
        "ages": ("Age Groups,Total\n15-24,30\n25-34,50\n25-34,50\n35-44,\n", src.INDUSTRY_AGES),
        "industries": ("Industry,Total population\nTrade,75\nFarming,225\nMining,225\n", src.INDUSTRY_POPULATION),
        "regions": ("Region,Population\nB,2\nA,1\n", None),
        "wide": ('Region,Farming,Trade\nA,"1,200",1\nA, 7 ,x\nB,5,\n', None),
    }
    sources = {}
    for name, (text, dataset) in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
        sources[name] = (str(tmp_path / f"{name}.csv"), dataset)
    tables = src.read_bundle(spark, sources)
    report = plans.market_report(
        tables["ages"],
        tables["industries"],
        src.normalize_headers(tables["regions"]),
        src.normalize_headers(tables["wide"], {"Farming": "Farming", "Trade": "Trade"}),
        "Trade",
    )
    assert sorted(tuples(report["age_means"].select("age_group", "n", "mean")), key=repr) == [
        ("15-24", 1, 30.0),
        ("25-34", 2, 50.0),
        ("35-44", 0, None),
    ]
    assert [round(r.percentage, 4) if r.percentage else None for r in report["age_percentage"].collect()] == [
        23.0769,
        38.4615,
        38.4615,
        None,
    ]
    assert tuples(report["selected_industry"]) == [("Trade", 75.0)]
    assert [r.industry for r in report["industry_shares"].collect()] == ["Farming", "Mining", "Trade"]
    assert tuples(report["insights"]) == [("largest_age_group", "25-34", 50.0), ("largest_industry", "Farming", 225.0)]
    assert tuples(report["region_preview"]) == [("A", "1"), ("B", "2")]
    cells = {(r.region, r.industry): (r.n, r["mean"]) for r in report["industry_by_region"].collect()}
    assert cells == {("A", "Farming"): (1, 7.0), ("A", "Trade"): (1, 1.0), ("B", "Farming"): (1, 5.0)}
    path = plans.export_ages(tables["ages"], str(tmp_path / "out"))
    assert src.read_texts(spark, path).columns == ["age_group", "total", "percentage"]


def test_market_without_its_files_has_fewer_panels(spark, tmp_path):
    gone = str(tmp_path / "gone.csv")
    names = {"ages": src.INDUSTRY_AGES, "industries": src.INDUSTRY_POPULATION, "regions": None, "wide": None}
    t = src.read_bundle(spark, {k: (gone, d) for k, d in names.items()}, on_error="empty")
    report = plans.market_report(t["ages"], t["industries"], t["regions"], t["wide"], "Trade")
    assert "industry_by_region" not in report and "region_preview" not in report
    assert all(report[name].count() == 0 for name in report)


BRANCH_LINES = [
    "Adum,Ashanti,90,10,20,1,2,3,4,High,100,10,5,4.5,6.7,-1.6,Yes,Full",
    "Bantama,Ashanti,80,11,25,2,1,5,,High,50,0,5,4.0,6.8,-1.7,No,None",
    "Nowhere,Volta,85,9,NA,3,4,1,2,Low,0,5,2,3.5,6.9,-1.8,,Full",
    "Ho,Volta,,8,10,4,3,2,1,,60000,6,2,3.0,,0.1,Yes,Partial",
]


def test_branches(spark, tmp_path):
    report = plans.branches_report(load(spark, tmp_path, src.BRANCHES, BRANCH_LINES))
    assert [r.branch_name for r in report["top_profitability"].collect()] == ["Adum", "Nowhere", "Bantama", "Ho"]
    assert tuples(report["categories"]) == [("High", 2), ("Low", 1)]
    assert tuples(report["capacity"]) == [
        ("Ho", 10000.0, 2 / 60000),
        ("Adum", 10.0, 0.05),
        ("Nowhere", 0.0, None),
        ("Bantama", None, 0.1),
    ]
    assert tuples(report["regions"]) == [("Ashanti", 2), ("Volta", 2)]
    assert report["load_satisfaction_points"].count() == 3
    assert report["map_centre"].first()["lat"] == pytest.approx(6.8)
    markers = tuples(report["map_points"])
    assert [m[3] for m in markers] == ["blue", "gray", "gray"]
    assert markers[0][2] == "Adum (Ashanti)<br>Perf: High<br>Profit Index: 90.0"
    assert tuples(report["accessibility"]) == [("Full", 2), ("Partial", 1)]
    box = {r.disability_access: (r.n, r["median"]) for r in report["access_customers"].collect()}
    assert box == {"Full": (2, 50.0), "Partial": (1, 60000.0)}
    assert [(r.branch_name, r.coverage_pct) for r in report["coverage"].collect()] == [
        ("Ho", 97.28),
        ("Adum", 0.23),
        ("Bantama", 0.12),
        ("Nowhere", None),
    ]
    pair = {(r.col_a, r.col_b): r["corr"] for r in report["correlations"].collect()}
    # Deposits are unknown in one row and the index in another: two rows are left for the pair.
    assert pair[("deposits_ghs_million", "profitability_index")] == pytest.approx(-1.0)


AGENT_LINES = [
    "A1,North,Gold,10,100.00,5.00,1.5,4,8-5,Yes,2,Cash,5.1,0.1,3",
    "A2,North,Gold,20,100.00,,2.5,6,8-5,Yes,0,Cash,5.2,0.2,4",
    "A3,South,Silver,5,50.05,1.00,1.0,2,24h,No,7,Loans,5.9,0.9,9",
    "A4,South,,1,,1.00,,1,,No,1,Loans,,0.9,1",
]


def test_agents(spark, tmp_path):
    path = tmp_path / "agents.csv"
    header = ",".join(f.header for f in src.AGENTS.fields)
    path.write_text("\n".join([header, *AGENT_LINES]) + "\n")
    frame = src.read_table(spark, str(path), src.AGENTS)
    report = plans.agents_report(frame, training_values=["No", "Yes"])
    assert [r.agent_id for r in report["top_volume"].collect()] == ["A1", "A2", "A3", "A4"]
    assert tuples(report["tier_means"])[0] == ("Gold", 15.0, 100.0, 5.0)
    assert tuples(report["regions"]) == [("North", 2), ("South", 2)]
    assert [(r.region, r.monthly_transactions) for r in report["region_totals"].collect()] == [("North", 30.0), ("South", 6.0)]
    assert tuples(report["region_mean_transactions"]) == [("North", 15.0), ("South", 3.0)]
    assert report["map_points"].count() == 3
    assert sorted(r.n for r in report["map_clusters"].collect()) == [1, 2]
    base = {r.performance_tier: (r.n, r["mean"]) for r in report["base_by_tier"].collect()}
    assert base == {"Gold": (2, 5.0), "Silver": (1, 2.0)}
    assert tuples(report["base_by_training"]) == [("No", 1.5), ("Yes", 5.0)]
    assert tuples(report["region_training"]) == [("North", None, 100.0), ("South", 50.05, None)]
    assert tuples(report["top_engagement"]) == [("A1", 7.0), ("A4", 2.0), ("A3", 1.0), ("A2", None)]
    assert report["hours_base_points"].count() == 3
    assert {r.working_hours for r in report["hours_base_grid"].collect()} == {"8-5", "24h"}
    assert tuples(report["engagement_summary"]) == [(7.0, "Gold", 100.0), (1.0, "Silver", 50.05)]
    assert {r.performance_tier: r["median"] for r in report["compliance_by_tier"].collect()} == {"Gold": 3.5, "Silver": 9.0}
    assert report["engagement_volume_points"].count() == 2
    for name in ("rate_volume_points", "rate_volume_grid", "engagement_volume_grid", "map_centre"):
        assert report[name].count() >= 1


@pytest.mark.parametrize("data", [[], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)], [(None, 1.0)]])
def test_a_line_through_too_little_is_unknown(spark, data):
    df = spark.createDataFrame(data, "x double, y double")
    assert op.linreg(df, "x", "y").first()["slope"] is None
    assert all(r.y_hat is None for r in op.linreg_band(df, "x", "y", grid=3).collect())


def test_empty_tables_give_empty_or_zero_results(spark):
    df = spark.createDataFrame([], "k string, v double, w double")
    assert op.value_shares(df, "k").count() == 0
    assert [r.n for r in op.histogram(df, "v", 3).collect()] == [0, 0, 0]
    assert [r.density for r in op.kde(df, "v", 3).collect()] == [None] * 3
    assert op.box_stats(df, "k", "v").count() == 0
    assert {r["corr"] for r in op.corr_matrix(df, ["v", "w"]).collect()} == {None}
    assert op.imbalance_flag(df, "k").first()["imbalanced"] is None
    assert op.share_of_total(df, "v").count() == 0
