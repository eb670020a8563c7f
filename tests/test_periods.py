"""Shared scans, binned density, staged sketches, incremental staging and quarantine."""

import math
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bindings import standins as st
from bindings.operators import order_year
from bindings.panels import build_accounts
from bindings.registry import QUERIES
from bindings.tables import table
from tillgrid import operators as op
from tillgrid import plans
from tillgrid import sources as src
from tillgrid.operators import statistics
from tillgrid.plans import shared

REPORTS = {
    "accounts": lambda spark, sf, **o: plans.accounts_report(st.accounts(spark, sf), alert_values=["No", "Pending", "Yes"], **o),
    "customers": lambda spark, sf, **o: plans.customers_report(st.customers(spark, sf), **o),
    "employees": lambda spark, sf, **o: plans.employees_report(st.employees(spark, sf), branch="Brand#7", **o),
    "agents": lambda spark, sf, **o: plans.agents_report(st.agents(spark, sf), training_values=["No", "Yes"], **o),
    "branches": lambda spark, sf, **o: plans.branches_report(st.branches(spark, sf), **o),
}
SERVED = {
    "accounts": "year_options type_options active_share by_type by_year alerts branch_flows product_flows age_by_status "
    "product_net_flow product_interest activity_by_type balance_by_year balance_growth",
    "customers": "sector_penetration regions strongest_region gender gender_balance acquisition peak_year age_bins",
    "employees": "branch_options department_options year_options hiring departments tenure_by_department age_by_position gender",
    "agents": "tier_means regions region_totals region_mean_transactions map_centre base_by_tier base_by_training region_training",
    "branches": "categories regions map_centre accessibility",
}


def told(df):
    return sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_shared_panels_are_the_plain_ones(spark, sf_dir, plan, monkeypatch, name):
    passes = []
    plain_settle = shared.settle
    monkeypatch.setattr(shared, "settle", lambda df: passes.append(plan(df)) or plain_settle(df))
    plain, served = REPORTS[name](spark, sf_dir), REPORTS[name](spark, sf_dir, shared=True)
    assert list(plain) == list(served)
    for panel in SERVED[name].split():
        df = served[panel]
        assert "FileScan" not in plan(df) and "Scan parquet" not in plan(df)
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in plain[panel].schema]
        assert told(df) == told(plain[panel])
    # One pass for each scope; the other stand-ins read more tables than one.
    assert len(passes) == (2 if name in ("accounts", "employees") else 1)
    if name in ("accounts", "employees"):
        assert all(text.count("FileScan") == 1 and "Expand" in text for text in passes)


def test_a_shared_scan_takes_no_late_panels(spark):
    scan = shared.SharedScan(spark.createDataFrame([("a", 1), (None, 2)], "k string, v long"))
    counts, total = scan.ask(op.value_counts, "k", keep_null_key=True), scan.ask(op.kpis, {"n": F.count("v")})
    assert told(counts()) == [["a", 1], [None, 1]] and told(total()) == [[2]]
    with pytest.raises(ValueError, match="before one is shown"):
        scan.ask(op.value_counts, "v")
    empty = shared.SharedScan(spark.createDataFrame([], "k string, v long"))
    counts, total = empty.ask(op.value_counts, "k"), empty.ask(op.sum_by, "k", {"s": "v"})
    assert counts().count() == total().count() == 0


def test_amounts_that_fit_are_not_tested(spark, sf_dir, plan):
    for panel in ("balance_histogram", "balance_density", "product_flows", "balance_chart"):
        assert "raise_error" not in plan(QUERIES[f"accounts_{panel}"](spark, sf_dir))
    dataset = src.Dataset("t", (src.Field("Total", "total", "decimal(18,2)"),))
    three = spark.sql("select cast(1.239 as decimal(10,3)) as Total")
    with pytest.raises(Exception, match="total is not"):
        src.conform(three, dataset).collect()
    with pytest.raises(Exception):
        src.conform(spark.sql("select cast(1e17 as decimal(20,2)) as Total"), dataset).collect()
    assert src.conform(spark.sql("select cast(1.230 as decimal(10,3)) as Total"), dataset).first()[0] == Decimal("1.23")
    assert build_accounts(spark, sf_dir)["by_type"].count() > 0


@pytest.mark.parametrize("error", [1e-2, 1e-4])
def test_binned_density_keeps_its_bound(spark, error):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1),) for _ in range(900)] + [(rng.expovariate(0.3),) for _ in range(300)] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "v double")
    exact, binned = (dict((r.point, r.density) for r in op.kde(df, "v", 80, **o).collect()) for o in ({}, {"method": "binned", "error": error}))
    values = [v for (v,) in rows if v is not None and not math.isnan(v)]
    mean = sum(values) / len(values)
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) * len(values) ** -0.2
    bound = error / (math.sqrt(2 * math.pi) * h)
    assert max(abs(exact[p] - binned[p]) for p in exact) <= bound and exact.keys() == binned.keys()
    assert max(abs(exact[p] - binned[p]) for p in exact) > 0
    few = [[(1.0,)], [(2.0,), (2.0,)], []]
    for rows in few:
        got = [op.kde(spark.createDataFrame(rows, "v double"), "v", 5, method=m).collect() for m in ("exact", "binned")]
        assert got[0] == got[1]


@pytest.mark.parametrize("gather", [20, 10_000])
def test_quantiles_from_sketches(spark, tmp_path, plan, monkeypatch, gather):
    rng = random.Random(2)
    rows = [(y, g, rng.choice([rng.gauss(0, 9), float(rng.randrange(3))])) for y in (1, 2, 3) for g in "ab" for _ in range(3_000)]
    rows += [(1, "one", 5.0), (2, "two", 1.0), (3, "two", 2.0), (2, None, 1.0), (2, "a", None), (2, "a", float("nan"))]
    df = src.stage(spark.createDataFrame(rows, "y int, g string, v double"), str(tmp_path / "rows"), "y")
    sketches = src.stage(op.quantile_sketches(df, "y", "g", "v", size=400), str(tmp_path / "sketches"), "y")
    of, own = (op.filter_in(x, {"y": [1, 2]}) for x in (sketches, df))
    scans = []
    plain_settle = statistics.settle
    monkeypatch.setattr(statistics, "settle", lambda d: scans.append(plan(d).count(f"{tmp_path.name}/rows")) or plain_settle(d))
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: (r.n, repr(r.q)) for r in op.quantiles_from_sketches(of, own, "g", "v", probs, size=400, gather=gather).collect()}
    if gather == 10_000:
        assert sum(map(bool, scans)) == 1  # one scan of the rows
    assert got == {r.g: (r.n, repr(r.q)) for r in op.quantiles_by(own, "g", "v", probs).collect()}
    near = {r.g: r.q for r in op.quantiles_from_sketches(of, own, "g", "v", probs, exact=False, size=400).collect()}
    for g, q in near.items():
        values = sorted(v for y, k, v in rows if k == g and y < 3 and v is not None and not math.isnan(v))
        for p, x in zip(probs, q):
            low, high = sum(v < x for v in values), sum(v <= x for v in values)
            assert low - 1 <= (p + 3 * op.kll_rank_error(400)) * len(values) and high + 1 >= (p - 3 * op.kll_rank_error(400)) * len(values)


def test_a_sketch_that_misses_costs_scans_not_the_answer(spark):
    df = spark.range(4_000).select(F.lit("a").alias("g"), F.sqrt("id").alias("v"), F.lit(1).alias("y"))
    wrong = op.quantile_sketches(df.withColumn("v", F.col("v") + 100), "y", "g", "v")
    got = op.quantiles_from_sketches(wrong, df, "g", "v", gather=50).first()
    assert repr(got.q) == repr(op.quantiles_by(df, "g", "v").first().q)


def test_distinct_ids_of_any_years(spark, sf_dir):
    orders = order_year(table(spark, sf_dir, "orders"))
    sketches = op.distinct_sketches(orders, "order_year", "o_custkey").cache()
    early, late = F.col("order_year") < 1995, F.col("order_year") >= 1995
    ids = {"early": set(), "late": set()}
    for r in orders.select("o_custkey", early.alias("early")).collect():
        ids["early" if r.early else "late"].add(r.o_custkey)
    bound = 3 * op.distinct_error() * 3_000
    assert abs(op.distinct_estimate(sketches).first().n - len(ids["early"] | ids["late"])) <= bound
    new = op.new_estimate(sketches.where(late), sketches.where(early)).first().n
    assert abs(new - len(ids["late"] - ids["early"])) <= bound
    bitmaps = op.id_bitmaps(orders, "order_year", "o_custkey")
    assert op.distinct_of_bitmaps(bitmaps.where(late)).first().n == len(ids["late"])
    assert op.distinct_of_bitmaps(bitmaps.limit(0)).first().n == 0
    wide = spark.createDataFrame([(1, 5), (1, -70_000), (2, 5), (2, 10**12), (2, None)], "y int, i long")
    assert told(op.new_by_period(op.id_bitmaps(wide, "y", "i"), "y")) == [[1, 2, 2, 2], [2, 2, 1, 3]]


def parts_of(folder):
    return {
        os.path.join(base, f): os.stat(os.path.join(base, f)).st_mtime_ns
        for base, _, files in os.walk(folder)
        for f in files
        if f.endswith(".parquet")
    }


def test_only_changed_partitions_are_written(spark, tmp_path):
    landing, staged = tmp_path / "landing", str(tmp_path / "staged")
    landing.mkdir()

    def land(name, lines):
        (landing / name).write_text("year,amount\n" + "".join(f"{y},{a}\n" for y, a in lines))

    def read(paths):
        return spark.read.schema("year int, amount long").option("header", True).csv(paths)

    def stage():
        return src.stage_changes(spark, str(landing), read, staged, "year").select("amount", "year")

    def full():
        return sorted(map(tuple, read([str(landing)]).select("amount", "year").collect()), key=repr)

    land("a.csv", [(1999, 1), (2000, 2)])
    land("b.csv", [(2000, 3), (2001, 4), ("", 5)])
    land("c.csv", [(2002, 6)])
    assert sorted(map(tuple, stage().collect()), key=repr) == full()
    before = parts_of(staged)
    assert sorted(map(tuple, stage().collect()), key=repr) == full() and parts_of(staged) == before
    land("a.csv", [(1999, 1), (2000, 20), (2003, 7)])
    assert sorted(map(tuple, stage().collect()), key=repr) == full()
    after = parts_of(staged)
    kept = {p for p in before if after.get(p) == before[p]}
    assert {p.split("year=")[1].split("/")[0] for p in kept} == {"2001", "2002", "__HIVE_DEFAULT_PARTITION__"}
    # A file goes, and with it the only rows of a year; one comes.
    (landing / "c.csv").unlink()
    land("d.csv", [("", 8), (2001, 9)])
    assert sorted(map(tuple, stage().collect()), key=repr) == full()
    assert not [p for p in parts_of(staged) if "year=2002" in p]


def test_quarantine(spark, tmp_path):
    lines = ["C1,10.50,2020-01-02", "C2,ten,2020-01-02", "C3,1.239,never", "C4,n/a,", "C5,1", "C6,1,2020-01-02,more", '"C,7",2.5,2020-03-04']
    (tmp_path / "in.csv").write_text("Customer ID,Total,Day\n" + "\n".join(lines) + "\n")
    fields = (src.Field("Customer ID", "customer_id"), src.Field("Total", "total", "decimal(18,2)"), src.Field("Day", "day", "timestamp_ntz"))
    read = src.read_quarantined(spark, str(tmp_path), src.Dataset("t", fields), "yyyy-MM-dd")
    assert sorted(r.customer_id for r in read.good.collect()) == ["C,7", "C1", "C4"]
    assert read.counts.get == {"rows": 7, "rejected": 4, "total": 2, "day": 1}
    rejects = read.rejects.collect()
    assert sorted((r.line, r.field, r.reason) for r in rejects if r.field) == [
        ("C2,ten,2020-01-02", "total", "not decimal(18,2)"),
        ("C3,1.239,never", "day", "not timestamp_ntz"),
        ("C3,1.239,never", "total", "not decimal(18,2)"),
    ]
    assert sorted(r.line for r in rejects if not r.field) == ["C5,1", "C6,1,2020-01-02,more"]
    assert {r.reason for r in rejects if not r.field} == {"not 3 columns"}
    assert all(r.file.endswith("in.csv") for r in rejects)
