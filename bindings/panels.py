"""Every report panel on the stand-in tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindings import standins as st
from bindings.operators import shared_folder
from bindings.registry import SQL, query
from tillgrid import plans
from tillgrid.sources import INDUSTRY_AGES, INDUSTRY_POPULATION, export_csv, read_bundle, read_table, read_texts


def comparable(df: DataFrame, places: int) -> DataFrame:
    """Whole numbers as bigint, decimals as double, doubles rounded."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, places)
        out.append(c.alias(f.name))
    return df.select(*out)


def panels(report: str, build: Callable, tables: str, sqls: dict[str, str], places: int = 6) -> None:
    for name, sql in sqls.items():

        def run(spark, sf, panel=name):
            return comparable(build(spark, sf)[panel], places)

        query(f"with {tables}\n{sql}", f"{report}_{name}")(run)


def money(col: str) -> str:
    return f"coalesce(sum({col}), 0)::double"


def shares(frame: str, col: str) -> str:
    return (
        f"select {col}, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as share "
        f"from {frame} where {col} is not null group by 1"
    )


def counts(frame: str, *cols: str) -> str:
    known = " and ".join(f"{c} is not null" for c in cols)
    keys = ", ".join(cols)
    return f"select {keys}, count(*) as n from {frame} where {known} group by {keys}"


def options(frame: str, col: str) -> str:
    return (
        "select 0::bigint as option_group, 'All' as option union all "
        f"select distinct 1::bigint, {col}::varchar from {frame} where {col} is not null"
    )


def box(frame: str, group: str, value: str) -> str:
    return f"""select {group}, count(*) as n, round(any_value(q1), 6) as q1, round(any_value(q2), 6) as median,
  round(any_value(q3), 6) as q3,
  round(least(min(v) filter (v >= q1 - 1.5 * (q3 - q1)), any_value(q1)), 6) as whisker_low,
  round(greatest(max(v) filter (v <= q3 + 1.5 * (q3 - q1)), any_value(q3)), 6) as whisker_high,
  count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_outliers
from (select {group}, {value} as v from {frame} where {value} is not null) r
join (select {group}, quantile_cont({value}, 0.25) as q1, quantile_cont({value}, 0.5) as q2,
  quantile_cont({value}, 0.75) as q3 from {frame} where {group} is not null and {value} is not null group by 1) q
  using ({group}) group by {group}"""


def outliers(frame: str, group: str, value: str) -> str:
    return f"""select {group}, round({value}, 6) as value from {frame} join (
  select {group}, quantile_cont({value}, 0.25) as q1, quantile_cont({value}, 0.75) as q3 from {frame}
  where {group} is not null and {value} is not null group by 1) q using ({group})
where {value} < q1 - 1.5 * (q3 - q1) or {value} > q3 + 1.5 * (q3 - q1)"""


def mean_ci(frame: str, keys: str, value: str) -> str:
    known = " and ".join(f"{k} is not null" for k in keys.split(", "))
    half = f"1.96 * stddev_samp({value}) / sqrt(count({value}))"
    return f"""select {keys}, count({value}) as n, round(avg({value}), 6) as mean,
  round(avg({value}) - {half}, 6) as ci_low, round(avg({value}) + {half}, 6) as ci_high
from {frame} where {known} group by {keys}"""


def points(frame: str, x: str, y: str, *more: str) -> str:
    cols = ", ".join([f"round({x}::double, 6) as {x}", f"round({y}::double, 6) as {y}", *more])
    return f"select {cols} from {frame} where {x} is not null and {y} is not null"


def grid(frame: str, x: str, y: str, xw: float, yw: float, *hue: str) -> str:
    cols = ", ".join([*hue, f"floor({x} / {xw}::double)::bigint as x_cell", f"floor({y} / {yw}::double)::bigint as y_cell"])
    return f"select {cols}, count(*) as n from {frame} where {x} is not null and {y} is not null group by all"


# --- accounts


def build_accounts(spark, sf):
    return plans.accounts_report(st.accounts(spark, sf), alert_values=["No", "Pending", "Yes"])


panels(
    "accounts",
    build_accounts,
    st.ACCOUNTS_SQL,
    {
        "year_options": "select distinct year_opened from accounts where year_opened is not null",
        "type_options": "select distinct account_type from accounts",
        "active_share": shares("chosen", "active_account"),
        "by_type": counts("chosen", "account_type"),
        "by_year": counts("chosen", "year_opened"),
        "alerts": " union all ".join(
            f"select '{c}' as flag, "
            + ", ".join(f"count(*) filter ({c} = '{v}') as \"{v}\"" for v in ("No", "Pending", "Yes"))
            + " from chosen"
            for c in ("mobile_banking", "sms_alerts", "email_alerts")
        ),
        "branch_flows": f"select branch, {money('total_deposits')} as deposits, "
        f"{money('total_withdrawals')} as withdrawals from accounts group by 1",
        "product_flows": f"select product_code, {money('total_deposits')} as deposits, "
        f"{money('total_withdrawals')} as withdrawals from accounts where product_code is not null group by 1",
        "age_by_status": counts("chosen", "account_age_years", "status"),
        "product_net_flow": f"select product_code, {money('net_flow')} as net_flow from accounts "
        "where product_code is not null group by 1",
        "product_interest": f"select product_code, {money('interest_earned')} as interest from accounts "
        "where product_code is not null group by 1",
        "top_customers": f"select customer_id, {money('interest_earned')} as interest from accounts group by 1 "
        "order by interest desc, customer_id limit 10",
        "activity_by_type": "select account_type, round(avg(activity_score), 6) as mean_activity from chosen "
        "where account_type is not null group by 1",
        "balance_histogram": """, v as (select current_balance::double as v from chosen),
s as (select min(v) as lo, max(v) as hi from v),
g as (select v, lo, hi, least(floor((v - lo) * 30.0::double / (hi - lo))::bigint, 29) as b from v, s),
x as (select case when v < lo + b * ((hi - lo) / 30) then b - 1
    when b < 29 and v >= lo + (b + 1) * ((hi - lo) / 30) then b + 1 else b end as bin from g),
c as (select bin, count(*) as n from x group by 1)
select r.range::bigint as bin, round(lo + r.range * ((hi - lo) / 30), 6) as lo,
  round(lo + (r.range + 1) * ((hi - lo) / 30), 6) as hi, coalesce(n, 0)::bigint as n
from range(30) r cross join s left join c on c.bin = r.range""",
        "balance_chart": """, v as (select current_balance::double as v from chosen),
s as (select count(*) as n, min(v) as lo, max(v) as hi, (max(v) - min(v)) / 199 as step, (max(v) - min(v)) / 30 as w,
  stddev_samp(v) * pow(count(*), -0.2) as h from v),
g as (select v, lo, hi, w, least(floor((v - lo) * 30.0::double / (hi - lo))::bigint, 29) as b from v, s),
x as (select case when v < lo + b * w then b - 1 when b < 29 and v >= lo + (b + 1) * w then b + 1 else b end as bin from g),
c as (select bin, count(*) as n from x group by 1)
select 'bin' as kind, r.range::bigint as at, round(lo + r.range * w, 6) as lo, round(lo + (r.range + 1) * w, 6) as hi,
  coalesce(c.n, 0)::double as value from range(30) r cross join s left join c on c.bin = r.range
union all select 'curve', r.range::bigint, round(any_value(lo + r.range * step), 6), round(any_value(lo + r.range * step), 6),
  round(sum(exp(-0.5 * pow((lo + r.range * step - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())) * any_value(n * w), 6)
from v, s, range(200) r group by 2""",
        "balance_by_year": "select year_opened, round(avg(current_balance), 6) as mean_balance from chosen group by 1",
        "balance_growth": """select year_opened, round(m, 6) as mean_balance,
  round((m / lag(m) over (order by year_opened) - 1) * 100, 6) as growth_pct
from (select year_opened, avg(current_balance) as m from chosen group by 1)""",
        "balance_interest_points": points("accounts", "current_balance", "interest_earned"),
        "balance_interest_grid": grid("accounts", "current_balance", "interest_earned", 10000, 10000),
    },
)


@query(f"""with {st.ACCOUNTS_SQL}, v as (select current_balance::double as v from chosen),
s as (select count(*) as n, min(v) as lo, (max(v) - min(v)) / 199 as step,
  stddev_samp(v) * pow(count(*), -0.2) as h from v)
select r.range::bigint as point, round(any_value(lo + r.range * step), 6) as x,
  round(sum(exp(-0.5 * pow((lo + r.range * step - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 12) as density
from v, s, range(200) r group by 1""")
def accounts_balance_density(spark, sf):
    density = build_accounts(spark, sf)["balance_density"]
    return density.select("point", F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


def build_filtered_accounts(spark, sf):
    return plans.accounts_report(st.accounts(spark, sf), years=[1996, 1999], types=["1-URGENT", None])


panels(
    "accounts_filtered",
    build_filtered_accounts,
    st.ACCOUNTS_SQL,
    {
        "by_year": counts(
            "(select * from chosen where year_opened in (1996, 1999) and (account_type = '1-URGENT' or account_type is null))",
            "year_opened",
        ),
    },
)


# --- customers


def build_customers(spark, sf):
    return plans.customers_report(st.customers(spark, sf))


_SECTORS = "select employment_sector, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as share from customers where employment_sector is not null group by 1"
_LABELS = " union all ".join(
    f"select {i}::bigint as ordinal, '{label}' as label"
    for i, label in enumerate(
        ("New (<1yr)", "Growth (1-3yr)", "Established (3-5yr)", "Loyal (5-10yr)", "VIP (>10yr)")
    )
)

panels(
    "customers",
    build_customers,
    st.CUSTOMERS_SQL,
    {
        "growth": """select n_customers, start_year, end_year, end_year - start_year + 1 as years_active,
  round(n_customers / (end_year - start_year + 1), 6) as avg_annual_growth
from (select count(distinct customer_id) as n_customers, year(min(customer_since)) as start_year,
  year(max(customer_since)) as end_year from customers)""",
        "kpis": "select count(*) as n_rows, count(distinct customer_id) as n_customers, "
        "round(avg(tenure_years), 6) as mean_tenure from customers",
        "sector_penetration": f"select employment_sector, n, round(share, 6) as share, "
        f"case when share < 10 then 'Untapped' end as flag from ({_SECTORS})",
        "regions": "select region, count(*) as n, count(*) = max(count(*)) over () as is_max from customers group by 1",
        "strongest_region": "select region as label, count(*) as value from customers group by 1 "
        "order by value desc, label limit 1",
        "gender": shares("customers", "gender"),
        "gender_balance": """select n_left, n_right, n_rows, round(abs(n_left - n_right) / n_rows, 6) as gap,
  abs(n_left - n_right) / n_rows > 0.1 as imbalanced
from (select count(*) filter (gender = 'Male') as n_left, count(*) filter (gender = 'Female') as n_right,
  count(*) as n_rows from customers)""",
        "segments": f"""select ordinal, label, (select count(*) from customers where segment = ordinal) as n,
  case when ordinal = 0 then 'Churn Risk' end as flag from ({_LABELS})""",
        "acquisition": counts("customers", "year_joined"),
        "peak_year": "select year_joined as label, count(*) as value from customers where year_joined is not null "
        "group by 1 order by value desc, label limit 1",
        "insights": f""", sectors as ({_SECTORS}),
rs as (select region, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as share from customers group by 1),
ys as (select year_joined, n, (n / lag(n) over (order by year_joined) - 1) * 100 as change from
  (select year_joined, count(*) as n from customers where year_joined is not null group by 1)),
peak as (select * from ys order by n desc, year_joined limit 1)
select * from (select 'lowest_sector_share' as metric, employment_sector as label, round(share, 6) as value
  from sectors order by n, employment_sector limit 1)
union all select * from (select 'largest_region_share', region, round(share, 6) from rs order by n desc, region limit 1)
union all select 'first_year_share', 'New (<1yr)', round(100.0 * count(*) filter (segment = 0) / count(*), 6) from customers
union all select 'peak_year_customers', year_joined::varchar, n::double from peak
union all select 'peak_year_change', year_joined::varchar, round(change, 6) from peak""",
        "income_points": points("customers", "tenure_years", "income"),
        "age_bins": counts("customers", "age_binned"),
        "income_grid": grid("customers", "tenure_years", "income", 1, 500),
    },
)

_FIT = """, f as (select regr_count(y, x)::bigint as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept,
  regr_r2(y, x) as r2, avg(x) as mean_x, regr_sxx(y, x) as sxx,
  regr_sxy(y, x) as sxy, regr_syy(y, x) as syy, min(x) as min_x, max(x) as max_x,
  sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2)) as residual_sd
  from (select tenure_years as x, income as y from customers where tenure_years is not null and income is not null))"""

panels(
    "customers",
    build_customers,
    st.CUSTOMERS_SQL,
    {
        "income_band": _FIT
        + """, p as (select r.range::bigint as point, min_x + r.range * ((max_x - min_x) / 99) as x, * from f, range(100) r)
select point, round(x, 4) as x, round(intercept + slope * x, 4) as y_hat,
  round(intercept + slope * x - 1.96 * residual_sd * sqrt(1.0 / n + pow(x - mean_x, 2) / sxx), 4) as band_low,
  round(intercept + slope * x + 1.96 * residual_sd * sqrt(1.0 / n + pow(x - mean_x, 2) / sxx), 4) as band_high from p""",
    },
    places=4,
)


@query(f"""with {st.CUSTOMERS_SQL}{_FIT}
select n, round(slope, 6) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2, round(mean_x, 6) as mean_x,
  round(sxx, 4) as sxx, round(min_x, 6) as min_x, round(max_x, 6) as max_x, round(sxy, 4) as sxy, round(syy, 2) as syy, round(residual_sd, 6) as residual_sd from f""")
def customers_income_fit(spark, sf):
    fit = build_customers(spark, sf)["income_fit"]
    return comparable(fit.withColumns({"sxx": F.round("sxx", 4), "sxy": F.round("sxy", 4), "syy": F.round("syy", 2)}), 6)


# --- employees


def build_employees(spark, sf):
    return plans.employees_report(st.employees(spark, sf), branch="Brand#7", education_levels=st.EDUCATION)


panels(
    "employees",
    build_employees,
    st.EMPLOYEES_SQL,
    {
        "branch_options": options("employees", "branch"),
        "department_options": options("employees", "department"),
        "year_options": options("employees", "joining_year"),
        "kpis": "select count(distinct employee_id) as n_employees, round(avg(tenure_years), 6) as mean_tenure, "
        "round(avg(age), 6) as mean_age from chosen",
        "hiring": "select joining_year, count(employee_id) as n from chosen group by 1",
        "departments": shares("chosen", "department"),
        "tenure_by_department": "select department, round(avg(tenure_years), 6) as mean_tenure from chosen "
        "where department is not null group by 1",
        "age_by_position": "select position, round(avg(age), 6) as mean_age from chosen group by 1",
        "gender": shares("chosen", "gender"),
        "education_by_income": f""", e as (select floor(income_level / 10000)::bigint as band, education_level
  from employees where income_level >= 0 and education_level is not null),
b as (select distinct band from e), l as (select unnest([{", ".join(f"'{x}'" for x in st.EDUCATION)}]) as education_level)
select band, band * 10000.0::double as lo, (band + 1) * 10000.0::double as hi,
  (band * 10000)::varchar || '-' || ((band + 1) * 10000)::varchar as band_label, education_level,
  (select count(*) from e where e.band = b.band and e.education_level = l.education_level) as n from b, l""",
    },
)


# --- market


def build_market(spark, sf):
    m = st.market(spark, sf)
    return plans.market_report(m["ages"], m["industries"], m["regions"], m["region_industry"], "Brand#5")


_LONG = """, l as (select region, industry, try_cast(v as double) as "count" from (
  unpivot region_industry on "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY" into name industry value v)
  where try_cast(v as double) is not null)
"""

panels(
    "market",
    build_market,
    st.MARKET_SQL,
    {
        "industry_options": "select distinct industry from industries",
        "age_means": mean_ci("ages", "age_group", "total"),
        "age_percentage": "select age_group, round(total / sum(total) over () * 100, 6) as percentage from ages",
        "industry_means": mean_ci("industries", "industry", "total_population"),
        "selected_industry": "select industry, total_population from industries where industry = 'Brand#5'",
        "industry_shares": "select industry, total_population, "
        "round(total_population / sum(total_population) over () * 100, 6) as percentage from industries",
        "insights": """select * from (select 'largest_age_group' as metric, age_group as label, total as value from ages
  order by total desc, age_group limit 1)
union all select * from (select 'largest_industry', industry, total_population from industries
  order by total_population desc, industry limit 1)""",
        "region_preview": "select region, population from regions order by region limit 5",
        "region_industry_preview": "select * from region_industry order by all nulls last limit 5",
        "industry_by_region": _LONG + mean_ci("l", "region, industry", '"count"'),
    },
)


@query(f"""with {st.MARKET_SQL}
select age_group, total::varchar as total, round(total / sum(total) over () * 100, 6) as percentage from ages""")
def market_export(spark, sf):
    path = plans.export_ages(st.market(spark, sf)["ages"], shared_folder(spark, "ages"))
    back = read_texts(spark, path)
    return back.withColumn("percentage", F.round(F.col("percentage").cast("double"), 6))


_INSIGHTS = f"""with {st.MARKET_SQL}
select * from (select 'largest_age_group' as metric, age_group as label, total as value from ages
  order by total desc, age_group limit 1)
union all select * from (select 'largest_industry', industry, total_population from industries
  order by total_population desc, industry limit 1)"""


def _bundle(spark, sf, **options) -> dict[str, DataFrame]:
    raw = st.market_raw(spark, sf)
    paths = {name: export_csv(df, shared_folder(spark, name)) for name, df in raw.items()}
    return read_bundle(spark, {name: (path, st.MARKET_DATASETS[name]) for name, path in paths.items()}, **options)


@query(_INSIGHTS)
def market_bundle(spark, sf):
    read = _bundle(spark, sf)
    return plans.market_insights(read["ages"], read["industries"])


@query(f"with {st.MARKET_SQL}{_LONG}{mean_ci('l', 'region, industry', '\"count\"')}")
def market_bundle_regions(spark, sf):
    """The wide table of the bundle, whose columns beyond the region are not declared."""
    read = _bundle(spark, sf)
    report = plans.market_report(read["ages"], read["industries"], read["regions"], read["region_industry"], "Brand#5")
    return comparable(report["industry_by_region"], 6)


@query(f"with {st.MARKET_SQL} select age_group, total from ages where false")
def market_bundle_missing(spark, sf):
    """A bundle of which one table is missing is empty as a whole."""
    raw = st.market_raw(spark, sf)["ages"]
    there = export_csv(raw, shared_folder(spark, "ages"))
    sources = {"ages": (there, INDUSTRY_AGES), "industries": (f"{there}-missing", INDUSTRY_POPULATION)}
    return read_bundle(spark, sources, on_error="empty")["ages"]


# --- the same reports from CSV files


def through_csv(raw: DataFrame, dataset, date_format: str | None = None) -> DataFrame:
    """The raw table written as CSV and read as a user would read it."""
    path = export_csv(raw, shared_folder(raw.sparkSession, dataset.name))
    return read_table(raw.sparkSession, path, dataset, date_format=date_format)


def csv_query(name: str, sql_of: str, build: Callable) -> None:
    """Registers a panel read from CSV under the SQL of its twin."""
    query(SQL[sql_of], name)(build)


# --- branches


def build_branches(spark, sf):
    return plans.branches_report(st.branches(spark, sf))


_METRICS = plans.branches.METRICS
_CORR = " union all ".join(
    f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 6) as corr from branches"
    for a in _METRICS
    for b in _METRICS
)
_DISTRICTS = ", ".join(f"({st._sql_text(d)}, {n}::bigint)" for d, n in plans.DISTRICT_POPULATION)
_PLACES = ", ".join(f"({st._sql_text(b)}, {st._sql_text(d)})" for b, d in plans.BRANCH_DISTRICTS.items())

panels(
    "branches",
    build_branches,
    st.BRANCHES_SQL,
    {
        "top_profitability": """select branch_name, region, profitability_index,
  round(loan_portfolio_ghs_million, 6) as loan_portfolio_ghs_million, deposits_ghs_million
from branches order by profitability_index desc, branch_name, region limit 5""",
        "categories": counts("branches", "performance_category"),
        "correlations": _CORR,
        "customer_to_staff": "select branch_name, round(customer_to_staff, 6) as customer_to_staff from loads",
        "capacity": "select branch_name, round(customer_to_staff, 6) as customer_to_staff, "
        "round(service_capacity_score, 6) as service_capacity_score from loads",
        "load_satisfaction_points": points("loads", "customer_to_staff", "customer_satisfaction", "performance_category"),
        "load_satisfaction_grid": grid("loads", "customer_to_staff", "customer_satisfaction", 100, 0.5, "performance_category"),
        "regions": counts("branches", "region"),
        "map_centre": "select round(avg(gps_latitude), 6) as lat, round(avg(gps_longitude), 6) as lon from branches",
        "map_points": """select round(gps_latitude, 6) as lat, round(gps_longitude, 6) as lon,
  branch_name || ' (' || region || ')<br>Perf: ' || performance_category || '<br>Profit Index: ' || profitability_index as popup,
  case when atm_available = 'Yes' then 'blue' else 'gray' end as color from branches""",
        "accessibility": counts("branches", "disability_access"),
        "access_customers": box("branches", "disability_access", "active_customers"),
        "access_outliers": outliers("branches", "disability_access", "active_customers"),
        "coverage": f"""select branch_name, name as matched_district, active_customers, population,
  round_even(active_customers / population * 100, 2) as coverage_pct
from branches left join (values {_PLACES}) p(place, name) on branch_name = place
left join (values {_DISTRICTS}) d(district, population) on name = district""",
    },
)


# --- agents


def build_agents(spark, sf):
    return plans.agents_report(st.agents(spark, sf), training_values=["No", "Yes"])


_TRIO = ("monthly_transactions", "monthly_volume_ghs", "monthly_commission_ghs")

panels(
    "agents",
    build_agents,
    st.AGENTS_SQL,
    {
        "top_volume": """select agent_id, region, monthly_volume_ghs::double as monthly_volume_ghs,
  monthly_commission_ghs::double as monthly_commission_ghs, performance_tier
from agents order by agents.monthly_volume_ghs desc, agent_id limit 10""",
        "tier_means": "select performance_tier, "
        + ", ".join(f"round_even(avg({c}), 2) as {c}" for c in _TRIO)
        + " from agents where performance_tier is not null group by 1",
        "rate_volume_points": points("agents", "commission_rate_pct", "monthly_volume_ghs", "performance_tier"),
        "rate_volume_grid": grid("agents", "commission_rate_pct", "monthly_volume_ghs", 0.5, 1000, "performance_tier"),
        "regions": counts("agents", "region"),
        "region_totals": "select region, "
        + ", ".join(f"round_even({money(c)}, 2) as {c}" for c in _TRIO)
        + " from agents group by 1",
        "region_mean_transactions": "select region, round_even(avg(monthly_transactions), 2) as mean_monthly_transactions "
        "from agents group by 1",
        "map_centre": "select round(avg(gps_latitude), 6) as lat, round(avg(gps_longitude), 6) as lon from agents",
        "map_points": """select round(gps_latitude, 6) as lat, round(gps_longitude, 6) as lon,
  '<b>ID:</b> ' || agent_id || '<br><b>Region:</b> ' || region || '<br><b>Tier:</b> ' || coalesce(performance_tier, 'nan')
  || '<br><b>Service:</b> ' || services_offered as popup from agents""",
        "map_clusters": """select floor(gps_latitude / 0.5)::bigint as x_cell, floor(gps_longitude / 0.5)::bigint as y_cell,
  count(*) as n, round(avg(gps_latitude), 6) as x_mean, round(avg(gps_longitude), 6) as y_mean from agents group by 1, 2""",
        "base_by_tier": mean_ci("agents", "performance_tier", "active_customer_base"),
        "hours_base_points": "select working_hours, active_customer_base, performance_tier from agents "
        "where working_hours is not null and active_customer_base is not null",
        "hours_base_grid": """select performance_tier, working_hours, floor(active_customer_base / 10)::bigint as y_cell,
  count(*) as n from agents where working_hours is not null and active_customer_base is not null group by all""",
        "base_by_training": "select training_completed, round_even(avg(active_customer_base), 2) as mean_customer_base "
        "from agents group by 1",
        "region_training": """select region, round(avg(monthly_volume_ghs) filter (training_completed = 'No'), 6) as "No",
  round(avg(monthly_volume_ghs) filter (training_completed = 'Yes'), 6) as "Yes" from agents group by 1""",
        "top_engagement": "select agent_id, round(engagement_score, 6) as engagement_score from scored "
        "order by scored.engagement_score desc nulls last, agent_id limit 10",
        "engagement_volume_points": points("scored", "engagement_score", "monthly_volume_ghs", "performance_tier"),
        "engagement_volume_grid": grid("scored", "engagement_score", "monthly_volume_ghs", 1, 1000, "performance_tier"),
        "engagement_summary": f"""select round(engagement_score, 6) as engagement_score, performance_tier,
  total_monthly_volume_ghs from (select engagement_score, performance_tier, {money('monthly_volume_ghs')} as total_monthly_volume_ghs
  from scored where engagement_score is not null and performance_tier is not null group by 1, 2)
order by total_monthly_volume_ghs desc, engagement_score, performance_tier limit 10""",
        "compliance_by_tier": box("agents", "performance_tier", "compliance_score"),
        "compliance_outliers": outliers("agents", "performance_tier", "compliance_score"),
    },
)


def _csv_panels() -> None:
    def accounts(spark, sf):
        return comparable(plans.accounts_report(st.accounts(spark, sf, through_csv))["product_flows"], 6)

    def customers(spark, sf):
        return comparable(plans.customers_report(st.customers(spark, sf, through_csv))["insights"], 6)

    def employees(spark, sf):
        report = plans.employees_report(st.employees(spark, sf, through_csv), "Brand#7")
        return comparable(report["hiring"], 6)

    def branches(spark, sf):
        return comparable(plans.branches_report(st.branches(spark, sf, through_csv))["coverage"], 6)

    def agents(spark, sf):
        return comparable(plans.agents_report(st.agents(spark, sf, through_csv), training_values=["No", "Yes"])["region_totals"], 6)

    csv_query("csv_accounts", "accounts_product_flows", accounts)
    csv_query("csv_customers", "customers_insights", customers)
    csv_query("csv_employees", "employees_hiring", employees)
    csv_query("csv_branches", "branches_coverage", branches)
    csv_query("csv_agents", "agents_region_totals", agents)


_csv_panels()


# --- the grouped panels of a report from one scan for each scope


def shared(report: str, build: Callable, tables: str, spec: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]) -> None:
    """All grouped panels in long form, by panel, keys and figure, under the SQL of the panels themselves."""
    parts = []
    for panel, (keys, figures) in spec.items():
        own = SQL[f"{report}_{panel}"].removeprefix(f"with {tables}\n")
        labels = [f"{k}::varchar" for k in keys] + ["null::varchar"] * (2 - len(keys))
        parts += [
            f"select '{panel}' as panel, {labels[0]} as key_1, {labels[1]} as key_2, '{figure}' as figure, "
            f"{figure}::double as value from ({own})"
            for figure in figures
        ]

    def run(spark, sf) -> DataFrame:
        made = build(spark, sf)
        out = []
        for panel, (keys, figures) in spec.items():
            rows = comparable(made[panel], 6)
            labels = [F.col(k).cast("string") for k in keys] + [F.lit(None).cast("string")] * (2 - len(keys))
            cells = F.array(
                *[F.struct(F.lit(f).alias("figure"), F.col(f"`{f}`").cast("double").alias("value")) for f in figures]
            )
            named = rows.select(F.lit(panel).alias("panel"), labels[0].alias("key_1"), labels[1].alias("key_2"), F.inline(cells))
            out.append(named)
        return reduce(DataFrame.union, out)

    query(f"with {tables}\n" + "\nunion all ".join(parts), f"{report}_shared")(run)


_TIERS = ("monthly_transactions", "monthly_volume_ghs", "monthly_commission_ghs")

shared(
    "accounts",
    lambda spark, sf: plans.accounts_report(st.accounts(spark, sf), shared=True),
    st.ACCOUNTS_SQL,
    {
        "active_share": (("active_account",), ("n", "share")),
        "by_type": (("account_type",), ("n",)),
        "by_year": (("year_opened",), ("n",)),
        "branch_flows": (("branch",), ("deposits", "withdrawals")),
        "product_flows": (("product_code",), ("deposits", "withdrawals")),
        "age_by_status": (("account_age_years", "status"), ("n",)),
        "product_net_flow": (("product_code",), ("net_flow",)),
        "product_interest": (("product_code",), ("interest",)),
        "activity_by_type": (("account_type",), ("mean_activity",)),
        "balance_by_year": (("year_opened",), ("mean_balance",)),
    },
)
shared(
    "customers",
    lambda spark, sf: plans.customers_report(st.customers(spark, sf), shared=True),
    st.CUSTOMERS_SQL,
    {
        "sector_penetration": (("employment_sector",), ("n", "share")),
        "regions": (("region",), ("n",)),
        "gender": (("gender",), ("n", "share")),
        "gender_balance": ((), ("n_left", "n_right", "n_rows", "gap")),
        "acquisition": (("year_joined",), ("n",)),
        "peak_year": (("label",), ("value",)),
        "age_bins": (("age_binned",), ("n",)),
    },
)
shared(
    "employees",
    lambda spark, sf: plans.employees_report(st.employees(spark, sf), branch="Brand#7", shared=True),
    st.EMPLOYEES_SQL,
    {
        "department_options": (("option",), ("option_group",)),
        "hiring": (("joining_year",), ("n",)),
        "departments": (("department",), ("n", "share")),
        "tenure_by_department": (("department",), ("mean_tenure",)),
        "age_by_position": (("position",), ("mean_age",)),
        "gender": (("gender",), ("n", "share")),
    },
)
shared(
    "agents",
    lambda spark, sf: plans.agents_report(st.agents(spark, sf), training_values=["No", "Yes"], shared=True),
    st.AGENTS_SQL,
    {
        "tier_means": (("performance_tier",), _TIERS),
        "regions": (("region",), ("n",)),
        "region_totals": (("region",), _TIERS),
        "region_mean_transactions": (("region",), ("mean_monthly_transactions",)),
        "map_centre": ((), ("lat", "lon")),
        "base_by_tier": (("performance_tier",), ("n", "mean", "ci_low", "ci_high")),
        "base_by_training": (("training_completed",), ("mean_customer_base",)),
    },
)
shared(
    "branches",
    lambda spark, sf: plans.branches_report(st.branches(spark, sf), shared=True),
    st.BRANCHES_SQL,
    {
        "categories": (("performance_category",), ("n",)),
        "regions": (("region",), ("n",)),
        "map_centre": ((), ("lat", "lon")),
        "accessibility": (("disability_access",), ("n",)),
    },
)
