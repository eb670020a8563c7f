"""Domain tables derived from the driver tables, as Spark frames and as SQL.

The source's own headers and missing-value texts are put on before a frame is conformed, so the
reading rules run too.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindings.tables import table
from tillgrid import plans
from tillgrid import sources as src

AS_OF = dt.date(2002, 1, 1)
BRANCH_NAMES = (*plans.BRANCH_DISTRICTS, "Night Desk")
EDUCATION = ("blue", "cold", "hot", "large", "new", "old", "red", "small")
AGE_BINS = ("18-30", "31-50", "51+")
TIERS = ("Gold", "Silver", "Bronze")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def money(col: Column) -> Column:
    return (F.rint(col * 100).cast("bigint") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def day(col: Column) -> Column:
    return col.cast("date").cast("string")


def pick(names, at: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


Load = Callable[..., DataFrame]


def accounts(spark, sf, load: Load = src.conform) -> DataFrame:
    o = table(spark, sf, "orders")
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    amount = money(price)
    age = 2002 - F.year("o_orderdate")
    withdrawn = F.when(status == "F", amount).when(status == "O", F.lit(0).cast("decimal(18,2)"))
    raw = o.select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("Customer ID"),
        F.when(priority != "3-MEDIUM", priority).otherwise("n/a").alias("Account Type"),
        F.when(price >= 20000, F.col("o_orderdate")).alias("Opening Date"),
        F.when(status == "F", "Yes").when(status == "O", "No").otherwise("NA").alias("Active Account"),
        F.when(status == "F", "Active").when(status == "O", "Dormant").otherwise("Closed").alias("Status"),
        age.alias("Account Age (Years)"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "Yes").otherwise("No").alias("Mobile Banking"),
        F.when(price > 200000, "Yes").when(price > 100000, "No").otherwise("").alias("SMS Alerts"),
        F.when(status == "P", "Pending").otherwise("No").alias("Email Alerts"),
        F.concat(F.lit("Branch "), F.col("o_custkey") % 25).alias("Branch"),
        F.when((priority == "5-LOW") & (status == "P"), "null")
        .otherwise(F.concat(F.left(priority, F.lit(1)), status))
        .alias("Product Code"),
        amount.alias("Total Deposits"),
        withdrawn.alias("Total Withdrawals"),
        (amount - F.coalesce(withdrawn, F.lit(0))).alias("Net Flow"),
        (amount * age).alias("Interest Earned"),
        (amount - 250000).alias("Current Balance"),
        (price / 1000).alias("Activity Score"),
    )
    return plans.prepare_accounts(load(raw, src.ACCOUNTS))


ACCOUNTS_SQL = """accounts as (
  select *, year(opening_date) as year_opened, total_deposits - coalesce(total_withdrawals, 0) as net_flow from (
    select 'C' || o_custkey as customer_id, nullif(o_orderpriority, '3-MEDIUM') as account_type,
      case when o_totalprice >= 20000 then o_orderdate end as opening_date,
      case o_orderstatus when 'F' then 'Yes' when 'O' then 'No' end as active_account,
      case o_orderstatus when 'F' then 'Active' when 'O' then 'Dormant' else 'Closed' end as status,
      (2002 - year(o_orderdate))::double as account_age_years,
      case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Yes' else 'No' end as mobile_banking,
      case when o_totalprice > 200000 then 'Yes' when o_totalprice > 100000 then 'No' end as sms_alerts,
      case when o_orderstatus = 'P' then 'Pending' else 'No' end as email_alerts,
      'Branch ' || (o_custkey % 25) as branch,
      case when not (o_orderpriority = '5-LOW' and o_orderstatus = 'P')
        then left(o_orderpriority, 1) || o_orderstatus end as product_code,
      o_totalprice::decimal(18,2) as total_deposits,
      case o_orderstatus when 'F' then o_totalprice::decimal(18,2) when 'O' then 0::decimal(18,2) end as total_withdrawals,
      (o_totalprice::decimal(18,2) * (2002 - year(o_orderdate)))::decimal(18,2) as interest_earned,
      (o_totalprice::decimal(18,2) - 250000)::decimal(18,2) as current_balance,
      o_totalprice / 1000 as activity_score
    from orders)),
chosen as (select * from accounts where year_opened is not null)"""


def _customer_regions(spark, sf) -> DataFrame:
    nations, regions = table(spark, sf, "nation"), table(spark, sf, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select("n_nationkey", "r_name")


def customers(spark, sf, load: Load = src.conform) -> DataFrame:
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    c = table(spark, sf, "customer")
    c = c.join(first, c.c_custkey == first.o_custkey, "left")
    places = _customer_regions(spark, sf)
    c = c.join(places, c.c_nationkey == places.n_nationkey)
    balance = F.col("c_acctbal")
    raw = c.select(
        F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 2)).alias("Customer ID"),
        day(F.col("since")).alias("Customer Since"),
        ((2002 - F.year("since")) * 12 + 1 - F.month("since")).alias("Tenure"),
        F.when(F.col("c_mktsegment") == "BUILDING", "None").otherwise(F.col("c_mktsegment")).alias("Employment Sector"),
        F.col("r_name").alias("Region"),
        F.when(balance < 0, "").when(balance < 5500, "Female").otherwise("Male").alias("Gender"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(float("nan"))).otherwise(balance).alias("Income"),
        F.when(balance > 9000, "nan").otherwise(pick(AGE_BINS, F.col("c_custkey") % 3)).alias("Age Binned"),
    )
    return plans.prepare_customers(load(raw, src.CUSTOMERS, "yyyy-MM-dd"))


CUSTOMERS_SQL = """firsts as (select o_custkey, min(o_orderdate) as since from orders group by 1),
customers as (
  select *, tenure_months / 12 as tenure_years, year(customer_since) as year_joined,
    case when tenure_months / 12 > 0 and tenure_months / 12 <= 1 then 0 when tenure_months / 12 <= 3 then 1
      when tenure_months / 12 <= 5 then 2 when tenure_months / 12 <= 10 then 3 when tenure_months / 12 <= 20 then 4
    end as segment
  from (select 'C' || (c_custkey // 2) as customer_id, since as customer_since,
      ((2002 - year(since)) * 12 + 1 - month(since))::double as tenure_months,
      nullif(c_mktsegment, 'BUILDING') as employment_sector, r_name as region,
      case when c_acctbal < 0 then null when c_acctbal < 5500 then 'Female' else 'Male' end as gender,
      case when c_mktsegment <> 'MACHINERY' then c_acctbal end as income,
      case when c_acctbal <= 9000 then list_extract(['18-30', '31-50', '51+'], (c_custkey % 3 + 1)::int) end as age_binned
    from customer left join firsts on c_custkey = o_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey))"""


def employees(spark, sf, load: Load = partial(src.conform, bare=("Branch",))) -> DataFrame:
    p = table(spark, sf, "part")
    joined = F.date_add(F.lit(dt.date(1990, 1, 1)), (F.col("p_partkey") * 37 % 4500).cast("int"))
    raw = p.select(
        F.when(F.col("p_size") < 50, F.concat(F.lit("E"), F.col("p_partkey"))).alias("Employee ID"),
        day(joined).alias("JoiningDate"),
        F.col("p_brand").alias("Branch"),
        F.when(F.col("p_type") == "PROMO", "NaN").otherwise(F.col("p_type")).alias("Department"),
        F.substring_index("p_name", " ", -1).alias("Position"),
        F.when(F.col("p_size") % 2 == 0, "Female").otherwise("Male").alias("Gender"),
        (F.nullif(F.col("p_size"), F.lit(13)) + 18).alias("Age"),
        (F.nullif(F.col("p_size"), F.lit(20)) * 2500.0 - 5000.0).alias("IncomeLevelNumeric"),
        F.substring_index("p_name", " ", 1).alias("EducationLevel"),
    )
    return plans.prepare_employees(load(raw, src.EMPLOYEES, "yyyy-MM-dd"), AS_OF)


EMPLOYEES_SQL = """employees as (
  select *, year(joining_date) as joining_year, date_diff('day', joining_date, date '2002-01-01') / 365.0 as tenure_years
  from (select case when p_size < 50 then 'E' || p_partkey end as employee_id,
      (date '1990-01-01' + (p_partkey * 37 % 4500)::int)::date as joining_date, p_brand as branch,
      nullif(p_type, 'PROMO') as department, split_part(p_name, ' ', 2) as position,
      case when p_size % 2 = 0 then 'Female' else 'Male' end as gender, (nullif(p_size, 13) + 18)::double as age,
      (nullif(p_size, 20) * 2500 - 5000)::double as income_level, split_part(p_name, ' ', 1) as education_level
    from part)),
chosen as (select * from employees where branch = 'Brand#7' and joining_year is not null)"""


def branches(spark, sf, load: Load = src.conform) -> DataFrame:
    sales = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint").cast("decimal(18,0)")).alias("cents"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
        )
    )
    s = table(spark, sf, "supplier")
    s = s.join(sales, s.s_suppkey == sales.l_suppkey, "left")
    places = _customer_regions(spark, sf)
    s = s.join(places, s.s_nationkey == places.n_nationkey)
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    raw = s.select(
        pick(BRANCH_NAMES, F.col("s_suppkey") % len(BRANCH_NAMES)).alias("Branch Name"),
        F.col("r_name").alias("Region"),
        balance.alias("Profitability Index"),
        (F.col("cents").cast("double") / 100.0).alias("Loan Portfolio (GHS Million)"),
        F.col("quantity").alias("Deposits (GHS Million)"),
        F.col("lines").alias("Loan Portfolio Quality (%)"),
        (F.col("returned") * 100.0 / F.col("lines")).alias("Collection Rate (%)"),
        nation.alias("NPL Rate (%)"),
        F.when(balance >= 0, balance / 100).otherwise(F.lit(float("nan"))).alias("Market Share (%)"),
        F.when(balance < 0, "Low").when(balance < 5000, "Medium").otherwise("High").alias("Performance Category"),
        F.when(nation == 4, 0).otherwise(F.col("lines")).alias("Active Customers"),
        (nation % 5).alias("Staff Count"),
        (nation % 4 + 1).alias("Customer Service Desks"),
        (nation / 5.0).alias("Customer Satisfaction (5.0)"),
        (balance / 1000).alias("GPS Latitude"),
        (nation / 10.0).alias("GPS Longitude"),
        F.when(balance > 5000, "Yes").when(balance > 1000, "No").otherwise("").alias("ATM Available"),
        pick(("Full", "None", "Partial"), nation % 3).alias("Disability Access"),
    )
    return load(raw, src.BRANCHES)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


BRANCHES_SQL = f"""sales as (select l_suppkey, count(*) as lines, count(*) filter (l_returnflag = 'R') as returned,
    sum(l_extendedprice::decimal(18,2)) as gross, sum(l_quantity::bigint) as quantity from lineitem group by 1),
branches as (
  select list_extract([{", ".join(map(_sql_text, BRANCH_NAMES))}], (s_suppkey % {len(BRANCH_NAMES)} + 1)::int) as branch_name,
    r_name as region, s_acctbal as profitability_index, gross::double as loan_portfolio_ghs_million,
    quantity::double as deposits_ghs_million, lines::double as loan_portfolio_quality_pct,
    returned * 100.0::double / lines as collection_rate_pct, s_nationkey::double as npl_rate_pct,
    case when s_acctbal >= 0 then s_acctbal / 100 end as market_share_pct,
    case when s_acctbal < 0 then 'Low' when s_acctbal < 5000 then 'Medium' else 'High' end as performance_category,
    case when s_nationkey = 4 then 0 else lines end::double as active_customers, (s_nationkey % 5)::double as staff_count,
    (s_nationkey % 4 + 1)::double as customer_service_desks, s_nationkey / 5.0::double as customer_satisfaction,
    s_acctbal / 1000 as gps_latitude, s_nationkey / 10.0::double as gps_longitude,
    case when s_acctbal > 5000 then 'Yes' when s_acctbal > 1000 then 'No' end as atm_available,
    case s_nationkey % 3 when 0 then 'Full' when 2 then 'Partial' end as disability_access
  from supplier left join sales on s_suppkey = l_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
loads as (select *, active_customers / nullif(staff_count, 0) as customer_to_staff,
  customer_service_desks / nullif(active_customers, 0) as service_capacity_score from branches)"""


def agents(spark, sf, load: Load = src.conform) -> DataFrame:
    kind, cents = F.col("event_type"), F.rint(F.col("value") * 100).cast("bigint")

    def amount(total: Column) -> Column:
        return (total.cast("decimal(22,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")

    per_user = (
        table(spark, sf, "events")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            amount(F.sum(cents)).alias("volume"),
            amount(F.sum(F.when(kind == "purchase", cents))).alias("commission"),
            amount(F.sum(F.when(kind == "click", cents))).alias("clicks"),
            F.count_if(kind == "view").alias("views"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
    )
    regions = table(spark, sf, "region")
    user = F.col("user_id")
    raw = per_user.join(regions, user % 5 == F.col("r_regionkey")).select(
        F.concat(F.lit("A"), user).alias("agent_id"),
        F.col("r_name").alias("region"),
        F.coalesce(pick(TIERS, user % 4), F.lit("nan")).alias("performance_tier_clean"),
        F.col("events").alias("monthly_transactions"),
        F.col("volume").alias("monthly_volume_(ghs)"),
        F.col("commission").alias("monthly_commission_(ghs)"),
        (user % 10 / 2.0).alias("commission_rate_(%)"),
        F.col("views").alias("active_customer_base"),
        pick(("8-17", "24h", "NA"), user % 3).alias("working_hours"),
        F.when((user % 2 == 0) | (user % 5 == 2), "Yes").otherwise("No").alias("training_completed"),
        (user % 7).alias("months_active"),
        F.concat(F.lit("Service "), user % 3).alias("services_offered"),
        F.col("low").alias("gps_latitude"),
        (F.col("high") / 10).alias("gps_longitude"),
        F.col("clicks").cast("double").alias("compliance_score"),
    )
    return load(raw, src.AGENTS)


AGENTS_SQL = """users as (select user_id, count(*) as events, sum(value::decimal(18,2)) as volume,
    sum(value::decimal(18,2)) filter (event_type = 'purchase') as commission,
    sum(value::decimal(18,2)) filter (event_type = 'click') as clicks,
    count(*) filter (event_type = 'view') as views, min(value) as low, max(value) as high from events group by 1),
agents as (
  select 'A' || user_id as agent_id, r_name as region,
    case user_id % 4 when 0 then 'Gold' when 1 then 'Silver' when 2 then 'Bronze' end as performance_tier,
    events::double as monthly_transactions, volume as monthly_volume_ghs, commission as monthly_commission_ghs,
    (user_id % 10) / 2.0::double as commission_rate_pct, views::double as active_customer_base,
    case user_id % 3 when 0 then '8-17' when 1 then '24h' end as working_hours,
    case when user_id % 2 = 0 or user_id % 5 = 2 then 'Yes' else 'No' end as training_completed,
    (user_id % 7)::double as months_active, 'Service ' || (user_id % 3) as services_offered,
    low as gps_latitude, high / 10 as gps_longitude, clicks::double as compliance_score
  from users join region on user_id % 5 = r_regionkey),
scored as (select *, (monthly_transactions + active_customer_base) / nullif(months_active, 0) as engagement_score from agents)"""


MARKET_DATASETS = {
    "ages": src.INDUSTRY_AGES,
    "industries": src.INDUSTRY_POPULATION,
    "regions": src.REGION_POPULATION,
    "region_industry": src.INDUSTRY_BY_REGION,
}


def market_raw(spark, sf) -> dict[str, DataFrame]:
    """The four tables of the bundle under their source headers."""
    c = table(spark, sf, "customer")
    ages = c.groupBy(
        F.concat(F.lit("Age "), F.col("c_nationkey")).alias("Age Groups"), F.col("c_mktsegment")
    ).agg(F.count(F.lit(1)).alias("Total"))
    parts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("Industry"))
    industries = parts.agg(F.sum("p_size").alias("Total population"))
    placed = c.join(_customer_regions(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = placed.groupBy(F.col("r_name").alias("Region")).agg(F.count(F.lit(1)).alias("population"))
    counted = placed.groupBy("r_name", "c_nationkey").pivot("c_mktsegment", list(SEGMENTS)).agg(F.count(F.lit(1)))
    # Cells as a spreadsheet may hold them: blanks around numbers, thousands commas, notes.
    texts = {
        s: F.when(F.col("c_nationkey") == i, "x")
        .when(F.col("c_nationkey") == i + 5, F.lit("1,200"))
        .otherwise(F.concat(F.lit(" "), F.col(s), F.lit(" ")))
        for i, s in enumerate(SEGMENTS)
    }
    wide = counted.select(F.col("r_name").alias("Region"), *[v.alias(k) for k, v in texts.items()])
    return {"ages": ages, "industries": industries, "regions": regions, "region_industry": wide}


def market(spark, sf) -> dict[str, DataFrame]:
    return {name: src.conform(raw, MARKET_DATASETS[name]) for name, raw in market_raw(spark, sf).items()}


_CELLS = ",\n      ".join(
    f"case when c_nationkey = {i} then 'x' when c_nationkey = {i + 5} then '1,200' "
    f"else ' ' || nullif(count(*) filter (c_mktsegment = '{s}'), 0) || ' ' end as \"{s}\""
    for i, s in enumerate(SEGMENTS)
)

MARKET_SQL = f"""ages as (select 'Age ' || c_nationkey as age_group, count(*)::double as total from customer
    group by c_nationkey, c_mktsegment),
industries as (select p_brand as industry, sum(p_size)::double as total_population from part group by 1),
placed as (select * from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
regions as (select r_name as region, count(*) as population from placed group by 1),
region_industry as (select r_name as region,
      {_CELLS}
    from placed group by r_name, c_nationkey)"""
