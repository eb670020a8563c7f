"""Each operator on a driver table. Doubles are rounded to six places on both sides."""

from __future__ import annotations

import datetime as dt
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindings.registry import query
from bindings.tables import table
from tillgrid import functions as fn
from tillgrid import operators as op
from tillgrid import sources as src

AS_OF = dt.date(2002, 1, 1)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
TENURE_EDGES = (0, 1, 3, 5, 10, 20)
TENURE_LABELS = ("New", "Growth", "Established", "Loyal", "VIP")


def r(col: str | Column, places: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, places)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def order_year(df: DataFrame) -> DataFrame:
    return df.withColumn("order_year", fn.year_of(F.col("o_orderdate")).cast("bigint"))


# --- filters, parsing, option lists


@query("""
select o_custkey, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue
from orders where o_orderstatus in ('F','O')
group by o_custkey order by revenue desc, o_custkey limit 10
""")
def top_customers_by_revenue(spark, sf):
    orders = op.filter_in(table(spark, sf, "orders"), {"o_orderstatus": ["F", "O"]})
    return op.top_k(op.sum_by(orders, "o_custkey", {"revenue": "o_totalprice"}, money=True), "revenue", 10, "o_custkey")


@query("""
select month(d) as month, count(*) as n from (
  select try_cast('2024-' || lpad(json_extract_string(props, '$.k'), 2, '0') || '-01' as date) as d from events
) group by 1
""")
def parse_dates_lenient(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit("2024-"), F.lpad(k, 2, "0"), F.lit("-01"))
    dates = table(spark, sf, "events").select(fn.parse_ts(text, "yyyy-MM-dd").alias("d"))
    months = dates.select(F.month("d").cast("bigint").alias("month"))
    return op.value_counts(months, "month", order="key", keep_null_key=True)


@query("""
select event_type, count(*) as n from (select nullif(event_type, 'error') as event_type from events)
where event_type is not null group by 1
""")
def normalize_nulls(spark, sf):
    events = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "N/A").otherwise(F.col("event_type")).alias("event_type")
    )
    return op.value_counts(src.normalize_nulls(events), "event_type")


@query("""
select count(*) as n, round(avg(k), 6) as mean_k, max(k) as max_k from (
  select try_cast(case when event_type = 'error' then 'n/a' else json_extract_string(props, '$.k') end as double) as k
  from events
) where k is not null
""")
def coerce_numbers(spark, sf):
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
    ks = op.drop_null(table(spark, sf, "events").select(fn.to_number(text).alias("k")), "k")
    return op.kpis(ks, {"n": F.count(F.lit(1)), "mean_k": r(F.avg("k")), "max_k": F.max("k")})


@query("""
select page_id, case when regexp_extract(url, 'page=([0-9]+)', 1) <> ''
  then 'https://catalog.example.com/list/' || regexp_extract(url, 'page=([0-9]+)', 1) || '/view' else url end as url
from pages
""")
def regex_rewrite_urls(spark, sf):
    url = fn.regex_rewrite(F.col("url"), "page=([0-9]+)", "https://catalog.example.com/list/{}/view")
    return table(spark, sf, "pages").select("page_id", url.alias("url"))


@query("""
select 0::bigint as option_group, 'All' as option
union all select distinct 1::bigint, c_mktsegment from customer where c_mktsegment is not null
""")
def filter_options(spark, sf):
    return op.options_with_all(table(spark, sf, "customer"), "c_mktsegment")


@query("select distinct nullif(o_orderpriority, '3-MEDIUM') as o_orderpriority from orders")
def option_domain_with_null(spark, sf):
    priority = F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("o_orderpriority")
    return op.domain(table(spark, sf, "orders").select(priority), "o_orderpriority", drop_null=False)


@query("""
select o_orderkey, year(o_orderdate) as order_year, nullif(o_orderpriority, '3-MEDIUM') as priority, o_totalprice
from orders where year(o_orderdate) in (1996, 1998)
and (nullif(o_orderpriority, '3-MEDIUM') in ('1-URGENT') or nullif(o_orderpriority, '3-MEDIUM') is null)
""")
def filter_in_list(spark, sf):
    priority = F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("priority")
    orders = order_year(op.filter_years(table(spark, sf, "orders"), "o_orderdate", [1996, 1998]))
    return op.filter_in(orders.select("o_orderkey", "order_year", priority, "o_totalprice"), {"priority": ["1-URGENT", None]})


@query("select c_custkey, c_nationkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'")
def filter_optional_eq(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return op.filter_eq_optional(customers, {"c_mktsegment": "BUILDING", "c_nationkey": "All"})


@query("select c_name, c_acctbal from customer where c_name = 'Customer#000000007' order by c_acctbal limit 1")
def lookup_one(spark, sf):
    return op.lookup_one(table(spark, sf, "customer"), "c_name", "Customer#000000007", "c_acctbal")


# --- counts, shares, sums, means


@query("select c_mktsegment, count(*) as n from customer where c_mktsegment is not null group by 1")
def value_counts_segment(spark, sf):
    return op.value_counts(table(spark, sf, "customer"), "c_mktsegment")


@query("select year(o_orderdate) as order_year, count(*) as n from orders group by 1")
def counts_by_year(spark, sf):
    return op.value_counts(order_year(table(spark, sf, "orders")), "order_year", order="key")


@query("""
select segment, n, round(share, 6) as share, case when share < 25 then 'Untapped' end as flag from (
  select segment, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as share
  from (select nullif(c_mktsegment, 'BUILDING') as segment from customer) where segment is not null group by 1)
""")
def value_shares_segment(spark, sf):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment")
    shares = op.value_shares(table(spark, sf, "customer").select(segment), "segment")
    return rounded(shares.withColumn("flag", fn.flag_below(F.col("share"), 25)), "share")


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def counts_flag_vs_status(spark, sf):
    return op.value_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], order="key")


@query("""
select flag, count(*) filter (v = '1-URGENT') as "1-URGENT", count(*) filter (v = '2-HIGH') as "2-HIGH",
  count(*) filter (v = 'F') as "F", count(*) filter (v = 'O') as "O", count(*) filter (v = 'P') as "P"
from (select 'o_orderstatus' as flag, o_orderstatus as v from orders
      union all select 'o_orderpriority', o_orderpriority from orders) group by flag
""")
def flag_matrix(spark, sf):
    values = ["1-URGENT", "2-HIGH", "F", "O", "P"]
    return op.flag_matrix(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], values)


@query("""
select l_suppkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as gross,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity
from lineitem group by 1
""")
def sums_by_branch(spark, sf):
    return op.sum_by(table(spark, sf, "lineitem"), "l_suppkey", {"gross": "l_extendedprice", "quantity": "l_quantity"}, money=True)


@query("""
select p_type, cast(sum(case when l_returnflag = 'R' then -cast(l_extendedprice as decimal(18,2))
  else cast(l_extendedprice as decimal(18,2)) end) as double) as net_flow
from lineitem join part on l_partkey = p_partkey group by 1
""")
def net_flow_by_product(spark, sf):
    flow = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    lines = table(spark, sf, "lineitem").select("l_partkey", flow.alias("flow"))
    # Sums per part first: one row per part is joined, and a part sold in a third of all
    # lines is no larger than any other.
    per_part = op.sum_by(lines, "l_partkey", {"flow": "flow"}, money=True)
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    typed = per_part.join(parts, per_part.l_partkey == parts.p_partkey)
    return op.order_desc(op.sum_by(typed, "p_type", {"net_flow": "flow"}, money=True), "net_flow", "p_type")


@query("""
select p_type, round(avg(p_retailprice), 6) as mean_price, round(avg(nullif(p_size, 7)), 6) as mean_size
from part group by 1
""")
def means_by_tier(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_size", F.nullif(F.col("p_size"), F.lit(7)))
    means = op.mean_by(parts, "p_type", {"mean_price": "p_retailprice", "mean_size": "p_size"})
    return rounded(means, "mean_price", "mean_size")


@query("""
select o_orderpriority, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 6) as "F",
  round(avg(o_totalprice) filter (o_orderstatus = 'O'), 6) as "O",
  round(avg(o_totalprice) filter (o_orderstatus = 'P'), 6) as "P"
from (select o_orderpriority, o_orderstatus,
  case when not (o_orderpriority = '5-LOW' and o_orderstatus = 'P') then o_totalprice end as o_totalprice from orders) group by 1
""")
def mean_pivot_region_flag(spark, sf):
    # One cell of the table has no known price and so stays empty.
    unknown = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    orders = table(spark, sf, "orders").withColumn("o_totalprice", F.when(~unknown, F.col("o_totalprice")))
    wide = op.mean_pivot(orders, "o_orderpriority", "o_orderstatus", "o_totalprice", STATUSES)
    return rounded(wide, *STATUSES)


@query("""
select year(o_orderdate) as order_year,
  count(case when o_orderstatus <> 'P' then o_orderkey end) as n from orders group by 1
""")
def hiring_trend(spark, sf):
    orders = order_year(table(spark, sf, "orders")).select(
        "order_year", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("id")
    )
    return op.order_by_key(op.count_non_null_by(orders, "order_year", "id"), "order_year")


@query("""
select count(*) as n_rows, count(distinct o_custkey) as n_customers, round(avg(o_totalprice), 6) as mean_price,
  max(o_totalprice) as max_price, min(year(o_orderdate)) as first_year, max(year(o_orderdate)) as last_year
from orders
""")
def kpi_row(spark, sf):
    year = F.col("order_year")
    return op.kpis(
        order_year(table(spark, sf, "orders")),
        {
            "n_rows": F.count(F.lit(1)),
            "n_customers": op.distinct_count(F.col("o_custkey")),
            "mean_price": r(F.avg("o_totalprice")),
            "max_price": F.max("o_totalprice"),
            "first_year": F.min(year),
            "last_year": F.max(year),
        },
    )


@query("""
select n_customers, start_year, end_year, end_year - start_year + 1 as years_active,
  round(n_customers / (end_year - start_year + 1), 6) as avg_annual_growth
from (select count(distinct o_custkey) as n_customers, year(min(o_orderdate)) as start_year,
  year(max(o_orderdate)) as end_year from orders)
""")
def annual_growth_avg(spark, sf):
    return rounded(op.annual_growth_avg(table(spark, sf, "orders"), "o_custkey", "o_orderdate"), "avg_annual_growth")


@query("""
select event_type, k, count(*) as n from (
  select event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1, 2
""")
def count_by_two_keys(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    return op.value_counts(table(spark, sf, "events").select("event_type", k), ["event_type", "k"], order=None)


@query("""
select dimension, value, count(*) as n from (
  select 'o_orderstatus' as dimension, o_orderstatus as value from orders
  union all select 'o_orderpriority', nullif(o_orderpriority, '5-LOW') from orders
  union all select 'order_year', cast(year(o_orderdate) as varchar) from orders
) where value is not null group by 1, 2
""")
def profile_counts(spark, sf):
    orders = order_year(table(spark, sf, "orders"))
    orders = orders.withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")))
    return op.profile_counts(orders, ["o_orderstatus", "o_orderpriority", "order_year"])


@query("select year(o_orderdate) as label, count(*) as value from orders group by 1 order by value desc, label limit 1")
def peak_year(spark, sf):
    yearly = op.value_counts(order_year(table(spark, sf, "orders")), "order_year", order=None)
    return op.arg_max(yearly, "order_year", "n")


@query("""
with o as (select o_custkey, count(*) as n_orders,
    count(distinct date_trunc('month', o_orderdate)) filter (o_orderstatus <> 'F') as months
  from orders group by 1),
l as (select o_custkey, count(*) as n_lines from lineitem join orders on l_orderkey = o_orderkey group by 1),
s as (select c_mktsegment, c_acctbal,
    round_even((n_orders + coalesce(n_lines, 0)) / nullif(months, 0), 1) as score
  from o left join l using (o_custkey) join customer on o_custkey = c_custkey)
select score, c_mktsegment, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as total_balance
from s where score is not null group by 1, 2 order by total_balance desc, score, c_mktsegment limit 10
""")
def score_group_top(spark, sf):
    orders = table(spark, sf, "orders")
    # Lines per order, then one pass over orders: no count distinct and no second join.
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    held = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        "o_custkey",
        F.when(F.col("o_orderstatus") != "F", F.date_format("o_orderdate", "yyyy-MM")).alias("month"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
    )
    monthly = held.groupBy("o_custkey", "month").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("n_lines").alias("n_lines")
    )
    per_customer = monthly.groupBy("o_custkey").agg(
        F.sum("n_orders").alias("n_orders"), F.sum("n_lines").alias("n_lines"), F.count("month").alias("months")
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    scored = per_customer.join(customers, per_customer.o_custkey == customers.c_custkey)
    score = fn.engagement_score(F.col("n_orders"), F.col("n_lines"), F.col("months"))
    scored = scored.select(fn.round_even(score, 1).alias("score"), "c_mktsegment", "c_acctbal")
    sums = op.sum_by(scored, ["score", "c_mktsegment"], {"total_balance": "c_acctbal"}, money=True)
    return op.top_k(sums, "total_balance", 10, ["score", "c_mktsegment"])


@query("""
select n_left, n_right, n_rows, round(abs(n_left - n_right) / n_rows, 6) as gap,
  abs(n_left - n_right) / n_rows > 0.1 as imbalanced
from (select count(*) filter (o_orderstatus = 'F') as n_left, count(*) filter (o_orderpriority = '1-URGENT'
  and o_orderstatus = 'O') as n_right, count(*) as n_rows from orders)
""")
def imbalance_flag(spark, sf):
    label = F.when(F.col("o_orderstatus") == "F", "Male").when(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"), "Female"
    )
    return rounded(op.imbalance_flag(table(spark, sf, "orders").select(label.alias("g")), "g"), "gap")


# --- binning, reshaping, joins


@query("""
with t as (select case when y > 0 and y <= 1 then 0 when y > 1 and y <= 3 then 1 when y > 3 and y <= 5 then 2
    when y > 5 and y <= 10 then 3 when y > 10 and y <= 20 then 4 end as ordinal
  from (select date_diff('day', o_orderdate, timestamp '2002-01-01') / 365.0 as y from orders)),
labels(ordinal, label) as (values (0, 'New'), (1, 'Growth'), (2, 'Established'), (3, 'Loyal'), (4, 'VIP'))
select ordinal::bigint as ordinal, label, (select count(*) from t where t.ordinal = labels.ordinal) as n,
  case when ordinal = 0 then 'Churn Risk' end as flag from labels
""")
def tenure_segments(spark, sf):
    years = fn.tenure_years_as_of(F.col("o_orderdate"), AS_OF)
    orders = table(spark, sf, "orders").select(years.alias("years"))
    counts = op.dense_counts(orders, fn.cut_ordinal(F.col("years"), TENURE_EDGES), TENURE_LABELS)
    return counts.withColumn("flag", fn.flag_first_segment(F.col("ordinal")))


@query("""
select o_orderpriority, round(avg(date_diff('day', o_orderdate, timestamp '2002-01-01') / 365.0), 6) as mean_tenure
from orders group by 1
""")
def tenure_as_of(spark, sf):
    years = fn.tenure_years_as_of(F.col("o_orderdate"), AS_OF).alias("years")
    orders = table(spark, sf, "orders").select("o_orderpriority", years)
    return rounded(op.mean_by(orders, "o_orderpriority", {"mean_tenure": "years"}), "mean_tenure")


@query("""
with o as (select floor(o_totalprice / 10000)::bigint as band, o_orderstatus from orders),
b as (select distinct band from o), s(o_orderstatus) as (values ('F'), ('O'), ('P'))
select band, band * 10000.0::double as lo, (band + 1) * 10000.0::double as hi,
  (band * 10000)::varchar || '-' || ((band + 1) * 10000)::varchar as band_label, o_orderstatus,
  (select count(*) from o where o.band = b.band and o.o_orderstatus = s.o_orderstatus) as n
from b, s
""")
def crosstab_band_priority(spark, sf):
    return op.band_crosstab(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", 10_000, STATUSES)


@query("""
select nation, segment, try_cast(v as double) as n from (
  unpivot (select c_nationkey::bigint as nation,
      case when c_nationkey = 3 then 'x' else (count(*) filter (c_mktsegment = 'AUTOMOBILE'))::varchar end as "AUTOMOBILE",
      (count(*) filter (c_mktsegment = 'BUILDING'))::varchar as "BUILDING",
      (count(*) filter (c_mktsegment = 'FURNITURE'))::varchar as "FURNITURE",
      (count(*) filter (c_mktsegment = 'HOUSEHOLD'))::varchar as "HOUSEHOLD",
      (count(*) filter (c_mktsegment = 'MACHINERY'))::varchar as "MACHINERY"
    from customer group by 1, c_nationkey)
  on "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY" into name segment value v)
where try_cast(v as double) is not null
""")
def melt_wide(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), "c_mktsegment")
    wide = op.crosstab_counts(customers, "nation", "c_mktsegment", SEGMENTS)
    bad = F.when(F.col("nation") == 3, "x").otherwise(F.col("AUTOMOBILE").cast("string"))
    long = op.melt(wide.withColumn("AUTOMOBILE", bad), "nation", "segment", "n")
    return op.drop_null(long.withColumn("n", fn.to_number(F.col("n"))), "n")


@query("""
with c as (select c_nationkey, count(*) as customers from customer group by 1),
s as (select s_nationkey, count(*) filter (s_acctbal < 0) as suppliers from supplier group by 1)
select c_nationkey::bigint as nation, customers, coalesce(suppliers, 0) as suppliers,
  round(customers / nullif(coalesce(suppliers, 0), 0), 6) as customers_per_supplier,
  round(coalesce(suppliers, 0) / nullif(customers, 0), 6) as suppliers_per_customer
from c left join s on c_nationkey = s_nationkey
""")
def ratio_columns(spark, sf):
    customers = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    suppliers = table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.count_if(F.col("s_acctbal") < 0).alias("suppliers")
    )
    both = op.join_dim(customers, suppliers, "c_nationkey", "s_nationkey").select(
        F.col("c_nationkey").cast("bigint").alias("nation"),
        "customers",
        F.coalesce("suppliers", F.lit(0)).cast("bigint").alias("suppliers"),
    )
    ratios = both.withColumns(
        {
            "customers_per_supplier": r(fn.ratio(F.col("customers"), F.col("suppliers"))),
            "suppliers_per_customer": r(fn.ratio(F.col("suppliers"), F.col("customers"))),
        }
    )
    return op.order_desc(ratios, "customers_per_supplier", "nation")


@query("""
with c as (select c_mktsegment, count(*) as active,
    case c_mktsegment when 'AUTOMOBILE' then 'North' when 'BUILDING' then 'South' when 'FURNITURE' then 'North'
      when 'HOUSEHOLD' then 'West' end as district from customer group by 1),
d(name, population) as (values ('North', 7000::bigint), ('South', 320::bigint))
select c_mktsegment, district, active, population, round_even(100 * (active / population), 2) as coverage_pct
from c left join d on district = name
""")
def coverage_join(spark, sf):
    mapping = {"AUTOMOBILE": "North", "BUILDING": "South", "FURNITURE": "North", "HOUSEHOLD": "West"}
    districts = src.inline_table(spark, [("North", 7000), ("South", 320)], "name string, population bigint")
    counts = op.value_counts(table(spark, sf, "customer"), "c_mktsegment", order=None, name="active")
    placed = counts.withColumn("district", op.map_lookup(F.col("c_mktsegment"), mapping))
    joined = op.join_dim(placed, districts, "district", "name", bounded=True)
    pct = fn.coverage_pct(F.col("active"), F.col("population")).alias("coverage_pct")
    table_ = joined.select("c_mktsegment", "district", "active", "population", pct)
    return op.order_desc(table_, "coverage_pct", "c_mktsegment")


# --- comparisons, sorts


@query("""
select p_brand, revenue, round(100 * revenue / sum(revenue) over (), 6) as percentage from (
  select p_brand, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue
  from lineitem join part on l_partkey = p_partkey group by 1)
""")
def share_of_total(spark, sf):
    per_part = op.sum_by(table(spark, sf, "lineitem"), "l_partkey", {"revenue": "l_extendedprice"}, money=True)
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    branded = per_part.join(parts, per_part.l_partkey == parts.p_partkey)
    brands = op.sum_by(branded, "p_brand", {"revenue": "revenue"}, money=True)
    return rounded(op.order_desc(op.share_of_total(brands, "revenue"), "revenue", "p_brand"), "percentage")


@query("""
select c_mktsegment, count(*) as n, count(*) = max(count(*)) over () as is_max from customer group by 1
""")
def flag_max(spark, sf):
    return op.flag_max(op.value_counts(table(spark, sf, "customer"), "c_mktsegment", order=None), "n")


@query("""
select order_year, round(mean_price, 6) as mean_price,
  round((mean_price / lag(mean_price) over (order by order_year) - 1) * 100, 6) as pct_change
from (select year(o_orderdate) as order_year, avg(o_totalprice) as mean_price from orders group by 1)
""")
def pct_change_yearly(spark, sf):
    yearly = op.mean_by(order_year(table(spark, sf, "orders")), "order_year", {"mean_price": "o_totalprice"})
    return rounded(op.pct_change(yearly, "order_year", "mean_price"), "mean_price", "pct_change")


@query("select p_brand, round(avg(p_retailprice), 6) as mean_price from part group by 1")
def order_asc_means(spark, sf):
    means = op.mean_by(table(spark, sf, "part"), "p_brand", {"mean_price": "p_retailprice"})
    return rounded(op.order_asc(means, "mean_price", "p_brand"), "mean_price")


@query("select c_custkey, c_name, c_acctbal from customer order by c_name limit 5")
def preview_sorted(spark, sf):
    return op.preview(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), 5, "c_name")


# --- statistics


@query("""
select c_mktsegment, count(*) as n, round(avg(b), 6) as mean,
  round(avg(b) - 1.96 * stddev_samp(b) / sqrt(count(*)), 6) as ci_low,
  round(avg(b) + 1.96 * stddev_samp(b) / sqrt(count(*)), 6) as ci_high
from (select c_mktsegment, c_acctbal as b from customer) group by 1
""")
def mean_ci_by_segment(spark, sf):
    return rounded(op.mean_ci_by(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"), "mean", "ci_low", "ci_high")


_POISSON = " ".join(
    f"when u < {sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1))!r} then {k}" for k in range(18)
)


@query(f"""
with b as (select c_mktsegment, ('0x' || substr(md5(c_custkey::varchar), 1, 13))::bigint % 512 as block,
    sum(c_acctbal) as s, count(*) as c from customer group by 1, 2),
w as (select block, rep, case {_POISSON} else 18 end as w from (
    select block, rep, ('0x' || substr(md5(block::varchar || ':' || rep::varchar), 1, 13))::bigint / 4503599627370496.0::double as u
    from (select range as block from range(512)), (select range as rep from range(1000)))),
m as (select c_mktsegment, rep, sum(w * s) / nullif(sum(w * c), 0) as m from b join w using (block) group by 1, 2),
q as (select c_mktsegment, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by 1)
select c_mktsegment, count(*) as n, round(avg(c_acctbal), 6) as mean, round(any_value(lo), 6) as ci_low,
  round(any_value(hi), 6) as ci_high from customer join q using (c_mktsegment) group by 1
""")
def mean_ci_bootstrap(spark, sf):
    customers = table(spark, sf, "customer")
    means = op.mean_ci_by(customers, "c_mktsegment", "c_acctbal", ci="bootstrap", row_key=["c_custkey"])
    return rounded(means, "mean", "ci_low", "ci_high")


_METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "with l as (select nullif(l_quantity, 50) as l_quantity, l_extendedprice, l_discount, l_tax from lineitem) "
    + " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 6) as corr from l"
        for a in _METRICS
        for b in _METRICS
    )
)
def corr_matrix(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_quantity", F.nullif(F.col("l_quantity"), F.lit(50.0)))
    return rounded(op.corr_matrix(lines, _METRICS), "corr")


@query("""
with s as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders),
g as (select o_totalprice as v, lo, hi, least(floor((o_totalprice - lo) * 30.0 / (hi - lo))::bigint, 29) as b from orders, s),
x as (select case when v < lo + b * ((hi - lo) / 30.0) then b - 1
    when b < 29 and v >= lo + (b + 1) * ((hi - lo) / 30.0) then b + 1 else b end as bin from g),
c as (select bin, count(*) as n from x group by 1)
select r.range::bigint as bin, round(lo + r.range * ((hi - lo) / 30.0), 6) as lo,
  round(lo + (r.range + 1) * ((hi - lo) / 30.0), 6) as hi, coalesce(n, 0)::bigint as n
from range(30) r cross join s left join c on c.bin = r.range
""")
def histogram_balance(spark, sf):
    return rounded(op.histogram(table(spark, sf, "orders"), "o_totalprice", 30), "lo", "hi")


@query("""
with s as (select count(*) as n, min(c_acctbal) as lo, (max(c_acctbal) - min(c_acctbal)) / 199.0 as step,
  stddev_samp(c_acctbal) * pow(count(*), -0.2) as h from customer)
select r.range::bigint as point, round(any_value(lo + r.range * step), 6) as x,
  round(sum(exp(-0.5 * pow((lo + r.range * step - c_acctbal) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 12) as density
from customer, s, range(200) r group by 1
""")
def kde_balance(spark, sf):
    density = op.kde(table(spark, sf, "customer"), "c_acctbal", 200)
    return density.select("point", r("x"), r("density", 12)).toDF("point", "x", "density")


@query("""
with v as (select c_acctbal as v from customer),
s as (select count(*) as n, min(v) as lo, (max(v) - min(v)) / 199 as step, stddev_samp(v) * pow(count(*), -0.2) as h from v),
a as (select (v - lo) / (h * sqrt(0.0008)) as place from v, s),
c as (select cell, sum(w) as w from (select floor(place) as cell, 1 - (place - floor(place)) as w from a
  union all select floor(place) + 1, place - floor(place) from a) group by cell),
g as (select lo + cell * (h * sqrt(0.0008)) as v, w from c, s)
select r.range::bigint as point, round(any_value(lo + r.range * step), 6) as x,
  round(sum(w * exp(-0.5 * pow((lo + r.range * step - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 12) as density
from g, s, range(200) r group by 1
""")
def kde_binned(spark, sf):
    density = op.kde(table(spark, sf, "customer"), "c_acctbal", 200, method="binned", error=1e-4)
    return density.select("point", F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


@query("""
with o as (select o_orderpriority, o_totalprice as v from orders),
q as (select o_orderpriority, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
  quantile_cont(v, 0.75) as q3 from o group by 1)
select o.o_orderpriority, count(*) as n, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median,
  round(any_value(q3), 6) as q3,
  round(least(min(v) filter (v >= q1 - 1.5 * (q3 - q1)), any_value(q1)), 6) as whisker_low,
  round(greatest(max(v) filter (v <= q3 + 1.5 * (q3 - q1)), any_value(q3)), 6) as whisker_high,
  count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_outliers
from o join q on o.o_orderpriority = q.o_orderpriority group by 1
""")
def box_stats(spark, sf):
    stats = op.box_stats(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(stats, "q1", "median", "q3", "whisker_low", "whisker_high")


_FENCES = """
with o as (select {group} as g, {value} as v from {table}),
q as (select g, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from o group by 1)
"""


def _large_boxes(table_: str, group: str, value: str) -> str:
    return _FENCES.format(group=group, value=value, table=table_) + f"""
select o.g as {group}, count(*) as n, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median,
  round(any_value(q3), 6) as q3,
  round(least(min(v) filter (v >= q1 - 1.5 * (q3 - q1)), any_value(q1)), 6) as whisker_low,
  round(greatest(max(v) filter (v <= q3 + 1.5 * (q3 - q1)), any_value(q3)), 6) as whisker_high,
  count(*) filter (v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as n_outliers
from o join q on o.g = q.g group by 1
"""


@query(_large_boxes("lineitem", "l_returnflag", "l_extendedprice"))
def box_stats_large_groups(spark, sf):
    """Groups above the size that one task gathers at the scale of the check."""
    stats = op.box_stats(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", gather=1_000)
    return rounded(stats, "q1", "median", "q3", "whisker_low", "whisker_high")


@query("""
with o as (select l_linestatus, exp(l_quantity * 10 + l_discount) as v from lineitem)
select l_linestatus, count(*) as n, round(ln(quantile_cont(v, 0.25)), 6) as q1, round(ln(quantile_cont(v, 0.5)), 6) as median,
  round(ln(quantile_cont(v, 0.999)), 6) as far from o group by 1
""")
def quantiles_heavy_tail(spark, sf):
    """Values over two hundred orders of magnitude, many of them tied."""
    lines = table(spark, sf, "lineitem").withColumn("v", F.exp(F.col("l_quantity") * 10 + F.col("l_discount")))
    q = op.quantiles_by(lines, "l_linestatus", "v", (0.25, 0.5, 0.999), gather=1_000)
    names = ("q1", "median", "far")
    return q.select("l_linestatus", "n", *[r(F.ln(F.col("q")[i])).alias(x) for i, x in enumerate(names)])


@query(
    _FENCES.format(group="o_orderpriority", value="power(o_totalprice, 2)", table="orders")
    + """select o.g as o_orderpriority, round(v, 3) as value from o join q on o.g = q.g
where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)"""
)
def box_outliers(spark, sf):
    orders = table(spark, sf, "orders").withColumn("squared", F.pow("o_totalprice", F.lit(2.0)))
    return rounded(op.box_outliers(orders, "o_orderpriority", "squared"), "value", places=3)


@query("""
with s as (select count(*) as n, min(c_acctbal) as lo, max(c_acctbal) as hi, (max(c_acctbal) - min(c_acctbal)) / 199.0 as step,
  stddev_samp(c_acctbal) * pow(count(*), -0.2) as h from customer),
g as (select least(floor((c_acctbal - lo) * 30.0 / (hi - lo))::bigint, 29) as bin from customer, s),
c as (select bin, count(*) as n from g group by 1)
select 'bin' as kind, r.range::bigint as at, round(lo + r.range * ((hi - lo) / 30.0), 6) as lo,
  round(lo + (r.range + 1) * ((hi - lo) / 30.0), 6) as hi, coalesce(c.n, 0)::double as value
from range(30) r cross join s left join c on c.bin = r.range
union all
select 'curve', r.range::bigint, round(any_value(lo + r.range * step), 6), round(any_value(lo + r.range * step), 6),
  round(sum(exp(-0.5 * pow((lo + r.range * step - c_acctbal) / h, 2))) / any_value(h * sqrt(2 * pi())) * any_value((hi - lo) / 30.0), 6)
from customer, s, range(200) r group by r.range
""")
def histogram_with_density(spark, sf):
    chart = op.histogram_with_density(table(spark, sf, "customer"), "c_acctbal")
    return rounded(chart, "lo", "hi", "value")


@query("select c_custkey, c_mktsegment, 'Low' as attrition_risk from customer")
def ensure_column(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return op.ensure_column(op.ensure_column(customers, "attrition_risk", "Low"), "c_mktsegment", "unused")


@query("""
with o as (select o_custkey, o_totalprice as v from orders)
select o_custkey, count(*) as n, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as median,
  round(quantile_cont(v, 0.75), 6) as q3 from o group by 1
""")
def quartiles_many_groups(spark, sf):
    q = op.quantiles_by(table(spark, sf, "orders"), "o_custkey", "o_totalprice")
    return q.select("o_custkey", "n", *[r(F.col("q")[i]).alias(x) for i, x in enumerate(("q1", "median", "q3"))])


@query("""
select regr_count(y, x)::bigint as n, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept,
  round(regr_r2(y, x), 6) as r2, round(regr_avgx(y, x), 6) as mean_x, round(regr_sxx(y, x), 3) as sxx,
  round(regr_syy(y, x) / 1e6, 3) as syy, round(regr_sxy(y, x) / 1e3, 3) as sxy, min(x) as min_x, max(x) as max_x,
  round(sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (regr_count(y, x) - 2)), 6) as residual_sd
from (select l_quantity as x, nullif(l_extendedprice, 900.0) as y from lineitem) where y is not null
""")
def linreg(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("x"), F.nullif(F.col("l_extendedprice"), F.lit(900.0)).alias("y")
    )
    fit = op.linreg(lines, "x", "y")
    return fit.select(
        "n",
        *[r(c).alias(c) for c in ("slope", "intercept", "r2", "mean_x", "residual_sd")],
        r("sxx", 3).alias("sxx"),
        F.round(F.col("syy") / 1e6, 3).alias("syy"),
        F.round(F.col("sxy") / 1e3, 3).alias("sxy"),
        "min_x",
        "max_x",
    )


@query("""
with f as (select count(*) as n, regr_slope(y, x) as b, regr_intercept(y, x) as a, avg(x) as mx, regr_sxx(y, x) as sxx,
  sqrt((regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / (count(*) - 2)) as s, min(x) as lo, max(x) as hi
  from (select l_quantity as x, l_extendedprice as y from lineitem)),
p as (select r.range::bigint as point, lo + r.range * ((hi - lo) / 99.0) as x, * from f, range(100) r)
select point, round(x, 4) as x, round(a + b * x, 4) as y_hat,
  round(a + b * x - 1.96 * s * sqrt(1.0 / n + pow(x - mx, 2) / sxx), 4) as band_low,
  round(a + b * x + 1.96 * s * sqrt(1.0 / n + pow(x - mx, 2) / sxx), 4) as band_high from p
""")
def linreg_band(spark, sf):
    band = op.linreg_band(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(band, "x", "y_hat", "band_low", "band_high", places=4)


@query("""
with lines as (select l_orderkey, l_linenumber,
    case l_returnflag when 'N' then 1 when 'A' then l_orderkey else nullif(l_orderkey, 7) end as order_ref from lineitem)
select l.*, o.o_orderkey, o.o_custkey, o.o_orderpriority from lines l left join orders o on l.order_ref = o.o_orderkey
""")
def join_dim_hot_keys(spark, sf):
    flag = F.col("l_returnflag")
    ref = F.when(flag == "N", 1).when(flag == "A", F.col("l_orderkey")).otherwise(F.nullif("l_orderkey", F.lit(7)))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ref.cast("long").alias("order_ref"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return op.join_dim_hot_keys(lines, orders, "order_ref", "o_orderkey")


# --- points


@query("""
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag from lineitem
""")
def scatter_points(spark, sf):
    return op.scatter_points(
        table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", ["l_orderkey", "l_linenumber"]
    )


@query("""
select l_returnflag, floor(l_quantity / 5)::bigint as x_cell, floor(l_extendedprice / 5000)::bigint as y_cell,
  count(*) as n from lineitem group by 1, 2, 3
""")
def scatter_grid(spark, sf):
    return op.scatter_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 5, 5000, "l_returnflag")


def _positions(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding")[0].cast("double").alias("lat"),
        F.col("embedding")[1].cast("double").alias("lon"),
    )


@query("""
select vec_id, round(embedding[1]::double, 6) as lat, round(embedding[2]::double, 6) as lon,
  'Vector ' || vec_id || ' (label ' || coalesce(nullif(label, 3)::varchar, 'nan') || ')' as popup,
  case when nullif(label, 3) = 1 then 'blue' else 'gray' end as marker from embeddings
""")
def map_points(spark, sf):
    label = F.nullif(F.col("label"), F.lit(3))
    points = op.map_points(
        _positions(spark, sf),
        "lat",
        "lon",
        {
            "vec_id": F.col("vec_id"),
            "popup": fn.describe_row(["Vector ", F.col("vec_id"), " (label ", label, ")"]),
            "marker": fn.flag_value(label.cast("string"), "1"),
        },
    )
    return rounded(points, "lat", "lon")


@query("""
select floor(embedding[1]::double / 0.25)::bigint as x_cell, floor(embedding[2]::double / 0.25)::bigint as y_cell,
  count(*) as n, round(avg(embedding[1]::double), 6) as x_mean, round(avg(embedding[2]::double), 6) as y_mean
from embeddings group by 1, 2
""")
def point_clusters(spark, sf):
    return rounded(op.group_points(_positions(spark, sf), "lat", "lon", 0.25), "x_mean", "y_mean")


@query("""
with placed as (select embedding[1]::double as x, embedding[2]::double as y, unnest(range(0, 13)) as level from embeddings),
cells as (select level, least(floor((x + 4) / 8 * 2 ** level), 2 ** level - 1)::bigint as x_cell,
    least(floor((y + 4) / 8 * 2 ** level), 2 ** level - 1)::bigint as y_cell, x, y
  from placed where x between -4 and 4 and y between -4 and 4)
select level::int as level, array_to_string(list_transform(range(level - 1, -1, -1),
    lambda i: ((x_cell >> i) & 1) + 2 * ((y_cell >> i) & 1)), '') as quadkey,
  count(*) as n, round(avg(x), 6) as x_mean, round(avg(y), 6) as y_mean from cells group by level, x_cell, y_cell
""")
def zoom_clusters(spark, sf):
    return rounded(op.zoom_clusters(_positions(spark, sf), "lat", "lon", 0, 12, (-4.0, 4.0, -4.0, 4.0)), "x_mean", "y_mean")


@query("""
with placed as (select l_quantity::double as x, l_extendedprice::double as y, row_number() over () as id from lineitem),
cells as (select id, level, least(floor(x / 64 * 2 ** level), 2 ** level - 1)::bigint as x_cell,
    least(floor(y / 131072 * 2 ** level), 2 ** level - 1)::bigint as y_cell
  from placed, range(0, 9) as r(level) where x between 0 and 64 and y between 0 and 131072),
counted as (select *, count(*) over (partition by level, x_cell, y_cell) as n from cells),
leaves as (select id, min(level) as level from counted where n <= 100 or level = 8 group by id)
select level::int as level, x_cell, y_cell, count(*) as n from counted join leaves using (id, level) group by 1, 2, 3
""")
def adaptive_grid(spark, sf):
    lines = table(spark, sf, "lineitem")
    return op.adaptive_grid(lines, "l_quantity", "l_extendedprice", 100, 8, (0.0, 64.0, 0.0, 131072.0))


# --- headers, staging and export


@query("""
select p_partkey as part_id, p_retailprice as retail_price_ghs, p_size as customer_satisfaction, p_brand as brand_pct
from part
""")
def normalize_headers(spark, sf):
    headed = table(spark, sf, "part").select(
        F.col("p_partkey").alias("Part ID"),
        F.col("p_retailprice").alias("Retail Price (GHS)"),
        F.col("p_size").alias("Customer Satisfaction (5.0)"),
        F.col("p_brand").alias("brand_(%)"),
    )
    return src.normalize_headers(headed, {"Customer Satisfaction (5.0)": "customer_satisfaction"})


def shared_folder(spark, name: str) -> str:
    """A new folder beside the session's checkpoints, where every executor can write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tillgrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("""
select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as c_mktsegment, c_acctbal
from customer
""")
def export_roundtrip(spark, sf):
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("c_mktsegment")
    customers = table(spark, sf, "customer").select("c_custkey", segment, "c_acctbal")
    path = src.export_csv(customers, shared_folder(spark, "export"))
    dataset = src.Dataset(
        "customers",
        (
            src.Field("c_custkey", "c_custkey", "bigint"),
            src.Field("c_mktsegment", "c_mktsegment"),
            src.Field("c_acctbal", "c_acctbal", "double"),
        ),
    )
    return src.read_table(spark, path, dataset)


@query("""
select o_orderkey, o_totalprice, year(o_orderdate) as order_year from orders where year(o_orderdate) in (1996, 1999)
""")
def staged_year_filter(spark, sf):
    orders = order_year(table(spark, sf, "orders")).select("o_orderkey", "o_totalprice", "order_year")
    staged = src.stage(orders, shared_folder(spark, "stage"), "order_year")
    return op.filter_in(staged, {"order_year": [1996, 1999]})


# --- any set of periods from staged sketches and bitmaps


@query("""
select o_orderpriority, count(*) as n, round(quantile_cont(o_totalprice, 0.25), 6) as q1,
  round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as q3
from orders where year(o_orderdate) in (1994, 1995, 1997) group by 1
""")
def quartiles_of_years(spark, sf):
    """Sketches are staged once for all years; three of them are merged."""
    years = [1994, 1995, 1997]
    orders = order_year(table(spark, sf, "orders"))
    made = op.quantile_sketches(orders, "order_year", "o_orderpriority", "o_totalprice")
    sketches = src.stage(made, shared_folder(spark, "sketches"), "order_year")
    of = op.filter_in(sketches, {"order_year": years})
    found = op.quantiles_from_sketches(of, op.filter_in(orders, {"order_year": years}), "o_orderpriority", "o_totalprice")
    quartiles = [F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    return found.select("o_orderpriority", "n", *quartiles)


@query("""
with f as (select o_custkey, year(o_orderdate) as order_year, min(year(o_orderdate)) over (partition by o_custkey) as first
  from orders)
select order_year, count(distinct o_custkey) as n, count(distinct o_custkey) filter (first = order_year) as n_new,
  (select count(distinct o_custkey) from f g where g.order_year <= f.order_year) as n_so_far
from f group by 1
""")
def customers_by_year_bitmaps(spark, sf):
    orders = order_year(table(spark, sf, "orders"))
    bitmaps = src.stage(op.id_bitmaps(orders, "order_year", "o_custkey"), shared_folder(spark, "bitmaps"), "order_year")
    return op.new_by_period(bitmaps, "order_year")


@query("""
select count(distinct o_custkey) as n from orders where year(o_orderdate) between 1993 and 1995
""")
def customers_of_years_bitmaps(spark, sf):
    orders = order_year(table(spark, sf, "orders"))
    bitmaps = src.stage(op.id_bitmaps(orders, "order_year", "o_custkey"), shared_folder(spark, "bitmaps"), "order_year")
    return op.distinct_of_bitmaps(op.filter_in(bitmaps, {"order_year": [1993, 1994, 1995]}))


# --- quarantine and incremental staging


def _messy_orders(spark, sf) -> str:
    """Orders as CSV; some prices are no number, some have a third decimal, some are missing."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    said = F.format_string("%.2f", price)
    messy = table(spark, sf, "orders").select(
        key.cast("string").alias("Order Key"),
        F.when(key % 50 == 1, F.lit("about 10"))
        .when(key % 50 == 2, F.concat(said, F.lit("5")))
        .when(key % 50 == 3, F.lit("n/a"))
        .otherwise(said)
        .alias("Total Price"),
        F.when(key % 60 == 7, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Order Date"),
    )
    return src.export_csv(messy, shared_folder(spark, "messy"))


_ORDERS = src.Dataset(
    "orders",
    (
        src.Field("Order Key", "order_key", "bigint"),
        src.Field("Total Price", "total_price", "decimal(18,2)"),
        src.Field("Order Date", "order_date", "timestamp_ntz"),
    ),
)
_GOOD = "o_orderkey % 50 not in (1, 2) and o_orderkey % 60 <> 7"


@query(f"""
select o_orderkey as order_key, case when o_orderkey % 50 <> 3 then o_totalprice::decimal(18,2) end::double as total_price,
  year(o_orderdate) as order_year
from orders where {_GOOD}
""")
def quarantine_good(spark, sf):
    read = src.read_quarantined(spark, _messy_orders(spark, sf), _ORDERS, date_format="yyyy-MM-dd")
    return read.good.select(
        "order_key", F.col("total_price").cast("double").alias("total_price"), F.year("order_date").cast("bigint").alias("order_year")
    )


@query("""
select 'total_price' as field, 'not decimal(18,2)' as reason, count(*) as n, count(*) filter (o_orderkey % 50 = 1) as n_words
from orders where o_orderkey % 50 in (1, 2)
union all select 'order_date', 'not timestamp_ntz', count(*), 0 from orders where o_orderkey % 60 = 7
""")
def quarantine_reasons(spark, sf):
    rejects = src.read_quarantined(spark, _messy_orders(spark, sf), _ORDERS, date_format="yyyy-MM-dd").rejects
    return rejects.groupBy("field", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("field") == "total_price") & F.col("line").contains("about 10")).alias("n_words")
    )


@query("""
select o_orderkey, case when o_orderpriority = '1-URGENT' then o_totalprice + 1 else o_totalprice end as o_totalprice,
  year(o_orderdate) as order_year
from orders where o_orderpriority <> '5-LOW'
""")
def incremental_stage(spark, sf):
    """Staged from one file per priority; then one file changes, one goes and one comes."""
    orders = order_year(table(spark, sf, "orders")).select("o_orderkey", "o_totalprice", "order_year", "o_orderpriority")
    folder, staged = shared_folder(spark, "landing"), shared_folder(spark, "staged")
    schema = orders.drop("o_orderpriority").schema

    def land(name: str, rows, mode: str = "overwrite") -> None:
        rows.drop("o_orderpriority").write.mode(mode).parquet(f"{folder}/{name}")

    def read(paths: list[str]):
        return spark.read.schema(schema).parquet(*paths)

    for name in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"):
        land(name, orders.where(F.col("o_orderpriority") == name))
    src.stage_changes(spark, f"{folder}/*", read, staged, "order_year")
    land("1-URGENT", orders.where(F.col("o_orderpriority") == "1-URGENT").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    land("5-LOW", orders.limit(0))
    land("4-NOT SPECIFIED", orders.where(F.col("o_orderpriority").startswith("4")))
    return src.stage_changes(spark, f"{folder}/*", read, staged, "order_year").select("o_orderkey", "o_totalprice", "order_year")
