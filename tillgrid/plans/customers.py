"""Customer overview, segments and acquisition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid import operators as op
from tillgrid.functions import (
    cut_ordinal,
    flag_below,
    flag_first_segment,
    ratio,
    tenure_years_from_months,
    year_of,
)
from tillgrid.plans.panels import Panels
from tillgrid.plans.shared import scope, then

# Tenure segment edges in years, and their labels.
TENURE_EDGES = (0, 1, 3, 5, 10, 20)
TENURE_LABELS = (
    "New (<1yr)",
    "Growth (1-3yr)",
    "Established (3-5yr)",
    "Loyal (5-10yr)",
    "VIP (>10yr)",
)


def prepare_customers(customers: DataFrame) -> DataFrame:
    return customers.withColumns(
        {
            "tenure_years": tenure_years_from_months(F.col("tenure_months")),
            "year_joined": year_of(F.col("customer_since")),
            "segment": cut_ordinal(tenure_years_from_months(F.col("tenure_months")), TENURE_EDGES),
        }
    )


def customer_insights(customers: DataFrame) -> DataFrame:
    """Lowest sector, largest region, first-year share, and the peak year with its change.

    One scan counts every value of the four columns and all rows; the lines come from those counts.
    """
    dims = ["employment_sector", "region", "year_joined", "segment"]
    texts = customers.select(*[F.col(d).cast("string").alias(d) for d in dims])
    counted = texts.groupingSets([*([F.col(d)] for d in dims), []], *map(F.col, dims)).agg(
        *[F.grouping(d).alias(f"no_{d}") for d in dims], F.count(F.lit(1)).alias("n")
    )

    def known(dim: str) -> Column:
        return (F.col(f"no_{dim}") == 0) & F.col(dim).isNotNull()

    def total(dim: str) -> Column:
        return F.sum(F.when(known(dim), F.col("n")))

    def extreme(dim: str, sign: int) -> Column:
        return F.min(F.when(known(dim), F.struct((F.col("n") * sign).alias("n"), F.col(dim).alias("label"))))

    all_rows = F.sum(F.when(reduce(lambda a, b: a & b, [F.col(f"no_{d}") == 1 for d in dims]), F.col("n")))
    first = F.coalesce(F.sum(F.when(known("segment") & (F.col("segment") == "0"), F.col("n"))), F.lit(0))
    year = F.struct(F.col("year_joined").cast("int").alias("year"), "n")
    row = counted.agg(
        extreme("employment_sector", 1).alias("sector"),
        total("employment_sector").alias("sectors"),
        extreme("region", -1).alias("region"),
        total("region").alias("regions"),
        ratio(first * F.lit(100.0), all_rows).alias("first"),
        F.array_sort(F.collect_list(F.when(known("year_joined"), year))).alias("years"),
    )
    most = F.array_max(F.transform("years", lambda y: y["n"]))
    place = F.array_position(F.transform("years", lambda y: y["n"]), most).cast("int")
    row = row.withColumn("peak", F.try_element_at("years", F.nullif(place, F.lit(0))))
    row = row.withColumn("before", F.when(place > 1, F.get("years", place - 2)))
    change = (ratio(F.col("peak.n"), F.col("before.n")) - F.lit(1.0)) * F.lit(100.0)

    def line(metric: str, label: Column, value: Column, shown: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            label.cast("string").alias("label"),
            value.cast("double").alias("value"),
            shown.alias("shown"),
        )

    sector, region, peak = F.col("sector"), F.col("region"), F.col("peak")
    lines = [
        line("lowest_sector_share", sector["label"], ratio(sector["n"] * F.lit(100.0), F.col("sectors")), sector.isNotNull()),
        line("largest_region_share", region["label"], ratio(region["n"] * F.lit(-100.0), F.col("regions")), region.isNotNull()),
        line("first_year_share", F.lit(TENURE_LABELS[0]), F.col("first"), F.lit(True)),
        line("peak_year_customers", peak["year"], peak["n"], peak.isNotNull()),
        line("peak_year_change", peak["year"], change, peak.isNotNull()),
    ]
    return row.select(F.inline(F.array(*lines))).where("shown").drop("shown")


def customers_report(
    customers: DataFrame,
    untapped_below: float = 10,
    tenure_cell: float = 1,
    income_cell: float = 500,
    shared: bool = False,
) -> Panels:
    """Panels of a ``prepare_customers`` frame; those on income and age bins need their columns.

    With ``shared`` the grouped panels come from one scan.
    """
    every = scope(customers, shared)
    shares = every.ask(op.value_shares, "employment_sector")
    regions = every.ask(op.value_counts, "region", order=None)
    joined = every.ask(op.value_counts, "year_joined", order=None)

    def sectors() -> DataFrame:
        return shares().withColumn("flag", flag_below(F.col("share"), untapped_below))

    def segments() -> DataFrame:
        dense = op.dense_counts(customers, F.col("segment"), TENURE_LABELS)
        return dense.withColumn("flag", flag_first_segment(F.col("ordinal")))

    panels = {
        "growth": lambda: op.annual_growth_avg(customers, "customer_id", "customer_since"),
        "kpis": lambda: op.kpis(
            customers,
            {
                "n_rows": F.count(F.lit(1)),
                "n_customers": op.distinct_count(F.col("customer_id")),
                "mean_tenure": F.avg("tenure_years"),
            },
        ),
        "sector_penetration": lambda: op.order_asc(sectors(), "share", "employment_sector"),
        "regions": lambda: op.order_desc(op.flag_max(regions(), "n"), "n", "region"),
        "strongest_region": then(regions, op.arg_max, "region", "n"),
        "gender": every.ask(op.value_shares, "gender"),
        "gender_balance": every.ask(op.imbalance_flag, "gender"),
        "segments": segments,
        "acquisition": then(joined, op.order_by_key, "year_joined"),
        "peak_year": then(joined, op.arg_max, "year_joined", "n"),
        "insights": lambda: customer_insights(customers),
    }
    if "income" in customers.columns:
        panels |= {
            "income_fit": lambda: op.linreg(customers, "tenure_years", "income"),
            "income_band": lambda: op.linreg_band(customers, "tenure_years", "income"),
            "income_points": lambda: op.scatter_points(customers, "tenure_years", "income"),
            "income_grid": lambda: op.scatter_grid(customers, "tenure_years", "income", tenure_cell, income_cell),
        }
    if "age_binned" in customers.columns:
        panels["age_bins"] = every.ask(op.value_counts, "age_binned", order="key")
    return Panels(panels)
