"""Market tables: ages, industries, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid import operators as op
from tillgrid.functions import to_number
from tillgrid.plans.panels import Panels
from tillgrid.sources import export_csv


def market_insights(ages: DataFrame, industries: DataFrame) -> DataFrame:
    """Most populated age group and largest industry."""
    age = op.arg_max(ages, "age_group", "total").withColumn("metric", F.lit("largest_age_group"))
    industry = op.arg_max(industries, "industry", "total_population").withColumn(
        "metric", F.lit("largest_industry")
    )
    cols = ["metric", F.col("label"), F.col("value").cast("double").alias("value")]
    return age.select(*cols).union(industry.select(*cols))


def industry_by_region(wide: DataFrame, region: str = "region") -> DataFrame:
    """Wide region by industry matrix to (region, industry, count); cells that are no number go."""
    long = op.melt(wide, region, "industry", "count")
    return op.drop_null(long.withColumn("count", to_number(F.col("count").cast("string"))), "count")


def _header(df: DataFrame, name: str) -> str:
    """The frame's own spelling of a column, found as Spark finds columns."""
    found = [c for c in df.columns if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name} among {df.columns}")
    return found[0]


def market_report(
    ages: DataFrame,
    industries: DataFrame,
    regions: DataFrame,
    region_industry: DataFrame,
    industry: str,
    region: str = "region",
) -> Panels:
    shown = industries.select("industry", "total_population")
    panels = {
        "industry_options": lambda: op.domain(industries, "industry", sort=False),
        "age_means": lambda: op.mean_ci_by(ages, "age_group", "total"),
        "age_percentage": lambda: op.share_of_total(ages, "total").select("age_group", "percentage"),
        "industry_means": lambda: op.mean_ci_by(industries, "industry", "total_population"),
        "selected_industry": lambda: op.lookup_one(industries, "industry", industry, "total_population"),
        "industry_shares": lambda: op.order_desc(
            op.share_of_total(shown, "total_population"), "total_population", "industry"
        ),
        "insights": lambda: market_insights(ages, industries),
    }
    if regions.columns:
        panels["region_preview"] = lambda: op.preview(regions, 5, regions.columns)
    # The frame is without columns where its bundle could not be loaded; then there is nothing to unpivot.
    if region_industry.columns:
        region = _header(region_industry, region)
        panels["region_industry_preview"] = lambda: op.preview(
            region_industry, 5, [region, *(c for c in region_industry.columns if c != region)]
        )
        panels["industry_by_region"] = lambda: op.mean_ci_by(
            industry_by_region(region_industry, region), [region, "industry"], "count"
        )
    return Panels(panels)


def export_ages(ages: DataFrame, path: str) -> str:
    """The age table with its percentage column as CSV."""
    return export_csv(op.share_of_total(ages, "total"), path)
