"""Comparisons with the whole frame or the previous period.

Totals and maxima are scalar subqueries, so no window pulls all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillgrid.functions import ratio
from tillgrid.operators.support import column, scalar_of


def share_of_total(df: DataFrame, col: str, name: str = "percentage") -> DataFrame:
    """Value as a percentage of the column's sum."""
    total = scalar_of(df, F.sum(column(col)))
    return df.withColumn(name, ratio(column(col), total) * F.lit(100.0))


def flag_max(df: DataFrame, col: str, name: str = "is_max") -> DataFrame:
    """Marks every row equal to the maximum."""
    return df.withColumn(name, F.coalesce(column(col) == scalar_of(df, F.max(column(col))), F.lit(False)))


def pct_change(periods: DataFrame, order: str, value: str, name: str = "pct_change") -> DataFrame:
    """Change against the previous row of a per-period aggregate, in percent.

    The window has no partition key: give it one row per period, never raw rows.
    """
    before = F.lag(column(value)).over(Window.orderBy(column(order)))
    return periods.withColumn(name, (ratio(column(value), before) - F.lit(1.0)) * F.lit(100.0))
