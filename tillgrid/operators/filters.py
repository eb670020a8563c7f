"""Row filters, lookups, option lists and column guards."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.functions import is_in
from tillgrid.operators.support import column, name_list


def filter_in(df: DataFrame, wanted: Mapping[str, Iterable[Any]]) -> DataFrame:
    """Rows whose every named column is in its list; a None in a list matches NULL."""
    for name, values in wanted.items():
        df = df.where(is_in(column(name), values))
    return df


def filter_years(df: DataFrame, date: str, years: Iterable[int | None]) -> DataFrame:
    """Rows whose date lies in one of the years, as ranges of the date itself, which reach the scan.

    Neighbouring years are one range; a None matches NULL.
    """
    years = list(years)
    keep = column(date).isNull() if None in years else F.lit(False)
    known = sorted({int(y) for y in years if y is not None})
    starts = [y for y in known if y - 1 not in known]
    for start in starts:
        end = start
        while end in known:
            end += 1
        low, high = (F.lit(f"{y:04d}-01-01 00:00:00").cast("timestamp_ntz") for y in (start, end))
        keep = keep | ((column(date) >= low) & (column(date) < high))
    return df.where(keep)


def filter_eq_optional(df: DataFrame, wanted: Mapping[str, Any], skip: Any = "All") -> DataFrame:
    """Equality filters, each left out when its value is ``skip``."""
    for name, value in wanted.items():
        if value != skip:
            df = df.where(column(name) == F.lit(value))
    return df


def lookup_one(df: DataFrame, key: str, value: Any, out: str, order_by: str | None = None) -> DataFrame:
    """The row of one key with its value: at most one row, none when the key is absent."""
    order = [column(order_by).asc_nulls_last()] if order_by else []
    found = df.where(column(key) == F.lit(value)).orderBy(*order, column(out).asc_nulls_last())
    return found.select(column(key), column(out)).limit(1)


def drop_null(df: DataFrame, cols: str | Iterable[str]) -> DataFrame:
    return df.na.drop(subset=name_list(cols))


def domain(df: DataFrame, col: str, sort: bool = True, drop_null: bool = True) -> DataFrame:
    """Distinct values of a column."""
    values = df.select(column(col))
    if drop_null:
        values = values.where(column(col).isNotNull())
    values = values.distinct()
    return values.orderBy(column(col).asc_nulls_last()) if sort else values


def options_with_all(df: DataFrame, col: str, all_label: str = "All") -> DataFrame:
    """Option list of a filter: the "All" entry, then the sorted values as text."""
    values = domain(df, col, sort=False).select(
        F.lit(1).cast("bigint").alias("option_group"), column(col).cast("string").alias("option")
    )
    every = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(0).cast("bigint").alias("option_group"), F.lit(all_label).alias("option")
    )
    return every.union(values).orderBy("option_group", "option")


def ensure_column(df: DataFrame, name: str, default: Any, dtype: str = "string") -> DataFrame:
    """Add a constant column when the frame has none of that name."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default).cast(dtype))
