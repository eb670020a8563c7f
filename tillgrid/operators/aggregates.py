"""Counts, sums, means, key figures, cross tables and largest labels.

All of them are partial-then-final aggregates: a key that holds a third of the rows is cut to
one row per task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillgrid.functions import band_high, band_label, band_low, cut_width, money_sum, ratio, round_even
from tillgrid.operators.support import column, name_list, scalar_of, with_keys


def value_counts(
    df: DataFrame,
    keys: str | Iterable[str],
    order: str | None = "count",
    keep_null_key: bool = False,
    name: str = "n",
) -> DataFrame:
    """Rows per value, or per combination of values, without nulls.

    ``order`` is ``count`` (largest first, ties by value), ``key`` or None.
    """
    keys = name_list(keys)
    kept = with_keys(df, keys, keep_null_key)
    return ordered_counts(kept.groupBy(*map(column, keys)).agg(F.count(F.lit(1)).alias(name)), keys, order, name)


def ordered_counts(counts: DataFrame, keys: Sequence[str], order: str | None, name: str) -> DataFrame:
    by_key = [column(k).asc_nulls_last() for k in keys]
    if order == "count":
        return counts.orderBy(column(name).desc(), *by_key)
    if order == "key":
        return counts.orderBy(*by_key)
    return counts


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Counts with their percentage of the non-null rows, largest first."""
    return shares_of_counts(value_counts(df, col, order=None), col)


def shares_of_counts(counts: DataFrame, col: str) -> DataFrame:
    total = scalar_of(counts, F.sum("n"))
    shares = counts.withColumn("share", ratio(F.col("n") * F.lit(100.0), total))
    return shares.orderBy(F.col("n").desc(), column(col))


def profile_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Value counts of many columns in one scan: (dimension, value, n)."""
    texts = df.select(*[column(c).cast("string").alias(c) for c in cols])
    sets = [[column(c)] for c in cols]
    # grouping(c) is 0 in the set of column c: the one column it did not roll up.
    own = [F.when(F.grouping(column(c)) == 0, F.lit(c)) for c in cols]
    value = F.coalesce(*[column(c) for c in cols])
    counts = texts.groupingSets(sets, *[column(c) for c in cols]).agg(
        F.coalesce(*own).alias("dimension"), F.count(F.lit(1)).alias("n")
    )
    return counts.select("dimension", value.alias("value"), "n").where(F.col("value").isNotNull())


def flag_matrix(df: DataFrame, cols: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """Counts of each value in each flag column: one row per column, absent values 0.

    All columns are counted in one scan. Give ``values`` to spare the pass that finds them.
    """
    texts = df.select(*[column(c).cast("string").alias(c) for c in cols])
    long = texts.unpivot([], list(cols), "flag", "value")
    if values is None:
        values = pivot_values(long, "value")
    # Null cells are counted under no value but keep the row of an all-null column.
    wide = long.groupBy("flag").pivot("value", list(values))
    return wide.agg(F.count(F.col("value"))).na.fill(0)


def pivot_values(df: DataFrame, col: str) -> list:
    """Sorted distinct values for a pivot, refused above Spark's own limit."""
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = df.select(column(col)).where(column(col).isNotNull()).distinct().limit(limit + 1)
    values = sorted(r[0] for r in found.collect())
    if len(values) > limit:
        raise ValueError(f"more than {limit} values in {col!r}: too many columns for a pivot")
    return values


def _sum_of(df: DataFrame, name: str, money: bool) -> Column:
    dtype = df.schema[name].dataType
    if money and isinstance(dtype, (T.DoubleType, T.FloatType)):
        total = money_sum(column(name))
    elif isinstance(dtype, T.DecimalType):
        total = F.sum(column(name)).cast("double")
    else:
        total = F.sum(column(name))
    # An all-null group sums to zero.
    return F.coalesce(total, F.lit(0).cast("bigint") if isinstance(dtype, T.IntegralType) else F.lit(0.0))


def sum_by(
    df: DataFrame,
    keys: str | Iterable[str],
    sums: Mapping[str, str],
    rounding: int | None = None,
    money: bool = False,
    keep_null_key: bool = False,
) -> DataFrame:
    """Sums per key, ``sums`` maps output name to column.

    ``money`` says the doubles are amounts with two decimals, to be summed exactly as cents.
    """
    keys = name_list(keys)
    kept = with_keys(df, keys, keep_null_key)
    totals = sum_figures(df, sums, rounding, money)
    return kept.groupBy(*map(column, keys)).agg(*[total.alias(out) for out, total in totals.items()])


def sum_figures(df: DataFrame, sums: Mapping[str, str], rounding: int | None, money: bool) -> dict[str, Column]:
    totals = {}
    for out, name in sums.items():
        totals[out] = _sum_of(df, name, money)
        if rounding is not None and not isinstance(df.schema[name].dataType, T.IntegralType):
            totals[out] = round_even(totals[out], rounding)
    return totals


def _mean_of(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.DecimalType):
        # The exact sum over the count: avg of a decimal would be cut to a few places.
        return ratio(F.sum(column(name)), F.count(column(name)))
    return F.avg(column(name)).cast("double")


def mean_by(
    df: DataFrame,
    keys: str | Iterable[str],
    means: Mapping[str, str],
    rounding: int | None = None,
    keep_null_key: bool = False,
) -> DataFrame:
    """Means per key, ``means`` maps output name to column."""
    keys = name_list(keys)
    kept = with_keys(df, keys, keep_null_key)
    outs = mean_figures(df, means, rounding)
    return kept.groupBy(*map(column, keys)).agg(*[mean.alias(out) for out, mean in outs.items()])


def mean_figures(df: DataFrame, means: Mapping[str, str], rounding: int | None) -> dict[str, Column]:
    found = {out: _mean_of(df, name) for out, name in means.items()}
    return found if rounding is None else {out: round_even(mean, rounding) for out, mean in found.items()}


def count_non_null_by(df: DataFrame, key: str, col: str, name: str = "n") -> DataFrame:
    """Non-null values of a column per key."""
    kept = with_keys(df, [key])
    return kept.groupBy(column(key)).agg(F.count(column(col)).alias(name))


def kpis(df: DataFrame, figures: Mapping[str, Column]) -> DataFrame:
    """Key figures of the whole frame in one row and one scan."""
    return df.agg(*[expr.alias(name) for name, expr in figures.items()])


def distinct_count(col: Column, approx_error: float | None = None) -> Column:
    """Exact distinct count, or a sketch within ``approx_error`` where that is asked for."""
    return F.approx_count_distinct(col, approx_error) if approx_error else F.countDistinct(col)


def annual_growth_avg(df: DataFrame, id_col: str, since_col: str) -> DataFrame:
    """Distinct ids over the calendar years from the first date to the last, both included."""
    row = kpis(
        df,
        {
            "n_customers": F.countDistinct(column(id_col)),
            "start_year": F.year(F.min(column(since_col))).cast("bigint"),
            "end_year": F.year(F.max(column(since_col))).cast("bigint"),
        },
    )
    row = row.withColumn("years_active", F.col("end_year") - F.col("start_year") + 1)
    return row.withColumn("avg_annual_growth", ratio(F.col("n_customers"), F.col("years_active")))


def imbalance_flag(
    df: DataFrame, col: str, left: str = "Male", right: str = "Female", threshold: float = 0.1
) -> DataFrame:
    """Whether two values differ by more than ``threshold`` of all rows, nulls included."""
    return imbalance_of(kpis(df, imbalance_figures(col, left, right)), threshold)


def imbalance_figures(col: str, left: str, right: str) -> dict[str, Column]:
    return {
        "n_left": F.count_if(column(col) == F.lit(left)),
        "n_right": F.count_if(column(col) == F.lit(right)),
        "n_rows": F.count(F.lit(1)),
    }


def imbalance_of(row: DataFrame, threshold: float) -> DataFrame:
    gap = ratio(F.abs(F.col("n_left") - F.col("n_right")), F.col("n_rows"))
    return row.withColumn("gap", gap).withColumn("imbalanced", F.col("gap") > F.lit(threshold))


def arg_max(df: DataFrame, label: str, value: str) -> DataFrame:
    """The row with the largest value; ties go to the smallest label."""
    top = df.where(column(value).isNotNull())
    top = top.orderBy(column(value).desc(), column(label).asc_nulls_last()).limit(1)
    return top.select(column(label).alias("label"), column(value).alias("value"))


def mean_pivot(df: DataFrame, row: str, col: str, value: str, values: Sequence[str] | None = None) -> DataFrame:
    """Mean per (row, column) laid out wide; absent cells stay NULL."""
    kept = with_keys(df, [row, col])
    wide = kept.groupBy(column(row)).pivot(col, list(values) if values else None)
    return wide.agg(_mean_of(df, value))


def crosstab_counts(df: DataFrame, row: str, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """Counts per (row, column) laid out wide, absent cells 0; rows with a null key are left out."""
    kept = with_keys(df, [row, col])
    wide = kept.groupBy(column(row)).pivot(col, list(values) if values else None)
    return wide.agg(F.count(F.lit(1))).na.fill(0)


def band_crosstab(
    df: DataFrame,
    value: str,
    col: str,
    width: float,
    values: Sequence[str],
    drop_max_on_edge: bool = False,
) -> DataFrame:
    """Counts of fixed-width band by category in long form, absent cells of present bands 0.

    ``drop_max_on_edge`` leaves out rows at a maximum that is a whole multiple of the width,
    as a half-open edge list ending at that maximum would.
    """
    rows = df.select(column(value).cast("double").alias("v"), column(col).alias(col))
    band = cut_width(F.col("v"), width)
    if drop_max_on_edge:
        top = scalar_of(rows, F.max("v"))
        on_edge = (F.col("v") == top) & (F.pmod(F.col("v"), F.lit(float(width))) == 0)
        band = F.when(~F.coalesce(on_edge, F.lit(False)), band)
    wide = crosstab_counts(rows.withColumn("band", band), "band", col, values)
    long = wide.unpivot(["band"], list(values), col, "n")
    return long.select(
        "band",
        band_low(F.col("band"), width).alias("lo"),
        band_high(F.col("band"), width).alias("hi"),
        band_label(F.col("band"), width).alias("band_label"),
        column(col),
        "n",
    ).orderBy("band", column(col))
