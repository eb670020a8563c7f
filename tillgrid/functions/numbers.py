"""Ratios, rounding, exact money sums and tenures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_even(col: Column, places: int = 2) -> Column:
    """Half-to-even on the scaled binary value, as numpy rounds."""
    scale = F.lit(float(10**places))
    return F.rint(col.cast("double") * scale) / scale


def money_sum(col: Column) -> Column:
    """Exact, order-independent sum of a two-decimal double.

    Whole cents go into a decimal buffer, so the result does not depend on how rows
    were spread over tasks and cannot overflow a long.
    """
    cents = F.rint(col * 100).cast("bigint").cast("decimal(18,0)")
    return F.sum(cents).cast("double") / F.lit(100.0)


def coverage_pct(part: Column, whole: Column, places: int = 2) -> Column:
    return round_even(ratio(part, whole) * 100, places)


def engagement_score(transactions: Column, active_customers: Column, months: Column) -> Column:
    return ratio(transactions + active_customers, months)


def tenure_years_from_months(months: Column) -> Column:
    return months / F.lit(12.0)


def tenure_years_as_of(since: Column, as_of: dt.date) -> Column:
    """Whole days from ``since`` to midnight of ``as_of``, rounded down, over 365."""
    midnight = since.cast("date").cast("timestamp_ntz")
    part_day = (since.cast("timestamp_ntz") > midnight).cast("int")
    return (F.datediff(F.lit(as_of), since.cast("date")) - part_day) / F.lit(365.0)
