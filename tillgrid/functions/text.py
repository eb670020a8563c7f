"""Flags and per-row text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_below(col: Column, threshold: float, label: str = "Untapped") -> Column:
    return F.when(col < F.lit(threshold), F.lit(label))


def flag_value(col: Column, value: str = "Yes", hit: str = "blue", miss: str = "gray") -> Column:
    """NULL counts as a miss."""
    return F.when(col == F.lit(value), F.lit(hit)).otherwise(F.lit(miss))


def flag_first_segment(ordinal: Column, label: str = "Churn Risk") -> Column:
    return F.when(ordinal == 0, F.lit(label))


def describe_row(parts: Sequence[str | Column], missing: str = "nan") -> Column:
    """Join literal text and columns into one string; a NULL shows as ``missing``."""
    pieces = [
        F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(missing))
        for p in parts
    ]
    return F.concat(*pieces)
