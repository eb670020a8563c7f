"""Null handling: missing-value tokens, NaN, and list membership with a null."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a pandas CSV load takes as missing.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def null_tokens(col: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Text column with every missing-value token replaced by NULL."""
    return F.when(~col.isin(*tokens), col)


def nan_to_null(col: Column) -> Column:
    """NaN would poison sums and sort above every number; NULL is skipped."""
    return F.nanvl(col, F.lit(None).cast("double"))


def is_in(col: Column, values: Iterable) -> Column:
    """Filter condition for list membership, where a None in the list matches NULL.

    Without a None it is a plain IN, which reaches the scan and prunes partitions.
    """
    values = list(values)
    present = [v for v in values if v is not None]
    hit = col.isin(*present) if present else F.lit(False)
    if len(present) < len(values):
        hit = hit | col.isNull()
    return hit
