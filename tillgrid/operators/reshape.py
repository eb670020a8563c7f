"""Wide to long, and counts over a declared list of labels."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.operators.support import column, name_list


def melt(
    df: DataFrame,
    ids: str | Iterable[str],
    var: str = "variable",
    value: str = "value",
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """Every non-id column becomes rows, null cells included; mixed types become text."""
    ids = name_list(ids)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    if len({df.schema[c].dataType for c in cols}) > 1:
        df = df.select(*map(column, ids), *[column(c).cast("string").alias(c) for c in cols])
    return df.unpivot([column(c) for c in ids], [column(c) for c in cols], var, value)


def dense_counts(df: DataFrame, ordinal: Column, labels: Sequence[str]) -> DataFrame:
    """Rows per declared label, zero counts kept: (ordinal, label, n).

    One conditional count per label: a single row leaves each task, and nothing is joined.
    """
    counts = df.select(ordinal.alias("ordinal")).agg(
        *[F.count_if(F.col("ordinal") == i).alias(f"n_{i}") for i in range(len(labels))]
    )
    cells = [
        F.struct(
            F.lit(i).cast("bigint").alias("ordinal"),
            F.lit(label).alias("label"),
            F.col(f"n_{i}").alias("n"),
        )
        for i, label in enumerate(labels)
    ]
    return counts.select(F.inline(F.array(*cells)))
