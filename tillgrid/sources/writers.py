"""Staged Parquet and exported CSV."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, path: str, partition_by: str | Iterable[str] = ()) -> DataFrame:
    """Write a typed table once and read it back, so later queries prune and push down.

    Rows are rebalanced over the partition columns: adaptive execution splits a hot value
    over several tasks and merges small ones, where a plain repartition would not.
    """
    by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    if by:
        df = df.hint("rebalance", *[F.col(c) for c in by])
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(_read_schema(df, by)).parquet(path)


def _read_schema(df: DataFrame, by: list[str]):
    kept = [f for f in df.schema if f.name not in by] + [df.schema[c] for c in by]
    return type(df.schema)(kept)


def export_csv(df: DataFrame, path: str) -> str:
    """Write UTF-8 CSV with a header, one part file per task, NULL as an empty field."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', encoding="UTF-8").csv(path)
    return path
