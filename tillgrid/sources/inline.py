"""Literal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table written out in the program, so its size is known before any join."""
    return spark.createDataFrame(list(rows), schema)
