"""Shared helpers: settled frames, checked broadcasts, scalars, key filters."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A settled frame of at most this many rows may be broadcast.
BROADCAST_ROWS = 100_000


def settle(df: DataFrame) -> DataFrame:
    """Compute a small frame once and keep it in the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``; a temporary one is used only for
    a local master where none is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.partition("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tillgrid-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def broadcast_if_small(settled: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the row count is within bounds, else the frame as it is.

    Give it a settled frame: counting reads the checkpoint, never the source. Without the
    hint Spark shuffles both sides and adaptive execution splits hot keys.
    """
    if settled.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(settled)
    return settled


def scalar_of(df: DataFrame, expr: Column) -> Column:
    """One aggregate over the frame as a scalar-subquery column."""
    return df.agg(expr.alias("value")).select("value").scalar()


def name_list(cols: str | Iterable[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_keys(df: DataFrame, keys: Iterable[str], keep_null_key: bool = False) -> DataFrame:
    """Rows whose keys are all present, as pandas grouping takes them."""
    if keep_null_key:
        return df
    for key in keys:
        df = df.where(column(key).isNotNull())
    return df
