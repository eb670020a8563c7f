"""Helpers of this subpackage: written intermediate tables, ranks without a hot task, free column names."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_written: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only on a local master where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tillgrid-")
    return _local[app]


def settle(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: lost executors cost no recomputation of it.

    Shuffle files of the finished job are freed as soon as the driver drops its plan, so the disk
    holds the tables of one step at a time. ``release`` removes the tables; the session's end does too.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tillgrid-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    _written.append((spark, path))
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``settle`` wrote, before ``release`` does; nothing that is still to run may read them."""
    for frame in frames:
        entry = (frame.sparkSession, frame.settled_at)
        if entry in _written:
            _written.remove(entry)
            _remove(*entry)


def _remove(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove every table that ``settle`` wrote for this session; frames that read them end here."""
    for entry in [e for e in _written if e[0] is spark]:
        _written.remove(entry)
        if spark.sparkContext._jsc is not None:
            _remove(*entry)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        release(spark)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet, whatever its case rules."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def running(df: DataFrame, group: str, cell: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group before this one by (cell, order), with one task for a cell.

    Group and cell must be known. The rows are shuffled once by (group, cell), and the join keeps that
    partitioning; what is summed over whole groups is one row per cell.
    """
    size, g, c, before = fresh(df, "cell_sum", "start_group", "start_cell", "sum_before")
    cells = df.groupBy(col(group), col(cell)).agg(F.sum(value).alias(size))
    ahead = Window.partitionBy(col(group)).orderBy(col(cell)).rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        col(group).alias(g), col(cell).alias(c), F.coalesce(F.sum(col(size)).over(ahead), F.lit(0)).alias(before)
    )
    inside = Window.partitionBy(col(group), col(cell)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    joined = summed.join(starts, (col(group) == col(g)) & (col(cell) == col(c)))
    return joined.withColumn(out, col(out) + col(before)).drop(g, c, before)


def ranked(df: DataFrame, group: str, cell: str, order: list[Column], rank: str) -> DataFrame:
    """Number the rows of each group from 0 by (cell, order); see ``running``."""
    return running(df, group, cell, order, F.lit(1).cast("long"), rank)
