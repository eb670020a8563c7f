"""Staging again what changed: a manifest of source files, and only the partitions they touch are rewritten."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillgrid.operators.support import column, settle

MANIFEST = "file string, size bigint, changed timestamp"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, changed) of the files of a path; their content is not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed")
    )


def _folder(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    files, folder = _folder(spark, path)
    return spark.read.schema(MANIFEST).parquet(path) if files.exists(folder) else None


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(file, there): files that came or changed, and files that went (there is false)."""
    old = before.select(F.col("file").alias("old"), F.col("size").alias("old_size"), F.col("changed").alias("old_changed"))
    both = now.join(old, F.col("file") == F.col("old"), "full_outer")
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("changed").eqNullSafe(F.col("old_changed"))
    return both.where(~same).select(F.coalesce("file", "old").alias("file"), F.col("file").isNotNull().alias("there"))


def stage_changes(
    spark: SparkSession,
    source: str,
    read: Callable[[list[str]], DataFrame],
    path: str,
    partition_by: str,
    source_col: str = "source_file",
) -> DataFrame:
    """Stage the files of ``source``, as ``stage`` does, but read and rewrite only what changed since the last call.

    ``read`` makes a typed frame of some of the files, row by row: a row must not depend on others. The
    staged table has one more column, the file each row came from. A changed or vanished file loses its rows, a
    new or changed one is read, and only partitions with such rows are written anew; a partition left without rows is
    removed. The manifest is written last, so a run that broke off is made good by the next. Needs a single writer.
    """
    before = _manifest(spark, f"{path}.manifest")
    now = settle(list_files(spark, source))
    if before is None:
        files = [r["file"] for r in now.select("file").collect()]  # names of files, as the reader takes them
        rows = _with_file(read(files), source_col)
        rows.hint("rebalance", column(partition_by)).write.mode("overwrite").partitionBy(partition_by).parquet(path)
        now.write.mode("overwrite").parquet(f"{path}.manifest")
        return _staged(spark, path, rows, partition_by)
    changed = settle(changed_files(now, before))
    listed = changed.collect()
    if not listed:
        return _staged(spark, path, _with_file(read([r["file"] for r in now.collect()]), source_col), partition_by)
    again = [r["file"] for r in listed if r["there"]]
    everything = _with_file(read(again or [r["file"] for r in now.limit(1).collect()]), source_col)
    fresh = everything if again else everything.limit(0)
    staged = _staged(spark, path, everything, partition_by)
    gone = F.broadcast(changed.select(F.col("file").alias("gone")))  # names, which the driver has listed
    of = column(source_col) == F.col("gone")
    touched = staged.join(gone, of, "left_semi").select(column(partition_by)).union(fresh.select(column(partition_by)))
    touched = settle(touched.distinct().select(column(partition_by).alias("touched")))
    values = [r["touched"] for r in touched.collect()]  # one for each partition to be written
    wanted = column(partition_by).isin([v for v in values if v is not None])
    if None in values:
        wanted = F.coalesce(wanted, F.lit(False)) | column(partition_by).isNull()
    # Settled: the partitions that these rows come from are about to be replaced.
    kept = staged.where(wanted).join(gone, of, "left_anti").select(*everything.columns)
    rows = settle(kept.unionByName(fresh))
    left = [r[0] for r in rows.select(column(partition_by)).distinct().collect()]
    writer = rows.hint("rebalance", column(partition_by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition_by).parquet(path)
    for value in set(values) - set(left):
        _drop_partition(spark, path, partition_by, value)
    now.write.mode("overwrite").parquet(f"{path}.manifest")
    return _staged(spark, path, everything, partition_by)


def _with_file(rows: DataFrame, source_col: str) -> DataFrame:
    if source_col in rows.columns:
        return rows
    # The same form as the listing gives.
    return rows.select("*", F.regexp_replace(F.input_file_name(), "^file:/+", "file:/").alias(source_col))


def _staged(spark: SparkSession, path: str, like: DataFrame, partition_by: str) -> DataFrame:
    fields = [f for f in like.schema if f.name != partition_by] + [like.schema[partition_by]]
    return spark.read.schema(type(like.schema)(fields)).parquet(path)


def _drop_partition(spark: SparkSession, path: str, partition_by: str, value) -> None:
    name = spark.range(1).select(F.lit(value).cast("string")).first()[0]
    own = "__HIVE_DEFAULT_PARTITION__" if name is None else name
    files, folder = _folder(spark, f"{path}/{partition_by}={own}")
    files.delete(folder, True)
