"""Figures of any set of periods from one staged row per period and group.

Quantiles keep a KLL sketch for each period and group, which merges into a sketch of any set of periods; it is the first
bracket of the exact path, so exact quantiles take the sketch table and one scan that counts. Distinct ids keep a theta
sketch, or for whole-number ids a bitmap for each 32,768 of them, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillgrid.functions import nan_to_null
from tillgrid.operators import statistics
from tillgrid.operators.support import BROADCAST_ROWS, column, name_list, settle

KLL_SIZE = 4_000
THETA_LG_SIZE = 14


def kll_rank_error(size: int) -> float:
    """Share of the rows by which a rank of a merged sketch is off, once in a hundred times at most."""
    return 2.296 / size**0.9723


def quantile_sketches(df: DataFrame, period: str | Iterable[str], group: str, col: str, size: int = KLL_SIZE) -> DataFrame:
    """(period, group, n, sketch): the table to stage, one row per period and group with a known value."""
    v = nan_to_null(column(col).cast("double"))
    keys = [column(k) for k in (*name_list(period), group)]
    rows = df.where(column(group).isNotNull() & v.isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))


def quantiles_from_sketches(
    sketches: DataFrame,
    df: DataFrame,
    group: str,
    col: str,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    exact: bool = True,
    size: int = KLL_SIZE,
    gather: int = 10_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Quantiles per group as ``quantiles_by`` gives them: (group, n, q).

    ``sketches`` and ``df`` are cut to the same periods by the caller; ``size`` is that of the sketches. ``exact=False``
    reads the sketches alone, with ``kll_rank_error``. Otherwise three times that error around each rank is the bracket
    whose rows one scan counts, and lists if they are at most ``gather``. A bracket that its sketch missed is opened
    and narrowed by further scans, so the answer is exact all the same.
    """
    probs = [float(p) for p in probs]
    g, ids = column(group), range(len(probs))
    merged = sketches.groupBy(g).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))

    def value(rank) -> F.Column:
        return F.kll_sketch_get_quantile_double("sketch", rank)

    if not exact:
        return merged.select(g, "n", F.array(*[value(F.lit(p)) for p in probs]).alias("q"))
    wide = 3 * kll_rank_error(size)
    ends = []
    few = F.col("n") * F.lit(wide) < 4  # so few rows are a bracket as they are
    for i in ids:
        # Half as much again: ranks of a sketch and of an interpolated quantile are counted differently.
        low, high = max(0.0, probs[i] - 1.5 * wide), min(1.0, probs[i] + 1.5 * wide)
        ends.append(F.when(few, value(F.lit(0.0))).otherwise(value(F.lit(low))).alias(f"lo{i}"))
        ends.append(F.when(few, value(F.lit(1.0))).otherwise(value(F.lit(high))).alias(f"hi{i}"))
    start = settle(merged.select(g, "n", *ends))
    most = start.agg(F.max("n")).first()[0] or 0
    rows = df.select(g.alias(group), nan_to_null(column(col).cast("double")).alias("v"))
    rows = rows.where(g.isNotNull() & F.col("v").isNotNull())
    return statistics.bracketed_quantiles(
        rows, start.select(g, "n"), group, probs, gather, broadcast_rows, start.drop("n"), 3 * wide * most + 4 <= gather
    )


def distinct_sketches(df: DataFrame, period: str | Iterable[str], id_col: str, lg_size: int = THETA_LG_SIZE) -> DataFrame:
    """(period, sketch): theta sketches of the ids, to be staged."""
    keys = [column(k) for k in name_list(period)]
    return df.groupBy(*keys).agg(F.theta_sketch_agg(column(id_col), lg_size).alias("sketch"))


def distinct_error(lg_size: int = THETA_LG_SIZE) -> float:
    """Relative standard error of a theta estimate; three times as much is met once in 300 times."""
    return 1 / (2**lg_size) ** 0.5


def distinct_estimate(sketches: DataFrame, lg_size: int = THETA_LG_SIZE) -> DataFrame:
    """``n``: about how many ids the chosen periods hold together."""
    return sketches.agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", lg_size)).alias("n"))


def new_estimate(sketches: DataFrame, before: DataFrame, lg_size: int = THETA_LG_SIZE) -> DataFrame:
    """``n``: about how many ids the chosen periods hold that ``before`` does not."""
    own, old = (
        s.agg(F.theta_union_agg("sketch", lg_size).alias("sketch")).select("sketch").scalar() for s in (sketches, before)
    )
    one = sketches.sparkSession.range(1)
    return one.select(F.theta_sketch_estimate(F.coalesce(F.theta_difference(own, old), own)).alias("n"))


def id_bitmaps(df: DataFrame, period: str | Iterable[str], id_col: str) -> DataFrame:
    """(period, bucket, bitmap) of whole-number ids, to be staged: 4 KB for each 32,768 ids that a period meets."""
    known = df.where(column(id_col).isNotNull())
    place = column(id_col).cast("bigint")
    return known.groupBy(*[column(k) for k in name_list(period)], F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )


def distinct_of_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """``n``: how many ids the chosen periods hold together."""
    buckets = bitmaps.groupBy("bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"))


def new_by_period(bitmaps: DataFrame, period: str) -> DataFrame:
    """(period, n, n_new, n_so_far): ids of each period, those not seen in an earlier one, and all up to it.

    The running union is taken bucket by bucket over one row per period; nothing grows with the rows.
    """
    so_far = Window.partitionBy("bucket").orderBy(column(period))
    running = bitmaps.select(
        column(period),
        "bucket",
        F.bitmap_count("bitmap").alias("own"),
        F.bitmap_count(F.bitmap_or_agg("bitmap").over(so_far)).alias("seen"),
    )
    before = F.lag("seen", 1, 0).over(so_far)
    gained = running.select(column(period), "own", (F.col("seen") - before).alias("gained"))
    sums = gained.groupBy(column(period)).agg(F.sum("own").alias("n"), F.sum("gained").alias("n_new"))
    # One row per period from here on.
    return sums.withColumn("n_so_far", F.sum("n_new").over(Window.orderBy(column(period))))
