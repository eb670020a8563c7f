"""Nested cells of a map, and joins whose fact rows sit on few keys."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillgrid.operators import adaptive_grid, join_dim_hot_keys, nested_cells, quadkey, zoom_clusters


@pytest.fixture(scope="module")
def placed(spark):
    """Most points in one corner, some far off, on the bounds, outside them, or nowhere."""
    dense = spark.range(4000).select((F.rand(3) * 0.2).alias("x"), (F.rand(4) * 0.2).alias("y"))
    wide = spark.range(500).select((F.rand(5) * 8).alias("x"), (F.rand(6) * 8).alias("y"))
    odd = spark.createDataFrame(
        [(0.0, 0.0), (8.0, 8.0), (8.0, 0.0), (8.1, 1.0), (None, 1.0), (1.0, None), (float("nan"), 1.0), (-0.1, 2.0)], "x double, y double"
    )
    return spark.createDataFrame(dense.union(wide).union(odd).collect(), "x double, y double")


BOUNDS = (0.0, 8.0, 0.0, 8.0)
INSIDE = 4503


def test_children_sum_to_parents(placed):
    found = {(r.level, r.quadkey): r.n for r in zoom_clusters(placed, "x", "y", 0, 6, BOUNDS).collect()}
    assert found[0, ""] == INSIDE
    sums = Counter()
    for (level, key), n in found.items():
        assert len(key) == level
        if level:
            sums[level - 1, key[:-1]] += n
    assert all(n == found[cell] for cell, n in sums.items()) and len(sums) == sum(level < 6 for level, _ in found)


def test_centres_lie_in_their_cells(placed):
    for r in zoom_clusters(placed, "x", "y", 3, 3, BOUNDS).collect():
        x = sum((int(d) & 1) << (2 - i) for i, d in enumerate(r.quadkey))
        y = sum((int(d) >> 1) << (2 - i) for i, d in enumerate(r.quadkey))
        assert x <= r.x_mean <= x + 1 and y <= r.y_mean <= y + 1


def test_every_point_is_in_one_bounded_leaf(placed):
    leaves = adaptive_grid(placed, "x", "y", 60, 9, BOUNDS).collect()
    assert sum(r.n for r in leaves) == INSIDE
    assert all(r.n <= 60 or r.level == 9 for r in leaves) and len({r.level for r in leaves}) > 2
    cells = {(r.level, r.x_cell, r.y_cell) for r in leaves}
    for level, x, y in cells:  # no leaf lies within another
        assert not any((up, x >> (level - up), y >> (level - up)) in cells for up in range(level))


def test_grid_of_few_or_no_points(spark, placed):
    assert [tuple(r) for r in adaptive_grid(placed, "x", "y", 10**6, 5, BOUNDS).collect()] == [(0, 0, 0, INSIDE)]
    assert [tuple(r) for r in adaptive_grid(placed, "x", "y", 1, 0, BOUNDS).collect()] == [(0, 0, 0, INSIDE)]
    assert adaptive_grid(placed.where("false"), "x", "y", 5, 5, BOUNDS).count() == 0
    assert spark.range(1).select(quadkey(F.lit(3), F.lit(5), F.lit(3))).first()[0] == "123"
    with pytest.raises(ValueError):
        nested_cells(placed, "x", "y", 4, 2, BOUNDS)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, a third without one."""
    rows = spark.range(60_000, numPartitions=8)
    ref = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 5000)
    return rows.select("id", ref.cast("long").alias("ref"))


def test_hot_keys_stay_where_they_are_read(spark, skewed):
    dim = spark.range(4000).select(F.col("id").alias("ref_id"), (F.col("id") * 2).alias("twice"))
    got = join_dim_hot_keys(skewed, dim, "ref", "ref_id")
    want = skewed.join(dim, skewed.ref == dim.ref_id, "left")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 60_000
    tasks = Counter(r[0] for r in got.where("ref is null or ref = 7").select(F.spark_partition_id()).collect())
    assert len(tasks) >= 8 and max(tasks.values()) < 6_000


def test_hot_keys_of_odd_tables(spark, skewed):
    none = spark.createDataFrame([], "ref_id long, hot_key string")
    assert join_dim_hot_keys(skewed, none, "ref", "ref_id").where("ref_id is not null").count() == 0
    assert join_dim_hot_keys(skewed.where("false"), none, "ref", "ref_id").count() == 0
    clash = skewed.withColumnRenamed("id", "hot_key")
    assert join_dim_hot_keys(clash, none.select("ref_id"), "ref", "ref_id").count() == 60_000
    twice = spark.createDataFrame([(7,), (7,), (None,), (None,)], "ref_id long")
    with pytest.raises(ValueError, match="7"):
        join_dim_hot_keys(skewed, twice, "ref", "ref_id")
