"""Points of a map in nested square cells: clusters for every zoom level, and a grid that is finer where points are dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillgrid.operators.support import column

WORLD = (-180.0, 180.0, -90.0, 90.0)  # west, east, south, north


def _cell(value: Column, low: float, high: float, level: int) -> Column:
    """Which of the 2**level equal parts of [low, high] holds the value; the upper end is in the last."""
    parts = 1 << level
    return F.least(F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(parts)), F.lit(parts - 1)).cast("bigint")


def nested_cells(
    df: DataFrame, x: str, y: str, first: int, last: int, bounds: tuple[float, float, float, float] = WORLD
) -> DataFrame:
    """``level, x_cell, y_cell, n, x_sum, y_sum`` for every occupied cell of the levels ``first`` to ``last``.

    Rows are shuffled once, as partial sums of the finest cells; the other levels are sums of those. Points that
    lack a coordinate or lie outside ``bounds`` have no cell.
    """
    west, east, south, north = bounds
    if not 0 <= first <= last <= 30 or not (west < east and south < north):
        raise ValueError("levels must lie in 0 to 30, in order, and bounds must span an area")
    at_x, at_y = column(x).cast("double"), column(y).cast("double")
    placed = df.where(at_x.between(west, east) & at_y.between(south, north))
    finest = placed.groupBy(
        _cell(at_x, west, east, last).alias("x_fine"), _cell(at_y, south, north, last).alias("y_fine")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(at_x).alias("x_sum"), F.sum(at_y).alias("y_sum"))
    levels = finest.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level"))
    coarser = F.lit(last) - F.col("level")
    cell = [F.call_function("shiftright", F.col(c), coarser).alias(name) for c, name in (("x_fine", "x_cell"), ("y_fine", "y_cell"))]
    return levels.groupBy("level", *cell).agg(*(F.sum(c).alias(c) for c in ("n", "x_sum", "y_sum")))


def quadkey(level: Column, x_cell: Column, y_cell: Column) -> Column:
    """One digit a level, from the coarsest; a cell's key begins with the keys of the cells around it."""

    def digit(i: Column) -> Column:
        bit = [F.call_function("shiftright", c, i.cast("int")).bitwiseAND(F.lit(1)) for c in (x_cell, y_cell)]
        return (bit[0] + 2 * bit[1]).cast("string")

    steps = F.sequence(level - 1, F.lit(0), F.lit(-1))
    return F.when(level > 0, F.concat_ws("", F.transform(steps, digit))).otherwise("")


def zoom_clusters(
    df: DataFrame, x: str, y: str, first: int, last: int, bounds: tuple[float, float, float, float] = WORLD
) -> DataFrame:
    """``level, quadkey, n, x_mean, y_mean``: the markers of each zoom level with their number and centre.

    The number of a marker is the sum over those of the next level whose keys begin with its own.
    """
    cells = nested_cells(df, x, y, first, last, bounds)
    return cells.select(
        "level",
        quadkey(F.col("level"), F.col("x_cell"), F.col("y_cell")).alias("quadkey"),
        "n",
        (F.col("x_sum") / F.col("n")).alias("x_mean"),
        (F.col("y_sum") / F.col("n")).alias("y_mean"),
    )


def adaptive_grid(
    df: DataFrame, x: str, y: str, most: int, depth: int, bounds: tuple[float, float, float, float] = WORLD
) -> DataFrame:
    """``level, x_cell, y_cell, n``: the leaves of a quadtree whose cells are split while they hold more than ``most`` points.

    Every point within bounds is in one leaf. A leaf holds at most ``most`` points unless it is of the last level,
    ``depth``. Cells without points are left out.
    """
    cells = nested_cells(df, x, y, 0, depth, bounds).select("level", "x_cell", "y_cell", "n")
    # A cell beside the up to three others of the same parent: their sum is the parent's number of points.
    parent = [F.call_function("shiftright", F.col(c), F.lit(1)) for c in ("x_cell", "y_cell")]
    around = F.sum("n").over(Window.partitionBy("level", *parent))
    split = cells.withColumn("split", (F.col("level") == 0) | (around > most)).where("split").drop("split")
    return split.where((F.col("n") <= most) | (F.col("level") == depth))
