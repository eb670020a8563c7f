"""Points of scatter charts and maps, and their grid counts at scale."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.operators.support import column, name_list


def scatter_points(df: DataFrame, x: str, y: str, hue: str | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """Every point with both coordinates; a projection, so only these columns are read."""
    cols = [*name_list(keep), x, y] + ([hue] if hue else [])
    points = df.select(*map(column, dict.fromkeys(cols)))
    return points.where(column(x).isNotNull() & column(y).isNotNull())


def scatter_grid(
    df: DataFrame, x: str, y: str, x_width: float, y_width: float, hue: str | None = None
) -> DataFrame:
    """Points per grid cell: the same picture in as many rows as there are cells."""
    hues = [column(hue)] if hue else []
    cells = df.where(column(x).isNotNull() & column(y).isNotNull()).groupBy(
        *hues,
        F.floor(column(x) / F.lit(float(x_width))).cast("bigint").alias("x_cell"),
        F.floor(column(y) / F.lit(float(y_width))).cast("bigint").alias("y_cell"),
    )
    return cells.agg(F.count(F.lit(1)).alias("n"))


def category_grid(df: DataFrame, x: str, y: str, y_width: float, hue: str | None = None) -> DataFrame:
    """Points per value of a text axis and cell of a numeric one."""
    hues = [column(hue)] if hue else []
    cells = df.where(column(x).isNotNull() & column(y).isNotNull()).groupBy(
        *hues, column(x), F.floor(column(y) / F.lit(float(y_width))).cast("bigint").alias("y_cell")
    )
    return cells.agg(F.count(F.lit(1)).alias("n"))


def map_points(df: DataFrame, lat: str, lon: str, columns: Mapping[str, Column]) -> DataFrame:
    """One marker per located row: coordinates and the named expressions (popup, class)."""
    placed = df.where(column(lat).isNotNull() & column(lon).isNotNull())
    return placed.select(
        column(lat).alias("lat"), column(lon).alias("lon"), *[c.alias(n) for n, c in columns.items()]
    )


def group_points(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Markers clustered on a grid: count and mean position per cell."""
    placed = df.where(column(x).isNotNull() & column(y).isNotNull())
    return placed.groupBy(
        F.floor(column(x) / F.lit(float(cell))).cast("bigint").alias("x_cell"),
        F.floor(column(y) / F.lit(float(cell))).cast("bigint").alias("y_cell"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(column(x)).alias("x_mean"),
        F.avg(column(y)).alias("y_mean"),
    )
