"""Sorts and top-k. Nulls go last either way, and ties are settled by further columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from tillgrid.operators.support import column, name_list


def _ties(tie: str | Iterable[str]) -> list:
    return [column(c).asc_nulls_last() for c in name_list(tie)]


def order_desc(df: DataFrame, by: str, tie: str | Iterable[str] = ()) -> DataFrame:
    return df.orderBy(column(by).desc_nulls_last(), *_ties(tie))


def order_asc(df: DataFrame, by: str, tie: str | Iterable[str] = ()) -> DataFrame:
    return df.orderBy(column(by).asc_nulls_last(), *_ties(tie))


def order_by_key(df: DataFrame, keys: str | Iterable[str]) -> DataFrame:
    return df.orderBy(*_ties(keys))


def top_k(df: DataFrame, by: str, k: int, tie: str | Iterable[str]) -> DataFrame:
    """The k largest rows; each task keeps k rows and no full sort is made."""
    return order_desc(df, by, tie).limit(k)


def preview(df: DataFrame, n: int = 5, order_by: str | Iterable[str] | None = None) -> DataFrame:
    """First n rows; name the order to get the same rows every time."""
    return (order_by_key(df, order_by) if order_by is not None else df).limit(n)
