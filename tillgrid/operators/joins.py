"""Dimension joins and literal lookups."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillgrid.operators.support import column, settle


def join_dim(
    fact: DataFrame, dim: DataFrame, left_on: str, right_on: str, bounded: bool = False
) -> DataFrame:
    """Left equi-join of a fact to a dimension; every fact row stays.

    ``bounded`` says the dimension is a literal or counted table, so it is broadcast. With
    any other dimension Spark chooses by size, and adaptive execution splits hot keys.
    """
    right = F.broadcast(dim) if bounded else dim
    return fact.join(right, fact[f"`{left_on}`"] == dim[f"`{right_on}`"], "left")


def map_lookup(col: Column, mapping: Mapping[str, Any]) -> Column:
    """Value of a literal dictionary, NULL for a key it does not hold."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def duplicate_keys(dim: DataFrame, key: str) -> DataFrame:
    """Keys a dimension holds more than once: empty when each fact row matches at most one."""
    counts = dim.groupBy(column(key)).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > 1)


def join_dim_hot_keys(fact: DataFrame, dim: DataFrame, left_on: str, right_on: str, share: float = 0.001) -> DataFrame:
    """Left equi-join to a dimension of any size where few keys may hold most fact rows; every fact row stays once.

    Keys with more than ``share`` of the fact rows, so fewer than 1 / ``share``, are found in a first pass. Their
    rows, and those without a key, stay where they are read and meet the dimension rows of hot keys by broadcast; all others
    are shuffled by a key that is then no task's burden. A dimension that holds a key twice is refused.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    if twice := duplicate_keys(dim.where(column(right_on).isNotNull()), right_on).limit(3).collect():
        raise ValueError(f"the dimension holds more than one row for {[r[0] for r in twice]}")
    counts = fact.groupBy(column(left_on).alias("hot_key")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("hot_key").isNotNull()
    least = share * fact.count()
    hot = F.broadcast(settle(counts.where(known & (F.col("n") > least)).select("hot_key")))
    hot_dim = F.broadcast(dim.join(hot, dim[f"`{right_on}`"] == hot["hot_key"], "left_semi"))  # a row a key
    key = fact[f"`{left_on}`"]
    stay = fact.join(hot, key == hot["hot_key"], "left_semi").union(fact.where(key.isNull()))
    move = fact.where(key.isNotNull()).join(hot, key == hot["hot_key"], "left_anti")
    parts = [
        rows.join(side, rows[f"`{left_on}`"] == side[f"`{right_on}`"], "left") for rows, side in ((stay, hot_dim), (move, dim))
    ]
    return parts[0].union(parts[1])
