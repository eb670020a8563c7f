"""Connected components by alternating large and small stars, until a round changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillgrid.llm.support import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` but the roots; a root is the smallest node of its component.

    Loops and repeated edges are harmless; without edges there are no rows. Each round shuffles the edges that
    are left, at most one for each node after the first few rounds.
    """
    pairs = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    )
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        large = both.join(low, "node").where("root > node").select(F.col("root").alias("node"), F.col("low").alias("root"))
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node").where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        pairs = settle(small.unionByName(low.select("node", F.col("low").alias("root"))).distinct())
        seen = tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first())
        if seen == state:
            return pairs
        state = seen
