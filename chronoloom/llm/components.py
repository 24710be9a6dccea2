"""Connected components of a large edge list by alternating star contractions.

Each round is two shuffles of the edges; rounds grow with the logarithm of the longest
chain.  Nothing but one changed-edges count goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget_last, materialize


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link every larger (or every smaller) neighbour of a node to the node's least neighbour."""
    if large:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
    else:
        both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """pairs: columns a, b (long).  Returns node, root for all nodes in pairs; root is the least node reachable."""
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    signature = None
    for _ in range(max_rounds):
        pairs = materialize(_star(_star(pairs, True), False), "links")
        # at the fixed point all nodes hang at their root, and the next round repeats the same edges
        forget_last(pairs.sparkSession, 2)  # the round before
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == signature:
            break
        signature = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
