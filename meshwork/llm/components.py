"""Connected components as alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_limit, join_hot, materialise


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (u, v) but each component's smallest, which is
    its label. Large-star and small-star steps alternate until the edges no longer change: each
    step is a grouped minimum (combined before the shuffle) and a join, in which the edges of a hub are spread over all
    tasks; O(log n) rounds, and no edge reaches the driver. Null ends and loops are ignored."""
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), name)
    count = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    seen = count(e)
    while True:
        limit = hot_limit(2 * seen[0])
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_hot(both, least, "u", "n", limit).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        parent = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, parent, "a", "n", limit).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(parent.select("a", F.col("m").alias("b")))
        e = materialise(small.distinct(), name)
        now = count(e)
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
