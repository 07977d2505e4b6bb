"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, hot_keys, join_spread


def _with_least(pairs: DataFrame, hot: list) -> DataFrame:
    """pairs (u, v) with m, the least of u and its neighbours v; a hot u is aggregated first, and its rows stay in their tasks."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return join_spread(pairs, least, "u", hot)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b); root is the component's least node.

    Large-star and small-star steps alternate until nothing changes; every step keeps the components and
    leaves at most as many edges. Each round is checkpointed.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = hot_keys(both.groupBy("u").count(), "u", "count")
        large = _with_least(both, hot).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large.filter("u > v"), hot)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = checkpointed(small.filter("u <> v").distinct())
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
