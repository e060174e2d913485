"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import discard, materialize


def _sum(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Large-star links each larger neighbour to a node's smallest neighbour,
    small-star links smaller neighbours to the smallest; both keep
    connectivity, and repeated they end in stars. All work is by joins and
    minima that combine before the shuffle, so a hub with very many links
    lands in no single task.
    """
    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (now := _sum(stars)) != before:
        before = now
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(stars, large)
        stars = after
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
