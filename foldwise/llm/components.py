"""Connected components as Spark jobs: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import Scratch


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (a, b) edges."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    large = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
             .groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_"))
    least = large.groupBy("a").agg(F.min("b").alias("low"))
    moved = large.join(least, "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root): every node of ``edges`` (a, b; a != b) with its component's least node.

    Each round halves the remaining depth at least; rounds are written below the
    checkpoint folder and end when a round changes nothing."""
    now = scratch.put(edges.groupBy("a", "b").agg(F.lit(1).alias("_")).drop("_"), f"{name}-0")
    mark, turn = None, 0
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark or seen["n"] == 0:
            break
        mark = (seen["n"], seen["h"])
        turn += 1
        after = scratch.put(_stars(now), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
