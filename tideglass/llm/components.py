"""Connected components by alternating large-star and small-star steps, all in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; component is the smallest node reachable.

    Self-links and repeated or reversed links are harmless; an empty table gives an empty table.
    A hub with very many links never meets in one task: its minimum is a partial aggregate and
    the join back is an ordinary one, which adaptive execution splits.
    """
    step = 0
    stars = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-{step}"
    )
    seen = _digest(stars)
    while seen[0]:
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        stars = scratch.save(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _digest(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
