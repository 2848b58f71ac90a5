"""Exact quantiles without a buffer of all values: equal values are counted, and the counts dealt by ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, value: str, points: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``(by, n, a column for each point)``: linearly interpolated quantiles of each group's values, nulls left out.

    A group of any size spreads over the ranges; a range adds the rows of those below it, one number for each group and
    range. Groups without values, and an empty table, give no row. Null keys are a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id())
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    whole = Window.partitionBy(*(keys or [F.lit(1)]))  # one row for each range
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"))
    parts = parts.withColumn("_below", F.sum("_s").over(whole.orderBy("_part")) - F.col("_s")).withColumn("_n", F.sum("_s").over(whole)).drop("_s")
    parts = parts.select(*[F.col(k).alias(f"{k}r") for k in keys], F.col("_part").alias("_partr"), "_below", "_n")
    here = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in keys], F.col("_part") == F.col("_partr"))
    placed = dealt.withColumn("_upto", upto).join(parts, here)
    first = F.col("_below") + F.col("_upto") - F.col("_c")
    placed = placed.withColumn("_from", first).withColumn("_to", first + F.col("_c") - 1)

    def at(place):
        return F.max(F.when((F.col("_from") <= place) & (place <= F.col("_to")), F.col("_v")))

    ends, out = [], []
    for name, q in points.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        ends += [at(F.floor(h)).alias(f"_{name}0"), at(F.ceil(h)).alias(f"_{name}1")]
        h = (F.col("n") - 1) * F.lit(float(q))
        out.append((F.col(f"_{name}0") + (h - F.floor(h)) * (F.col(f"_{name}1") - F.col(f"_{name}0"))).alias(name))
    found = placed.groupBy(*keys).agg(F.max("_n").alias("n"), *ends) if keys else placed.agg(F.max("_n").alias("n"), *ends).where("n IS NOT NULL")
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "n", *out)
