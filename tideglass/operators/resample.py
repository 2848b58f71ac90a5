"""Seeded resampling: draws are hashes of path and month, so they don't depend on partitions and can be made anywhere again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import quantiles


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the parts: the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def grid(spark: SparkSession, paths: int, months: int) -> DataFrame:
    cells = spark.range(paths).withColumnRenamed("id", "path")
    return cells.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(months - 1)).cast("array<bigint>")))


def block_draws(spark: SparkSession, paths: int, histories: DataFrame, restart: float, seed: int, by: str = "sid", length: int | None = None) -> DataFrame:
    """``(by, path, m, row)`` of a stationary block bootstrap of each of ``histories (by, n)``, as long as the history or of the ``length`` given.

    A fresh start in the first month and with chance ``restart`` after it, else the row after the last one, around the end.
    Paths are dealt over tasks and meet every history, of which there is one short row each.
    """
    fresh = (F.col("m") == 0) | (uniform(seed, F.lit("restart"), by, "path", "m") < restart)
    start = F.floor(uniform(seed, F.lit("start"), by, "path", "m") * F.col("n"))
    g = spark.range(paths).withColumnRenamed("id", "path").crossJoin(histories.select(by, "n"))
    g = g.withColumn("m", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") if length is None else F.lit(length).cast("bigint")) - 1))).withColumn("_s", F.when(fresh, F.struct(F.col("m").alias("at"), start.alias("row"))))
    last = F.last("_s", ignorenulls=True).over(Window.partitionBy(by, "path").orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("_l", last).select(by, "path", "m", F.pmod(F.col("_l.row") + F.col("m") - F.col("_l.at"), F.col("n")).alias("row"))


def stratified_draws(spark: SparkSession, labels: DataFrame, rows: DataFrame, paths: int, seed: int) -> DataFrame:
    """``(path, m, label, row)``: for each month of ``labels (m, label)`` a row of the same label, drawn by the hash of path and month.

    ``rows (row, label)`` are numbered within their label once; a label without rows draws none. Draws meet their rows by
    label and number, so no label's rows meet in pairs.
    """
    numbered_ = rows.withColumn("_i", (F.row_number().over(Window.partitionBy("label").orderBy("row")) - 1).cast("long"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    g = spark.range(paths).withColumnRenamed("id", "path").crossJoin(labels.select("m", "label")).join(sizes, "label")
    g = g.withColumn("_i", F.floor(uniform(seed, F.lit("row"), "path", "m") * F.col("_n")))
    return g.join(numbered_, ["label", "_i"]).select("path", "m", "label", "row")


def resampled(draws: DataFrame, history: DataFrame, by: str = "sid") -> DataFrame:
    """Each draw with its history row: an equi-join."""
    return draws.join(history, [by, "row"])


def numbered(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    return df.withColumn("row", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def bands(stats: DataFrame, by: Sequence[str], value: str, level: float) -> DataFrame:
    """Percentile bands of a statistic over resamples."""
    low, high = (1 - level) / 2, (1 + level) / 2
    return quantiles(stats, value, {"lo": low, "hi": high}, by).select(*by, "lo", "hi", "n")


def outside(value: Column, lo: Column, hi: Column) -> Column:
    """Not within a band; a missing value is outside, a missing band holds everything."""
    return F.when(lo.isNull() | hi.isNull(), False).when(value.isNull() | F.isnan(value), True).otherwise((value < lo) | (value > hi))
