"""Event detectors over long series: onsets and crossings as window predicates, one event a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import over, preceding_stats, rows


def big_moves(df: DataFrame, k: float, window: int, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Rows beyond ``k`` deviations of the ``window`` rows before."""
    return preceding_stats(df, window, by, order, value).where(F.abs(value) > k * F.col("sigma")).withColumn("severity", F.col(value) / F.col("sigma"))


def tier(value: str, cuts: Sequence[float]) -> Column:
    return sum((F.when(F.col(value) >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def tier_changes(df: DataFrame, cuts: Sequence[float], by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Rows whose tier differs from the row before's."""
    out = df.withColumn("tier", tier(value, cuts)).withColumn("prior", F.lag("tier").over(over(by, order)))
    return out.where("tier <> prior").withColumn("direction", F.when(F.col("tier") > F.col("prior"), "up").otherwise("down"))


def hysteresis(df: DataFrame, zone: float, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Flips of a state that changes only beyond a dead zone of either side; the first state is no event."""
    w = over(by, order)
    state = F.when(F.col(value) < -zone, "below").when(F.col(value) > zone, "above")
    known = df.withColumn("state", state).where("state IS NOT NULL")
    prior = known.withColumn("prior", F.lag("state").over(w))
    return prior.where("state <> prior")


def milestones(df: DataFrame, depths: Sequence[float], by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """First row of each episode below the peak at which each depth is reached; a new high ends the episode."""
    w = over(by, order)
    out = df.withColumn("_peak", F.max(value).over(rows(w, Window.unboundedPreceding)))
    out = out.withColumn("episode", F.sum(F.when(F.col(value) >= F.col("_peak"), 1).otherwise(0)).over(rows(w, Window.unboundedPreceding)))
    out = out.withColumn("_depth", 1 - F.col(value) / F.col("_peak"))
    each = out.withColumn("milestone", F.explode(F.array(*map(F.lit, depths)))).where(F.col("_depth") >= F.col("milestone"))
    return each.groupBy(by, "episode", "milestone").agg(F.min(order).alias(order))


def recoveries(df: DataFrame, least: float, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """New highs after the series had fallen by ``least`` since the high before."""
    w = over(by, order)
    before = rows(w, Window.unboundedPreceding, -1)
    high = df.withColumn("_high", F.coalesce(F.col(value) >= F.max(value).over(before), F.lit(True)))
    high = high.withColumn("_run", F.sum(F.when(F.col("_high"), 1).otherwise(0)).over(rows(w, Window.unboundedPreceding)))
    low = high.groupBy(by, "_run").agg(F.min(value).alias("_low"), F.max(value).alias("_top")).withColumn("_run", F.col("_run") + 1)
    out = high.where("_high").join(low, [by, "_run"]).withColumn("depth", 1 - F.col("_low") / F.col("_top"))
    return out.where(F.col("depth") >= least)


def surprises(df: DataFrame, persistence: float, threshold: float, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Value less a consensus that carries ``persistence`` of the last change on, in thresholds."""
    w = over(by, order)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    out = df.withColumn("consensus", one + persistence * (one - two)).where("consensus IS NOT NULL")
    return out.withColumn("surprise", F.col(value) - F.col("consensus")).withColumn("severity", F.col("surprise") / threshold)


def contest(events: DataFrame, by: Sequence[str], severity: str, ties: Sequence[str]) -> DataFrame:
    """The winner of each slot by size of severity, with the number of losers."""
    w = Window.partitionBy(*by)
    ranked = events.withColumn("_i", F.row_number().over(w.orderBy(F.desc(F.abs(severity)), *ties))).withColumn("losers", F.count(F.lit(1)).over(w) - 1)
    return ranked.where("_i = 1").drop("_i")


def detected(streams: Mapping[str, tuple[DataFrame, Column, Column]], cuts: Sequence[float], by: Sequence[str] = ("sid",), order: str = "dt") -> DataFrame:
    """``(by, order, place, cls, size, severity, label, fault)``: the events of all classes as one stream.

    ``streams`` has, for each class, its events with their size and label. A key's events go by ``order``, then class, size and label, and ``place`` numbers them from 1.
    ``severity`` is 1 and one more for each of ``cuts`` that the size reaches, up or down. An event with nothing to show for it, neither
    size nor label, or without a time, is kept with its ``fault``: it is a defect of its detector, not an event to drop.
    """
    parts = [events.select(*by, F.col(order).alias("_at"), F.lit(cls).alias("cls"), size.cast("double").alias("size"), label.cast("string").alias("label")) for cls, (events, size, label) in streams.items()]
    rows = reduce(DataFrame.unionByName, parts)
    severity = 1 + tier("_size", cuts)
    fault = F.when(F.col("_at").isNull(), "no time").when(F.col("size").isNull() & (F.coalesce("label", F.lit("")) == ""), "no anchor")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_at", "cls", "size", "label"))
    rows = rows.withColumn("_size", F.abs("size")).withColumn("place", place)
    return rows.select(*by, F.col("_at").alias(order), "place", "cls", "size", F.when(F.col("size").isNotNull(), severity).otherwise(1).alias("severity"), "label", fault.alias("fault"))


def uncovered(events: DataFrame, keys: DataFrame, classes: Sequence[str], by: Sequence[str] = ("sid",)) -> DataFrame:
    """``(by, classes)``: the declared classes, sorted, that never fired for a key; keys where all did have an empty array. ``keys`` names all keys."""
    fired = events.groupBy(*by).agg(F.collect_set("cls").alias("_f"))  # as many as classes
    asked = keys.select(*by).distinct().join(fired, list(by), "left")
    return asked.select(*by, F.array_except(F.array(*map(F.lit, sorted(classes))), F.coalesce("_f", F.array().cast("array<string>"))).alias("classes"))
