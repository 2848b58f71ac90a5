"""Measures of ensembles, panels and decisions: one aggregate or window each, all partial before their shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import drawdown_state


def proxy_share(df: DataFrame, by: str, proxy: Column, rule: Column) -> DataFrame:
    """``(by, rule, n, share)``: of all rows of a series, those that stand in by each rule; rule ``all`` is any."""
    rows = df.select(by, proxy.alias("_p"), rule.alias("_r"))
    each = rows.groupBy(by, F.when(F.col("_p"), F.col("_r")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy(by))
    each = each.withColumn("_all", whole)
    total = each.groupBy(by).agg(F.sum(F.when(F.col("rule").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.max("_all").alias("_all")).withColumn("rule", F.lit("all"))
    return each.where("rule is not null").unionByName(total).select(by, "rule", "n", (F.col("n") / F.col("_all")).alias("share"))


def floored_drawdown(df: DataFrame, floor: float, by: str, order: str, value: str) -> DataFrame:
    """Drawdown as a state from 0, none, to 1, ``floor`` or deeper."""
    return drawdown_state(df, by, order, value).withColumn("state", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dd") / floor)))


def worst_period(df: DataFrame, by: str, order: str, value: str, length: int, target: float) -> DataFrame:
    """Each path's full period of the lowest sum, the earliest of several, and how far it is from ``target``."""
    period = F.floor(F.col(order) / length).alias("period")
    sums = df.groupBy(by, period).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == length)
    return sums.groupBy(by).agg(F.min_by("period", F.struct("s", "period")).alias("worst")).withColumn("error", F.abs(F.col("worst") - target))


def endpoint_error(df: DataFrame, by: str, order: str, value: str, start: float, end: float) -> DataFrame:
    """Mean distance of a path's first and last value from what was asked for."""
    ends = df.groupBy(by).agg(F.min_by(value, order).alias("_a"), F.max_by(value, order).alias("_z"))
    return ends.select(by, ((F.abs(F.col("_a") - start) + F.abs(F.col("_z") - end)) / 2).alias("error"))


def floor_violations(df: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    """``(factor, n)``: rows below each factor's floor."""
    counts = df.agg(*[F.count_if(F.col(c) < low).alias(c) for c, low in floors.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("n")) for c in floors])).alias("e")).select("e.*")


def mean_if_enough(df: DataFrame, value: Column, least: int) -> DataFrame:
    """The mean of ``value``; null under ``least`` rows or where one isn't finite."""
    rows = df.select(value.alias("_v"))
    whole = F.count_if(F.col("_v").isNull() | F.isnan("_v") | (F.abs("_v") == float("inf"))) == 0
    return rows.agg(F.count(F.lit(1)).alias("n"), F.when(whole & (F.count(F.lit(1)) >= least), F.avg("_v")).alias("mean"))


def anchor_deviation(df: DataFrame, by: str, rate: Column, inflation: Column, neutral: float = 0.75, target: float = 2.0, slope: float = 0.5) -> DataFrame:
    """Root mean square of a rate's distance from ``neutral + target + slope * (inflation - target)``."""
    off = rate - (neutral + target + slope * (inflation - target))
    return df.groupBy(by).agg(F.count(off).alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"))


def z_scores(df: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """The signed sum of columns in population deviations from their means: two numbers a column meet every row, no row another."""
    own = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    score = sum((sign * F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c, sign in columns.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(own)).withColumn("score", score).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def quadrant(label: Column, change: Column, hot: float, contracting: Sequence[str] = ("REC", "CRI")) -> Column:
    """2 for an expansion plus 1 above ``hot``; -1 where the change is missing."""
    cell = F.when(label.isin(*contracting), 0).otherwise(2) + F.when(change > hot, 1).otherwise(0)
    return F.when(change.isNull() | F.isnan(change), -1).otherwise(cell)


def usable_band(lo: Column, hi: Column) -> Column:
    """Whether both ends are finite numbers that differ."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return finite(lo) & finite(hi) & (lo != hi)


def pooled_difference(df: DataFrame, difference: str) -> DataFrame:
    """Mean and sample deviation over seeds; beaten when the mean is negative and larger than the deviation."""
    out = df.agg(F.count(difference).alias("n"), F.avg(difference).alias("mean"), F.stddev_samp(difference).alias("sd"))
    return out.withColumn("beaten", F.coalesce((F.col("mean") < 0) & (F.abs("mean") > F.col("sd")), F.lit(False)))


def chained(base: DataFrame, older: DataFrame, least: int = 6, order: str = "dt", value: str = "v") -> DataFrame:
    """``base`` and, before its first row, ``older`` shifted by the mean difference on common dates; ``part`` tells which.

    Under ``least`` common dates nothing is put in front. ``rmse`` is what the shift leaves on the common dates.
    """
    both = base.select(order, F.col(value).alias("_b")).join(older.select(order, F.col(value).alias("_o")), order)
    gap = F.col("_b") - F.col("_o")
    fit = both.agg(F.count(F.lit(1)).alias("_n"), F.avg(gap).alias("_shift"), F.stddev_pop(gap).alias("rmse"))
    fit = fit.crossJoin(base.agg(F.min(order).alias("_first"))).where(F.col("_n") >= least)
    front = older.crossJoin(F.broadcast(fit)).where(F.col(order) < F.col("_first")).select(order, (F.col(value) + F.col("_shift")).alias(value), F.lit("older").alias("part"), "rmse")
    return base.select(order, value, F.lit("base").alias("part"), F.lit(None).cast("double").alias("rmse")).unionByName(front)


def geometric_index(df: DataFrame, order: str, value: str) -> DataFrame:
    """The geometric mean of all series on each date."""
    return df.groupBy(order).agg(F.exp(F.avg(F.log(value))).alias("index"), F.count(value).alias("n"))


def refresh_plan(required: DataFrame, held: DataFrame, as_of: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Which of ``required (sid, source, intake, sla_days)`` are due: those taken in automatically that ``held (sid, last)`` lacks or has too old."""
    due = required.where("intake = 'auto'")
    if sources is not None:
        due = due.where(F.col("source").isin(*sources))
    age = F.datediff(F.lit(as_of).cast("date"), F.last_day("last"))
    out = due.join(held, "sid", "left").withColumn("reason", F.when(F.col("last").isNull(), "missing").when(age > F.col("sla_days"), "stale"))
    return out.where("reason is not null").select("sid", "source", "reason")


def coverage(df: DataFrame, by: str, order: str) -> DataFrame:
    """Distinct months over the months from the first to the last."""
    span = F.months_between(F.trunc(F.max(order), "MM"), F.trunc(F.min(order), "MM")) + 1
    return df.groupBy(by).agg(F.count_distinct(F.trunc(order, "MM")).alias("months"), span.cast("long").alias("spanned")).withColumn("share", F.col("months") / F.col("spanned"))


def battery(df: DataFrame, by: str, metrics: Mapping[str, Column], bands: DataFrame) -> DataFrame:
    """Every metric of every group against ``bands (metric, lo, hi)``: ``(by, metric, value, lo, hi, verdict)``.

    A metric without a usable band is ``unbanded``, one that is missing ``missing``.
    """
    wide = df.groupBy(by).agg(*[c.cast("double").alias(name) for name, c in metrics.items()])
    long = wide.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("e")).select(by, "e.*")
    both = long.join(bands.select("metric", "lo", "hi"), "metric", "left")
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    verdict = F.when(F.col("value").isNull() | F.isnan("value"), "missing").when(~usable_band(F.col("lo"), F.col("hi")), "unbanded").when(inside, "pass").otherwise("fail")
    return both.select(by, "metric", "value", "lo", "hi", verdict.alias("verdict"))
