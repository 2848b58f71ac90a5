"""Window operators over long series ``(sid, dt, v)``, by default; frames are rows of one series and never cross it.

All of them are window functions partitioned by series, so a plan needs one shuffle by series
however many are chained, and none where the input is already so partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def over(by: str | Sequence[str] = "sid", order: str = "dt"):
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def rows(window, low: int, high: int = 0):
    return window.rowsBetween(low, high)


def simple_return(df: DataFrame, by: str = "sid", order: str = "dt", value: str = "v", out: str = "r") -> DataFrame:
    """Change against the row before, as a fraction; the first row of a series goes."""
    prev = F.lag(value).over(over(by, order))
    return df.withColumn("_prev", prev).where("_prev IS NOT NULL").select(by, order, (F.try_divide(F.col(value), F.col("_prev")) - 1).alias(out))


def yoy(df: DataFrame, periods: int = 12, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Percent change against the row ``periods`` before (a row offset, not a calendar one)."""
    change = 100 * (F.try_divide(F.col(value), F.lag(value, periods).over(over(by, order))) - 1)
    return df.withColumn("yoy", change).where("yoy IS NOT NULL")


def realized_vol(df: DataFrame, window: int = 12, least: int = 6, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Annualised sample deviation of the last ``window`` rows, from ``least`` of them on."""
    frame = rows(over(by, order), 1 - window)
    return df.withColumn("vol", F.when(F.count(value).over(frame) >= least, F.stddev_samp(value).over(frame) * math.sqrt(12))).where("vol IS NOT NULL")


def wealth(df: DataFrame, by: str = "sid", order: str = "dt", value: str = "r", clip: bool = False) -> DataFrame:
    growth = F.greatest(F.lit(0.0), 1 + F.col(value)) if clip else 1 + F.col(value)
    return df.withColumn("wealth", F.product(growth).over(rows(over(by, order), Window.unboundedPreceding)))


def drawdown_state(df: DataFrame, by: str = "sid", order: str = "dt", value: str = "r", from_one: bool = False, clip: bool = False) -> DataFrame:
    """Wealth over its running peak, less one. ``from_one``: the peak starts at 1, so a loss in the first row counts; ``clip``: no growth below zero."""
    out = wealth(df, by, order, value, clip)
    peak = F.max("wealth").over(rows(over(by, order), Window.unboundedPreceding))
    return out.withColumn("dd", F.col("wealth") / (F.greatest(F.lit(1.0), peak) if from_one else peak) - 1)


def max_drawdown(df: DataFrame, by: str = "sid", **how) -> DataFrame:
    return drawdown_state(df, by, **how).groupBy(by).agg((-F.min("dd")).alias("max_drawdown"))


def islands(df: DataFrame, flag: F.Column, by: str = "sid", order: str = "dt") -> DataFrame:
    """Rows where ``flag`` holds, numbered by run (gaps and islands): the number of rows without it so far."""
    marked = df.withColumn("_flag", flag)
    run = F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(rows(over(by, order), Window.unboundedPreceding))
    return marked.withColumn("island", run).where("_flag").drop("_flag")


def drawdown_episodes(df: DataFrame, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Depth and length of each run below the peak; one still open at the end counts."""
    below = islands(drawdown_state(df, by, order, value), F.col("dd") < 0, by, order)
    return below.groupBy(by, "island").agg(F.min(order).alias("start"), (-F.min("dd")).alias("depth"), F.count(F.lit(1)).alias("duration")).drop("island")


def jumps(df: DataFrame, k: float = 6.0, window: int = 12, least: int = 3, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Marks changes beyond ``k`` deviations of the changes in the window before, so a spike doesn't raise its own bar."""
    w = over(by, order)
    out = df.withColumn("change", F.col(value) - F.lag(value).over(w))
    own = F.when(F.count("change").over(rows(w, 1 - window)) >= least, F.stddev_samp("change").over(rows(w, 1 - window)))
    out = out.withColumn("_sigma", own).withColumn("sigma", F.lag("_sigma").over(w)).drop("_sigma")
    return out.withColumn("jump", F.coalesce(F.abs("change") > k * F.col("sigma"), F.lit(False)))


def range_vols(df: DataFrame, window: int, least: int, by: str = "sid", order: str = "dt") -> DataFrame:
    """Rolling deviations of close changes, of Parkinson's and of Garman and Klass's ranges, from ``open, high, low, close`` prices."""
    w = over(by, order)
    frame = rows(w, 1 - window)
    spread, move = F.log(F.col("high") / F.col("low")), F.log(F.col("close") / F.col("open"))
    out = df.withColumn("_ret", F.log(F.col("close") / F.lag("close").over(w))).withColumn("_pk", spread * spread / (4 * math.log(2)))
    out = out.withColumn("_gk", 0.5 * spread * spread - (2 * math.log(2) - 1) * move * move)
    full = F.count("_ret").over(frame) >= least
    return (
        out.withColumn("vol_close", F.when(full, F.stddev_samp("_ret").over(frame)))
        .withColumn("vol_parkinson", F.when(full, F.sqrt(F.avg("_pk").over(frame))))
        .withColumn("vol_garman_klass", F.when(full, F.sqrt(F.greatest(F.lit(0.0), F.avg("_gk").over(frame)))))
        .drop("_ret", "_pk", "_gk")
    )


def trailing_excess(df: DataFrame, k: int = 24, anchor: float = 2.0, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Mean of up to ``k`` rows, partial windows too, over an anchor."""
    return df.withColumn("excess", F.avg(value).over(rows(over(by, order), 1 - k)) - anchor)


def block_sums(df: DataFrame, k: int, by: str | Sequence[str] = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Sums of consecutive blocks of ``k`` rows; a partial last block goes."""
    keys = [by] if isinstance(by, str) else list(by)
    block = F.floor((F.row_number().over(over(by, order)) - 1) / k)
    out = df.withColumn("block", block).groupBy(*keys, "block").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == k).drop("_n")


def rolling_sums(df: DataFrame, k: int, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Sums of every full window of ``k`` rows, by its first row."""
    frame = rows(over(by, order), 0, k - 1)
    return df.withColumn("s", F.sum(value).over(frame)).withColumn("_n", F.count(F.lit(1)).over(frame)).where(F.col("_n") == k).drop("_n")


def rolling_growth(df: DataFrame, k: int, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Compounded growth of every full window of ``k`` rows, by its last row."""
    frame = rows(over(by, order), 1 - k)
    return df.withColumn("growth", F.product(1 + F.col(value)).over(frame)).withColumn("_n", F.count(F.lit(1)).over(frame)).where(F.col("_n") == k).drop("_n")


def lost_share(df: DataFrame, k: int, **how) -> DataFrame:
    """Share of full windows of ``k`` rows whose growth doesn't exceed one."""
    return rolling_growth(df, k, **how).groupBy(how.get("by", "sid")).agg(F.avg(F.when(F.col("growth") <= 1, 1.0).otherwise(0.0)).alias("lost_share"))


def era_share(df: DataFrame, level: float, run: int, k: int, by: str = "sid", order: str = "dt", value: str = "yoy") -> DataFrame:
    """Share of full windows of ``k`` rows that hold ``run`` rows in a row at ``level`` or above."""
    w = over(by, order)
    ahead, wide = rows(w, 0, run - 1), rows(w, 0, k - run)
    out = df.withColumn("_hot", F.when(F.col(value) >= level, 1).otherwise(0))
    out = out.withColumn("_run", F.when(F.count(F.lit(1)).over(ahead) == run, F.min("_hot").over(ahead)).otherwise(0))
    out = out.withColumn("_any", F.max("_run").over(wide)).withColumn("_n", F.count(F.lit(1)).over(rows(w, 0, k - 1))).where(F.col("_n") == k)
    return out.groupBy(by).agg(F.avg(F.col("_any").cast("double")).alias("era_share"))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Ranks from 1; ties share the mean of their ranks, nulls are the lowest.

    Without ``by`` no task has all rows: values are counted and dealt by ranges, and each range adds the rows of those below it.
    """
    if by:
        whole, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
        return df.withColumn(out, F.rank().over(whole) + (F.count(F.lit(1)).over(same) - 1) / 2)
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_k")).repartitionByRange("_v").withColumn("_part", F.spark_partition_id())
    upto = F.sum("_k").over(Window.partitionBy("_part").orderBy("_v"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")  # one row a range
    parts = counts.groupBy("_part").agg(F.sum("_k").alias("_n")).withColumn("_below", before).drop("_n")
    ranks = counts.withColumn("_upto", upto).join(F.broadcast(parts), "_part")
    ranks = ranks.select("_v", (F.col("_below") + F.col("_upto") - (F.col("_k") - 1) / 2).alias(out))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def pseudo_observations(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "u") -> DataFrame:
    ranked = average_rank(df, value, by, "_rank")
    if by:
        return ranked.withColumn(out, F.col("_rank") / (F.count(F.lit(1)).over(Window.partitionBy(*by)) + 1)).drop("_rank")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).withColumn(out, F.col("_rank") / (F.col("_n") + 1)).drop("_rank", "_n")


def spells(df: DataFrame, label: str = "label", by: str = "sid", order: str = "dt") -> DataFrame:
    """Run-length encoding: state, first row, length and whether it is the series' last."""
    w = over(by, order)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    runs = df.withColumn("_new", changed).withColumn("spell", F.sum("_new").over(rows(w, Window.unboundedPreceding)))
    out = runs.groupBy(by, "spell").agg(F.first(label).alias("state"), F.min(order).alias("start"), F.count(F.lit(1)).alias("duration"))
    return out.withColumn("open", F.col("spell") == F.max("spell").over(Window.partitionBy(by)))


def transitions(df: DataFrame, label: str = "label", by: str = "sid", order: str = "dt") -> DataFrame:
    """Counts of one-step transitions within series."""
    steps = df.withColumn("previous", F.lag(label).over(over(by, order))).where("previous IS NOT NULL")
    return steps.groupBy("previous", F.col(label).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def crossings(df: DataFrame, level: float, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Rows where the value comes to ``level`` or above from below (up), or falls below it (down)."""
    prev = F.lag(value).over(over(by, order))
    side = F.when((prev < level) & (F.col(value) >= level), "up").when((prev >= level) & (F.col(value) < level), "down")
    return df.withColumn("crossing", side).where("crossing IS NOT NULL")


def preceding_stats(df: DataFrame, k: int, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Mean and population deviation of the ``k`` rows before; null if there are fewer or the deviation is zero."""
    frame = rows(over(by, order), -k, -1)
    sigma = F.stddev_pop(value).over(frame)
    full = (F.count(value).over(frame) == k) & (sigma > 0)
    return df.withColumn("mu", F.when(full, F.avg(value).over(frame))).withColumn("sigma", F.when(full, sigma))


def gap_ranges(df: DataFrame, by: str = "sid", order: str = "dt") -> DataFrame:
    """Months missing between a series' rows, as ranges."""
    ahead = df.select(by, order).distinct().withColumn("_next", F.lead(order).over(over(by, order)))
    first, last = F.add_months(order, 1), F.add_months("_next", -1)
    return ahead.where(F.months_between("_next", order) > 1).select(by, first.alias("gap_from"), last.alias("gap_to"), F.round(F.months_between("_next", order) - 1).cast("long").alias("months"))


def trailing_returns(df: DataFrame, frames: dict[str, int], per_year: int, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Compounded returns of trailing full windows, annualised from over a year on."""
    out = df
    for name, k in frames.items():
        frame = rows(over(by, order), 1 - k)
        growth = F.product(1 + F.col(value)).over(frame)
        whole = F.pow(growth, per_year / k) if k > per_year else growth
        out = out.withColumn(name, F.when(F.count(F.lit(1)).over(frame) == k, whole - 1))
    return out


def interpolate(df: DataFrame, by: str = "sid", order: str = "m", value: str = "v") -> DataFrame:
    """Fills nulls between known rows by straight lines in ``order`` (a number); ends stay null."""
    w = over(by, order)
    back, on = rows(w, Window.unboundedPreceding), rows(w, 0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    x0, x1 = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(on)
    y0, y1 = F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(on)
    return df.withColumn("filled", F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (F.col(order) - x0) / F.when(x1 != x0, x1 - x0)))
