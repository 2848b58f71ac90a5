"""Series extended on both ends from others: segments chained onto a level, and donors fitted on common months.

All work on many series at once by their keys: fits are aggregates by key, extensions are anti-joins. An observed value is never overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import regression
from .statistics import guarded_corr

#: Common months that a join of segments, and a fit, need.
LEAST_SEGMENT, LEAST_FIT = 24, 60


def _known(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """One row a key and date: null dates and values don't count, of several the mean does."""
    return df.where(F.col(order).isNotNull() & F.col(value).isNotNull()).groupBy(*by, order).agg(F.avg(F.col(value).cast("double")).alias(value))


def joined_segments(segments: Sequence[DataFrame], least: int = LEAST_SEGMENT, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "v") -> tuple[DataFrame, DataFrame]:
    """``(by, order, value)`` of segments from the newest to the oldest, each put onto the level of those before it; and ``(by, join, offset, rmse, overlap, fault)``.

    The older one moves by the mean difference on common months and gives the months before the first of the newer ones. With fewer than ``least`` common months a key
    keeps what it has (``fault`` says so); months that the newer ones have always win.
    """
    keys = [*by, order]
    whole, told = _known(segments[0], by, order, value), []
    for k, segment in enumerate(segments[1:], 1):
        older = _known(segment, by, order, value).withColumnRenamed(value, "_o")
        common = whole.join(older, keys)
        gap = F.col(value) - F.col("_o")
        fit = common.groupBy(*by).agg(F.avg(gap).alias("offset"), F.stddev_pop(gap).alias("rmse"), F.count(F.lit(1)).alias("overlap"))
        seen = older.select(*by).distinct().join(whole.select(*by).distinct(), list(by), "left_semi").join(fit, list(by), "left")
        few = F.coalesce("overlap", F.lit(0)) < least
        told.append(seen.select(*by, F.lit(k).alias("join"), "offset", "rmse", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.when(few, "too few common months").alias("fault")))
        first = whole.groupBy(*by).agg(F.min(order).alias("_first"))
        before = older.join(fit.where(F.col("overlap") >= least), list(by)).join(first, list(by)).where(F.col(order) < F.col("_first"))
        whole = before.select(*keys, (F.col("_o") + F.col("offset")).alias(value)).unionByName(whole)
    none = whole.limit(0).select(*by, F.lit(0).alias("join"), *[F.lit(None).cast("double").alias(c) for c in ("offset", "rmse")], F.lit(None).cast("long").alias("overlap"), F.lit(None).cast("string").alias("fault"))
    return whole, reduce(DataFrame.unionByName, told, none)


def spread(a: DataFrame, b: DataFrame, floor=None, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "v") -> DataFrame:
    """a less b on the months that both have, from ``floor`` on."""
    both = _known(a, by, order, value).join(_known(b, by, order, value).withColumnRenamed(value, "_b"), [*by, order])
    both = both.where(F.col(order) >= F.lit(floor)) if floor is not None else both
    return both.select(*by, order, (F.col(value) - F.col("_b")).alias(value))


def _fitted(target: DataFrame, donors: DataFrame, xs: Sequence[str], low, high, least: int, by: Sequence[str], order: str, value: str, log: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The target, the donors in the fit's space, and the fit of each key."""
    known = _known(target, by, order, value)
    rows = donors.dropna(subset=[order, *xs])
    if log:
        for x in xs:
            rows = rows.where(F.col(x) > 0).withColumn(x, F.log(x))
    y = known.where(F.col(value) > 0).withColumn("_y", F.log(value)) if log else known.withColumn("_y", F.col(value))
    both = rows.join(y.select(*by, order, "_y"), [*by, order])
    both = both.where(F.col(order) >= F.lit(low)) if low is not None else both
    both = both.where(F.col(order) <= F.lit(high)) if high is not None else both
    return known, rows, regression.least_squares(both, "_y", xs, by, least)


def extended(target: DataFrame, donors: DataFrame, xs: Sequence[str], rule: str, low=None, high=None, least: int = LEAST_FIT, log: bool = False, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "v") -> DataFrame:
    """``(by, order, value, is_proxy, rule)``: the target, and on every month that it lacks and the donors have, before it, after it or within, what their fit gives.

    The fit is a least-squares line or plane on common months from ``low`` to ``high``, of logarithms if ``log``. Keys with fewer than ``least`` such months, or whose
    donors are collinear or constant, keep their own months only.
    """
    keys = [*by, order]
    known, rows, fit = _fitted(target, donors, xs, low, high, least, by, order, value, log)
    missing = rows.join(known.select(*keys), keys, "left_anti")
    hat = F.exp("_hat") if log else F.col("_hat")
    proxy = regression.predicted(missing, fit, xs, by, "_hat").select(*keys, hat.alias(value), F.lit(True).alias("is_proxy"))
    return proxy.unionByName(known.select(*keys, value, F.lit(False).alias("is_proxy"))).withColumn("rule", F.lit(rule))


def overlap_report(target: DataFrame, donors: DataFrame, xs: Sequence[str], low=None, high=None, least: int = LEAST_FIT, log: bool = False, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "v") -> DataFrame:
    """``(by, n, coefficients, rmse, corr, fault)`` of the fit that ``extended`` uses, on its own months and in its own space."""
    known, rows, fit = _fitted(target, donors, xs, low, high, least, by, order, value, log)
    both = rows.join(known, [*by, order])
    both = both.where(F.col(order) >= F.lit(low)) if low is not None else both
    both = both.where(F.col(order) <= F.lit(high)) if high is not None else both
    both = both.where(F.col(value) > 0).withColumn(value, F.log(value)) if log else both
    gap = F.col(value) - F.col("_hat")
    found = regression.predicted(both, fit, xs, by, "_hat").groupBy(*by).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), guarded_corr(value, "_hat").alias("corr"))
    return fit.join(found, list(by), "left").select(*by, "n", F.col("_coef").alias("coefficients"), "rmse", "corr", "fault")


#: Common months that a sum of returns, and a check against an index, need.
LEAST_SUM, LEAST_CHECK = 12, 24


def collateral_return(excess: DataFrame, rate: DataFrame, least: int = LEAST_SUM, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "v") -> tuple[DataFrame, DataFrame]:
    """``(by, order, value)``: excess plus risk-free returns on common months; and ``(by, common, excess_from, excess_to, fault)``.

    Months of the excess return before the first common one have no total: they are reported as an era, never filled with zero. Keys with fewer than ``least`` common months have a fault and no rows.
    """
    keys = [*by, order]
    own = _known(excess, by, order, value)
    both = own.join(_known(rate, by, order, value).withColumnRenamed(value, "_r"), keys)
    found = both.groupBy(*by).agg(F.count(F.lit(1)).alias("common"), F.min(order).alias("_first"))
    early = own.join(found, list(by)).where(F.col(order) < F.col("_first")).groupBy(*by).agg(F.min(order).alias("excess_from"), F.max(order).alias("excess_to"))
    few = F.coalesce("common", F.lit(0)) < least
    told = own.select(*by).distinct().join(found.drop("_first"), list(by), "left").join(early, list(by), "left")
    told = told.select(*by, F.coalesce("common", F.lit(0)).alias("common"), "excess_from", "excess_to", F.when(few, "too few common months").alias("fault"))
    total = both.join(found.where(F.col("common") >= least).select(*by), list(by), "left_semi")
    return total.select(*keys, (F.col(value) + F.col("_r")).alias(value)), told


def return_check(spot: DataFrame, level: DataFrame, least: int = LEAST_CHECK, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "v") -> DataFrame:
    """``(by, n, correlation, fault)``: of a return with the log change of an index since its row before, on common months; too few of them is a fault."""
    log = F.log(F.greatest(F.col(value), F.lit(1e-9)))
    moves = _known(level, by, order, value).withColumn("_m", log - F.lag(log).over(Window.partitionBy(*by).orderBy(order))).where("_m IS NOT NULL").drop(value)
    own = _known(spot, by, order, value)
    found = own.join(moves, [*by, order]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), guarded_corr(value, "_m").alias("correlation"))
    n = F.coalesce("n", F.lit(0))
    out = own.select(*by).distinct().join(found, list(by), "left")
    return out.select(*by, n.alias("n"), F.when(n >= least, F.col("correlation")).alias("correlation"), F.when(n < least, "too few common months").alias("fault"))


def stepped_index(steps: DataFrame, months: DataFrame, member: str = "sid", order: str = "dt", rate: str = "rate", base: float = 100.0) -> DataFrame:
    """``(order, index, members)``: an evenly weighted geometric index of rates that change at stated dates, in each of ``months``.

    A month takes each member's last rate in force by then (of several of one date the largest), over its first one. Months before all members have begun have
    none; a rate that is null or not positive is no step. Steps and months meet in one ordered pass by member.
    """
    known = steps.where((F.col(rate) > 0) & F.col(order).isNotNull()).groupBy(member, order).agg(F.max(rate).cast("double").alias("_rate"))
    grid = months.where(F.col(order).isNotNull()).select(order).distinct()
    members = known.select(member).distinct()  # a row a member
    asks = grid.crossJoin(F.broadcast(members)).select(member, order, F.lit(None).cast("double").alias("_rate"), F.lit(True).alias("_ask"))
    w = Window.partitionBy(member).orderBy(order, "_ask").rowsBetween(Window.unboundedPreceding, 0)
    rows = known.withColumn("_ask", F.lit(False)).unionByName(asks)
    rows = rows.withColumn("_now", F.last("_rate", ignorenulls=True).over(w)).withColumn("_first", F.first("_rate", ignorenulls=True).over(w)).where("_ask AND _now IS NOT NULL")
    whole = members.agg(F.count(F.lit(1)).alias("_n"))
    one = rows.groupBy(order).agg((base * F.exp(F.avg(F.log(F.col("_now") / F.col("_first"))))).alias("index"), F.count(F.lit(1)).alias("members"))
    return one.crossJoin(F.broadcast(whole)).where(F.col("members") == F.col("_n")).select(order, "index", "members")


def pinned_front(observed: DataFrame, index: DataFrame, rule: str, order: str = "dt", value: str = "v") -> DataFrame:
    """``(order, value, is_proxy, rule)``: an index put before the first observed month, at the level at which its last month there meets that month; observed months stay."""
    known = _known(observed, [], order, value)
    start = known.agg(F.min(order).alias("_first"), F.min_by(value, order).alias("_level"))
    front = index.where(F.col(value).isNotNull()).select(order, value).crossJoin(F.broadcast(start)).where(F.col(order) < F.col("_first"))
    last = front.agg(F.max_by(value, order).alias("_end"))
    proxy = front.crossJoin(F.broadcast(last)).select(order, (F.col(value) * F.try_divide("_level", "_end")).alias(value), F.lit(True).alias("is_proxy"))
    return proxy.unionByName(known.select(order, value, F.lit(False).alias("is_proxy"))).withColumn("rule", F.lit(rule))


def ratio_front(primary: DataFrame, top: DataFrame, bottom: DataFrame, scale: float = 100.0, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "v") -> DataFrame:
    """``(by, order, value, source)``: the primary series, and before its first date ``scale * top / bottom`` on the dates that both have; a zero bottom gives no row.

    A key that the primary lacks has ratios throughout.
    """
    keys = [*by, order]
    known = _known(primary, by, order, value)
    both = _known(top, by, order, value).join(_known(bottom, by, order, value).withColumnRenamed(value, "_b"), keys).withColumn(value, scale * F.try_divide(value, "_b")).where(F.col(value).isNotNull())
    first = known.groupBy(*by).agg(F.min(order).alias("_first"))
    early = (both.join(first, list(by), "left") if by else both.crossJoin(F.broadcast(first))).where(F.col("_first").isNull() | (F.col(order) < F.col("_first")))
    return early.select(*keys, value, F.lit("ratio").alias("source")).unionByName(known.select(*keys, value, F.lit("primary").alias("source")))
