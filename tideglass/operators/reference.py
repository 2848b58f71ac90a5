"""All statistics of a reference with their bands in one go, and what is held against them.

A series' statistics come from one window pass and one aggregate by its key; resampled histories are keys like any other, so all bands
of all series take one shuffle of the resamples and one of their statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import resample
from .measures import usable_band
from .ranges import quantiles
from .statistics import guarded_corr

#: Share of rows in a tail, blocks that a horizon's statistics need.
TAIL, LEAST_BLOCKS = 0.05, 8
LAGS, HORIZONS = (1, 2, 3, 6, 12), (3, 6)


def names(lags: Sequence[int] = LAGS, horizons: Sequence[int] = HORIZONS) -> list[str]:
    own = ["mean", "std", "skew", "excess_kurtosis"]
    own += [f"acf_{kind}_lag{k}" for kind in ("r", "abs") for k in lags] + ["acf_r_sum", "acf_abs_sum", "leverage", "hill", "max_drawdown"]
    return own + [f"{kind}_{h}" for kind in ("agg_gaussianity", "variance_ratio") for h in horizons]


def statistics(df: DataFrame, by: Sequence[str], order: str, value: str, lags: Sequence[int] = LAGS, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """``(by, n, a column for each of names())`` of each key's series, in ``order``; rows without a value don't count.

    What can't be told is null: deviations of one row, autocorrelations of a constant or beyond the series' length, a tail without losses, horizons of fewer than eight blocks.
    """
    whole = Window.partitionBy(*by)
    w = whole.orderBy(order)
    rows = df.where(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("_x"))
    rows = rows.withColumn("_mean", F.avg("_x").over(whole)).withColumn("_d", F.col("_x") - F.col("_mean")).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("_a", F.abs("_d") - F.avg(F.abs("_d")).over(whole)).withColumn("_i", F.row_number().over(w)).withColumn("_next", F.abs(F.lead("_d").over(w)))
    rows = rows.withColumns({f"_{c}{k}": F.lag(f"_{c}", k).over(w) for c in "da" for k in lags})
    rows = rows.withColumns({f"_s{h}": F.when(F.col("_i") % h == 0, F.sum("_x").over(w.rowsBetween(1 - h, 0))) for h in horizons})
    wealth = F.product(1 + F.col("_x")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_w", wealth).withColumn("_fall", 1 - F.col("_w") / F.greatest(F.lit(1.0), F.max("_w").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    rows = rows.withColumn("_rank", F.row_number().over(whole.orderBy(F.col("_x")))).withColumn("_k", F.greatest(F.lit(1), F.bround(F.col("_n") * TAIL).cast("int")))
    loss = F.when((F.col("_rank") <= F.col("_k") + 1) & (F.col("_x") < 0), -F.col("_x"))
    sums = [F.sum(F.col(f"_{c}") * F.col(f"_{c}")).alias(f"{c}v") for c in "da"] + [F.sum(F.col(f"_{c}") * F.col(f"_{c}{k}")).alias(f"{c}{k}") for c in "da" for k in lags]
    one = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.skewness("_x").alias("skew"), F.kurtosis("_x").alias("excess_kurtosis"), F.var_samp("_x").alias("_v1"), *sums,
        guarded_corr("_x", "_next").alias("leverage"), F.greatest(F.lit(0.0), F.max("_fall")).alias("max_drawdown"), F.max("_k").alias("_k"), F.count(loss).alias("_c"), F.min(loss).alias("_t"), F.sum(F.log(loss)).alias("_l"),
        *[F.count(f"_s{h}").alias(f"_c{h}") for h in horizons], *[F.kurtosis(f"_s{h}").alias(f"_g{h}") for h in horizons], *[F.var_samp(f"_s{h}").alias(f"_v{h}") for h in horizons],
    )
    acf = {f"acf_{kind}_lag{k}": F.when((F.col("n") > k) & (F.col(f"{c}v") > 1e-18), F.try_divide(F.col(f"{c}{k}"), F.col(f"{c}v"))) for kind, c in (("r", "d"), ("abs", "a")) for k in lags}
    one = one.withColumns(acf)
    one = one.withColumns({f"acf_{kind}_sum": sum((F.col(f"acf_{kind}_lag{k}") for k in lags[1:]), F.col(f"acf_{kind}_lag{lags[0]}")) for kind in ("r", "abs")})
    mean_log = (F.col("_l") - (F.col("_k") + 1) * F.log("_t")) / F.col("_k")
    one = one.withColumn("hill", F.when((F.col("_c") == F.col("_k") + 1) & (mean_log > 0), F.try_divide(F.lit(1.0), mean_log)))
    enough = lambda h: F.col(f"_c{h}") >= LEAST_BLOCKS
    one = one.withColumns({f"agg_gaussianity_{h}": F.when(enough(h), F.col(f"_g{h}")) for h in horizons} | {f"variance_ratio_{h}": F.when(enough(h) & (F.col("_v1") > 0), F.try_divide(F.col(f"_v{h}"), h * F.col("_v1"))) for h in horizons})
    return one.select(*by, "n", *names(lags, horizons))


def long(wide: DataFrame, by: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """``(by, stat, value)``, nulls and what isn't finite as null."""
    value = lambda s: F.when(F.abs(F.col(s)) < float("inf"), F.col(s))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), value(s).alias("value")) for s in stats])).alias("e")
    return wide.select(*by, each).select(*by, "e.stat", "e.value")


def _usual(lags: Sequence[int], horizons: Sequence[int]):
    return lambda df, by, order, value: long(statistics(df, by, order, value, lags, horizons), by, names(lags, horizons))


def bands(df: DataFrame, by: str, order: str, value: str, paths: int, restart: float, seed: int, level: float = 0.9, length: int | None = None, of=None, lags: Sequence[int] = LAGS, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """``(by, stat, value, lo, hi, n)``: each statistic of each history, and the percentile band of it over ``paths`` resampled histories.

    All statistics of a series share its resamples, which are ``length`` rows long (the history's own length by default): give the length of what will be held
    against them, as most statistics depend on it. ``n`` counts the resamples in which the statistic could be told. ``of`` makes ``(by, stat, value)`` of rows by a list of keys.
    """
    of = of or _usual(lags, horizons)
    rows = df.where(F.col(value).isNotNull()) if isinstance(value, str) else df
    history = resample.numbered(rows, [by], order)
    sizes = history.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    drawn = resample.resampled(resample.block_draws(df.sparkSession, paths, sizes, restart, seed, by, length), history.drop(order), by)
    found = of(drawn, [by, "path"], "m", value)
    ends = quantiles(found, "value", {"lo": (1 - level) / 2, "hi": (1 + level) / 2}, [by, "stat"])
    return of(history, [by], order, value).join(ends, [by, "stat"], "left").select(by, "stat", "value", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def pair_statistics(df: DataFrame, by: Sequence[str], order: str, value: Sequence[str]) -> DataFrame:  # noqa: ARG001
    """``(by, stat, value)``: correlation of two columns, and of their distances from their means."""
    a, b = value
    whole = Window.partitionBy(*by)
    rows = df.withColumns({f"_{c}": F.abs(F.col(c) - F.avg(c).over(whole)) for c in (a, b)})
    one = rows.groupBy(*by).agg(guarded_corr(a, b).alias("correlation"), guarded_corr(f"_{a}", f"_{b}").alias("abs_correlation"))
    return long(one, by, ["correlation", "abs_correlation"])


def pair_bands(df: DataFrame, pairs: Sequence[tuple[str, str]], by: str, order: str, value: str, paths: int, restart: float, seed: int, level: float = 0.9, length: int | None = None) -> DataFrame:
    """``(pair, stat, value, lo, hi, n)``: the pairs' statistics over the dates that both have, each pair resampled by rows of both. A pair without common dates has no rows."""
    spark = df.sparkSession
    told = spark.createDataFrame([(f"{a}~{b}", a, b) for a, b in pairs], "pair string, one string, two string")
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("_k"), order, F.col(value).alias("_v"))
    first = told.join(rows.select("_k", order, F.col("_v").alias("x")), F.col("one") == F.col("_k")).select("pair", "two", order, "x")
    both = first.join(rows.select(F.col("_k"), F.col(order).alias("_o"), F.col("_v").alias("y")), (F.col("two") == F.col("_k")) & (F.col(order) == F.col("_o"))).select("pair", order, "x", "y")
    return bands(both, "pair", order, ("x", "y"), paths, restart, seed, level, length, pair_statistics)


def judged(made: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """``(by, stat, value, lo, hi, outside, verdict)``: the mean of a statistic over generated paths against the reference's band.

    ``made`` has ``(by, stat, value)``, one row a path. Verdicts are ``pass``, ``fail``, ``missing`` (no path could tell the statistic, or there is no path) and ``unbanded`` (no
    usable band); ``outside`` is the distance beyond the band in its widths, 0 within.
    """
    means = made.groupBy(by, "stat").agg(F.avg("value").alias("_value"))
    both = reference.select(by, "stat", "lo", "hi").join(means, [by, "stat"], "left")
    usable, value = usable_band(F.col("lo"), F.col("hi")), F.col("_value")
    verdict = F.when(value.isNull(), "missing").when(~usable, "unbanded").when(value.between(F.col("lo"), F.col("hi")), "pass").otherwise("fail")
    beyond: Column = F.greatest(F.lit(0.0), F.col("lo") - value, value - F.col("hi")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return both.select(by, "stat", value.alias("value"), "lo", "hi", F.when(usable & value.isNotNull(), beyond).alias("outside"), verdict.alias("verdict"))


def clauses(report: DataFrame, by: str, names_: Sequence[str] | None = None) -> DataFrame:
    """``(by, stats, usable, outside, missing, outside_names, holds)`` of a ``judged`` report, over the named statistics or all.

    ``usable`` counts the statistics that have a band and a value, ``outside`` those beyond it. A missing value never helps: ``holds`` needs no statistic outside and none missing.
    """
    rows = report.where(F.col("stat").isin(*names_)) if names_ is not None else report
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("stats"), F.count_if(F.col("verdict").isin("pass", "fail")).alias("usable"), F.count_if(F.col("verdict") == "fail").alias("outside"), F.count_if(F.col("verdict") == "missing").alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "fail", F.col("stat")))).alias("outside_names"),
    )
    return out.withColumn("holds", (F.col("outside") == 0) & (F.col("missing") == 0))


def severity_errors(df: DataFrame, by: Sequence[str], order: str, value: str, target: float) -> DataFrame:
    """``(by, quarters, worst, error)``: each path's worst sum of three consecutive rows, from its first row on, in percent below zero, against a target; paths under three rows have none."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(value).isNotNull()).withColumn("_q", F.floor((F.row_number().over(w) - 1) / 3))
    quarter = rows.groupBy(*by, "_q").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c")).where("_c = 3")
    one = quarter.groupBy(*by).agg(F.count(F.lit(1)).alias("quarters"), (100 * F.greatest(F.lit(0.0), -F.min("_s"))).alias("worst"))
    return one.withColumn("error", F.abs(F.col("worst") - target))
