"""Statistics of return series and ensembles.

``by`` groups, ``order`` runs within a group. Where a statistic can't be computed (too few rows, no
variance, no losses), it is null, never NaN and never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles
from .windows import average_rank, block_sums, drawdown_episodes, over, pseudo_observations


def guarded_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation; null where either side has no variance, where Spark would divide by zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(scale > 0, F.covar_pop(x, y) / F.when(scale > 0, scale))


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation, population skew and excess kurtosis in one pass."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"), F.count(value).alias("n"))


def autocorrelations(df: DataFrame, lags: Sequence[int], by: str, order: str, value: str, absolute: bool = False) -> DataFrame:
    """One row for each group and lag: autocovariance over variance, both divided by n; ``absolute`` is of deviations' sizes.

    Lags are an array of shifted columns of one window pass, not a join for each lag.
    """
    whole = Window.partitionBy(by)
    base = df.select(by, order, F.col(value).alias("_x"))
    centre = base.withColumn("_d", F.col("_x") - F.avg("_x").over(whole))
    if absolute:
        centre = centre.withColumn("_d", F.abs("_d")).withColumn("_d", F.col("_d") - F.avg("_d").over(whole))
    w = over(by, order)
    products = [F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in lags]
    shifted = centre.select(by, "_d", *[F.lag("_d", k).over(w).alias(f"_l{k}") for k in lags])
    sums = shifted.groupBy(by).agg(F.sum(F.col("_d") * F.col("_d")).alias("_v"), F.count(F.lit(1)).alias("_n"), *products)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("s")) for k in lags])).alias("e")
    out = sums.select(by, "_v", "_n", each).select(by, F.col("e.lag").alias("lag"), F.when((F.col("_n") > F.col("e.lag")) & (F.col("_v") > 1e-18), F.try_divide(F.col("e.s"), F.col("_v"))).alias("acf"))
    return out


def half_life(acf1: Column) -> Column:
    """Months in which a first-order process halves; null where it doesn't revert, zero without any dependence."""
    size = F.abs(acf1)
    return F.when(size == 0, 0.0).when(size < 1, F.log(F.lit(0.5)) / F.log(size))


def hill_left(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """Hill's tail index of losses: k is the share of rows, rounded half to even, 1 at least; null without k + 1 losses."""
    w = Window.partitionBy(*by)
    ranked = df.select(*by, (-F.col(value)).alias("_loss")).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(F.desc("_loss"))))
    ranked = ranked.withColumn("_k", F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("int"))).where("_i <= _k + 1")
    agg = ranked.groupBy(*by).agg(F.max("_k").alias("k"), F.min("_loss").alias("_t"), F.count(F.lit(1)).alias("_c"), F.sum(F.when(F.col("_loss") > 0, F.log("_loss"))).alias("_s"))
    mean_log = (F.col("_s") - (F.col("k") + 1) * F.log("_t")) / F.col("k")
    usable = (F.col("_c") == F.col("k") + 1) & (F.col("_t") > 0)
    return agg.select(*by, F.col("k").cast("long").alias("k"), F.when(usable, F.try_divide(F.lit(1.0), F.when(mean_log > 0, mean_log))).alias("alpha"))


def hill_two_sided(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """Hill's index of absolute values, k rounded up: another estimator than ``hill_left``."""
    w = Window.partitionBy(*by)
    ranked = df.select(*by, F.abs(value).alias("_x")).where("_x > 0").withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(F.desc("_x"))))
    ranked = ranked.withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") * share).cast("int"))).where("_i <= _k")
    agg = ranked.groupBy(*by).agg(F.max("_k").alias("k"), (F.avg(F.log("_x")) - F.log(F.min("_x"))).alias("_m"))
    return agg.select(*by, F.col("k").cast("long").alias("k"), F.try_divide(F.lit(1.0), F.when(F.col("_m") > 0, F.col("_m"))).alias("alpha"))


def block_kurtosis(df: DataFrame, k: int, by: Sequence[str], within: Sequence[str], order: str, value: str, least: int) -> DataFrame:
    """Excess kurtosis of block sums, pooled over ``by``; blocks are cut within ``within``."""
    sums = block_sums(df, k, list(within), order, value)
    return sums.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kurtosis("s").alias("_k")).select(*by, "n", F.when(F.col("n") >= least, F.col("_k")).alias("kurtosis"))


def variance_ratio(df: DataFrame, k: int, within: str, order: str, value: str, least: int) -> DataFrame:
    """Variance of pooled block sums over k times that of single rows."""
    sums = block_sums(df, k, within, order, value).agg(F.var_samp("s").alias("vk"), F.count(F.lit(1)).alias("n"))
    one = df.agg(F.var_samp(value).alias("v1"))
    return sums.crossJoin(F.broadcast(one)).select(F.lit(k).alias("k"), "n", F.when((F.col("n") >= least) & (F.col("v1") > 0), F.try_divide(F.col("vk"), k * F.col("v1"))).alias("ratio"))


def leverage(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Correlation of a return with the next one's distance from the mean."""
    ahead = F.abs(F.lead(value).over(over(by, order)) - F.avg(value).over(Window.partitionBy(by)))
    return df.withColumn("_next", ahead).groupBy(by).agg(guarded_corr(value, "_next").alias("leverage"))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    both = average_rank(average_rank(df, a, by, "_ra"), b, by, "_rb")
    return both.groupBy(*by).agg(guarded_corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def episode_summary(df: DataFrame, by: str = "sid", least: int = 1) -> DataFrame:
    """Medians and rank correlation of the depths and lengths of drawdown episodes."""
    e = drawdown_episodes(df, by)
    mid = quantiles(e, "depth", {"depth": 0.5}, [by]).withColumnRenamed("n", "episodes").join(quantiles(e, "duration", {"duration": 0.5}, [by]).drop("n"), by)
    rho = spearman(e, "depth", "duration", [by]).select(by, "rho")
    enough = F.col("episodes") >= least
    return mid.join(rho, by).select(by, "episodes", *[F.when(enough, F.col(c)).alias(c) for c in ("depth", "duration", "rho")])


def pair_correlations(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """All pairs' correlations in one aggregate of the wide table."""
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    one = wide.agg(*[guarded_corr(x, y).alias(f"{x}_{y}") for x, y in pairs])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}_{y}").alias("corr")) for x, y in pairs])).alias("e")
    return one.select(each).select("e.*")


def crisis_lift(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation in the worst tenth of ``a``, less that of all rows."""
    both = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    bar = quantiles(both, a, {"_bar": 0.1}).drop("n")
    low = F.col(a) <= F.col("_bar")
    return both.crossJoin(F.broadcast(bar)).agg((guarded_corr(F.when(low, F.col(a)), F.when(low, F.col(b))) - guarded_corr(a, b)).alias("lift"), F.count(F.when(low, 1)).alias("n"))


def tail_dependence(wide: DataFrame, a: str, b: str, share: float, least: int) -> DataFrame:
    """Joint frequency of both in their lower (upper) tail over ``share``."""
    both = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    u = pseudo_observations(pseudo_observations(both, a, (), "_ua"), b, (), "_ub")
    low, high = (F.col("_ua") <= share) & (F.col("_ub") <= share), (F.col("_ua") > 1 - share) & (F.col("_ub") > 1 - share)
    agg = u.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(low, 1.0).otherwise(0.0)).alias("_l"), F.avg(F.when(high, 1.0).otherwise(0.0)).alias("_u"))
    enough = F.col("n") * share >= least
    return agg.select("n", F.when(enough, F.col("_l") / share).alias("lower"), F.when(enough, F.col("_u") / share).alias("upper"))


def var_es(df: DataFrame, by: Sequence[str], value: str, level: float) -> DataFrame:
    """Value at risk (linear quantile of losses) and the mean loss from there on."""
    loss = df.select(*by, (-F.col(value)).alias("loss"))
    bar = quantiles(loss, "loss", {"var": level}, by).drop("n")
    both = loss.join(bar, list(by)) if by else loss.crossJoin(F.broadcast(bar))
    return both.groupBy(*by, "var").agg(F.avg(F.when(F.col("loss") >= F.col("var"), F.col("loss"))).alias("es"))


def joint_score(df: DataFrame, by: Sequence[str], value: str, forecast: DataFrame, level: float) -> DataFrame:
    """Mean Fissler-Ziegel score of forecasts ``(var, es)``; lower is better; null where es isn't positive."""
    both = (df.join(forecast, list(by)) if by else df.crossJoin(F.broadcast(forecast))).where("es > 0")
    over_ = F.greatest(F.lit(0.0), -F.col(value) - F.col("var"))
    return both.groupBy(*by).agg(F.avg(over_ / ((1 - level) * F.col("es")) + F.col("var") / F.col("es") + F.log("es") - 1).alias("score"))


def log_likelihood(n1: Column, n0: Column, p: Column) -> Column:
    """Of ``n1`` successes and ``n0`` failures under ``p``; no count asks nothing of its logarithm."""
    return F.when(n1 > 0, n1 * F.log(F.when(p > 0, p))).otherwise(0.0) + F.when(n0 > 0, n0 * F.log(F.when(p < 1, 1 - p))).otherwise(0.0)


def coverage_tests(hits: DataFrame, by: str, order: str, level: float, least: int = 10) -> DataFrame:
    """Kupiec's and Christoffersen's likelihood ratios of ``hits (by, order, hit)``, pooled over groups; steps don't cross groups."""
    step = hits.withColumn("_prev", F.lag("hit").over(over(by, order)))
    n = step.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("x"),
        *[F.sum(F.when((F.col("_prev") == F.lit(bool(i))) & (F.col("hit") == F.lit(bool(j))), 1).otherwise(0)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)],
    )
    c = {k: F.col(k).cast("double") for k in ("n", "x", "n00", "n01", "n10", "n11")}
    p01, p11 = F.coalesce(F.try_divide(c["n01"], c["n00"] + c["n01"]), F.lit(0.0)), F.coalesce(F.try_divide(c["n11"], c["n10"] + c["n11"]), F.lit(0.0))
    p = F.try_divide(c["n01"] + c["n11"], c["n00"] + c["n01"] + c["n10"] + c["n11"])
    pof = -2 * (log_likelihood(c["x"], c["n"] - c["x"], F.lit(1 - level)) - log_likelihood(c["x"], c["n"] - c["x"], F.try_divide(c["x"], c["n"])))
    alt = log_likelihood(c["n01"], c["n00"], p01) + log_likelihood(c["n11"], c["n10"], p11)
    ind = F.when(F.col("x") >= least, -2 * (log_likelihood(c["n01"] + c["n11"], c["n00"] + c["n10"], p) - alt))
    out = n.select("n", F.col("x").alias("exceedances"), F.greatest(F.lit(0.0), pof).alias("lr_pof"), F.greatest(F.lit(0.0), ind).alias("_i"))
    out = out.select("n", "exceedances", "lr_pof", F.when(F.col("exceedances") >= least, F.col("_i")).alias("lr_ind"))
    return out.withColumn("lr_cc", F.col("lr_pof") + F.col("lr_ind")).withColumn("p_cc", F.exp(-F.col("lr_cc") / 2)).withColumn("p_pof", chi2_tail_1(F.col("lr_pof")))


def chi2_tail_1(x: Column) -> Column:
    """P(chi-square of one degree > x) by Abramowitz and Stegun's formula 7.1.26 for erfc, good to 1.5e-7."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z)


def midrank_pit(values: DataFrame, sample: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mid-rank place of each value in the sample's distribution: both are ranked together once, never paired."""
    both = values.select(*by, F.col(value).alias("_x"), F.lit(0).alias("_s")).unionByName(sample.select(*by, F.col(value).alias("_x"), F.lit(1).alias("_s")))
    upto = Window.partitionBy(*by).orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
    same, whole = Window.partitionBy(*by, "_x"), Window.partitionBy(*by)
    ranked = both.withColumn("_hi", F.sum("_s").over(upto)).withColumn("_eq", F.sum("_s").over(same)).withColumn("_n", F.sum("_s").over(whole))
    return ranked.where("_s = 0 AND _n > 0").select(*by, F.col("_x").alias(value), ((F.col("_hi") - F.col("_eq") / 2) / F.col("_n")).alias("pit"))


def ks_uniform(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Largest distance between the distribution of values and the uniform one."""
    w = Window.partitionBy(*by)
    i, n = F.row_number().over(w.orderBy(value)), F.count(F.lit(1)).over(w)
    return df.withColumn("_i", i).withColumn("_n", n).groupBy(*by).agg(F.max(F.greatest(F.col("_i") / F.col("_n") - F.col(value), F.col(value) - (F.col("_i") - 1) / F.col("_n"))).alias("ks"))


def rank_auc(df: DataFrame, positive: Column, value: str) -> DataFrame:
    """Chance that a positive row's value exceeds a negative one's, ties counting half; nulls are the lowest.

    Rows are counted by value and the values dealt by ranges, so that no task has them all; each range adds the negatives of those below it.
    """
    p = F.coalesce(positive, F.lit(False))
    counts = df.select(F.col(value).alias("_v"), p.alias("_p")).groupBy("_v").agg(F.count_if("_p").alias("_1"), F.count_if(~F.col("_p")).alias("_0"))
    dealt = counts.repartitionByRange("_v").withColumn("_part", F.spark_partition_id())
    below = F.sum("_0").over(Window.partitionBy("_part").orderBy("_v")) - F.col("_0") / 2
    parts = dealt.withColumn("_u", F.col("_1") * below).groupBy("_part").agg(*[F.sum(c).alias(c) for c in ("_1", "_0", "_u")])
    before = F.sum("_0").over(Window.orderBy("_part")) - F.col("_0")  # one row a range
    n1, n0 = F.sum("_1"), F.sum("_0")
    top = F.sum(F.col("_u") + F.col("_1") * F.col("_b"))
    return parts.withColumn("_b", before).agg(n1.alias("positives"), n0.alias("negatives"), F.try_divide(top, n1 * n0).alias("auc"))


def signed_rank(df: DataFrame, difference: Column) -> DataFrame:
    """Wilcoxon's rank sums of non-zero differences, and their rank-biserial effect."""
    d = df.select(difference.alias("_d")).where("_d <> 0").withColumn("_a", F.abs("_d"))
    r = average_rank(d, "_a", (), "_r")
    up, down = F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0))
    return r.agg(F.count(F.lit(1)).alias("n"), up.alias("w_plus"), down.alias("w_minus"), F.try_divide(up - down, up + down).alias("effect"))


def percentile_fan(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """``(by, n, p5, ...)``: quantiles of each group's values, named in hundredths; groups without values have no row."""
    return quantiles(df, value, {f"p{round(100 * p)}": p for p in points}, by)


def robust_gap(df: DataFrame, by: str, value: str) -> DataFrame:
    """Distance of each group's mean from the median of all means, in median absolute deviations."""
    means = df.groupBy(by).agg(F.avg(value).alias("mean"))
    centre = quantiles(means, "mean", {"_m": 0.5}).drop("n")
    off = means.crossJoin(F.broadcast(centre)).withColumn("_o", F.abs(F.col("mean") - F.col("_m")))
    mad = quantiles(off, "_o", {"_d": 0.5}).drop("n")
    return off.crossJoin(F.broadcast(mad)).select(by, "mean", F.try_divide("_o", "_d").alias("gap"))
