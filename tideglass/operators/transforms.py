"""Transforms of monthly series: fitted splices, declared gaps, de-smoothing, smoothing, benchmarking."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed
from .windows import over, rows


def overlap_fit(target: DataFrame, donor: DataFrame, kind: str, low=None, high=None, least: int = 2, order: str = "dt", value: str = "v") -> DataFrame:
    """One row ``(a, b, n)``: ``target = a + b * donor`` on common dates of the window; no row under ``least`` of them.

    Kinds: ``regression``, ``level_map`` (mean difference), ``ratio`` (mean ratio), ``loglog``
    (regression of logarithms).
    """
    both = target.select(order, F.col(value).alias("y")).join(donor.select(order, F.col(value).alias("x")), order)
    if low is not None:
        both = both.where(F.col(order) >= F.lit(low))
    if high is not None:
        both = both.where(F.col(order) <= F.lit(high))
    x, y = F.col("x"), F.col("y")
    if kind == "loglog":
        both = both.where("x > 0 AND y > 0").select(F.log("x").alias("x"), F.log("y").alias("y"))
    n = F.count(F.lit(1)).alias("n")
    if kind in ("regression", "loglog"):
        fit = both.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"), n)
        fit = fit.withColumn("b", F.try_divide("c", "v")).withColumn("a", F.col("my") - F.col("b") * F.col("mx"))
    elif kind == "level_map":
        fit = both.agg(F.avg(y - x).alias("a"), F.lit(1.0).alias("b"), n)
    elif kind == "ratio":
        fit = both.agg(F.lit(0.0).alias("a"), F.avg(F.try_divide(y, x)).alias("b"), n)
    else:
        raise ValueError(f"unknown kind of fit: {kind}")
    return fit.where(F.col("n") >= least).select("a", "b", "n")


def fixed_fit(donor: DataFrame, a: float, b: float) -> DataFrame:
    """Constants in the shape of a fit: nothing is read to find them."""
    return donor.sparkSession.createDataFrame([(a, b, None)], "a double, b double, n long")


def splice(target: DataFrame, donor: DataFrame, fit: DataFrame, loglog: bool = False, order: str = "dt", value: str = "v") -> DataFrame:
    """The target with the fitted donor before its first date, flagged ``is_proxy``; actual rows are never touched."""
    first = target.agg(F.min(order).alias("_first"))
    x = F.col(value)
    fitted = F.exp(F.col("a") + F.col("b") * F.log(x)) if loglog else F.col("a") + F.col("b") * x
    before = donor.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col(order) < F.col("_first")))
    proxy = before.crossJoin(F.broadcast(fit)).select(order, fitted.alias(value), F.lit(True).alias("is_proxy"))
    return proxy.unionByName(target.select(order, value, F.lit(False).alias("is_proxy")))


def overlap_error(target: DataFrame, donor: DataFrame, fit: DataFrame, order: str = "dt", value: str = "v") -> DataFrame:
    """Root mean square of the target less the fitted donor on common dates."""
    both = target.select(order, F.col(value).alias("y")).join(donor.select(order, F.col(value).alias("x")), order).crossJoin(F.broadcast(fit))
    gap = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    return both.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(F.lit(1)).alias("overlap"))


def two_donor_fit(wide: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """``y = a + b1 * x1 + b2 * x2`` by the normal equations, from one aggregate."""
    both = wide.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    c = lambda p, q: F.covar_pop(p, q)
    s = both.agg(c(x1, x1).alias("c11"), c(x2, x2).alias("c22"), c(x1, x2).alias("c12"), c(x1, y).alias("c1"), c(x2, y).alias("c2"), F.avg(y).alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.count(F.lit(1)).alias("n"))
    det = F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12")
    s = s.withColumn("b1", F.try_divide(F.col("c1") * F.col("c22") - F.col("c2") * F.col("c12"), det)).withColumn("b2", F.try_divide(F.col("c2") * F.col("c11") - F.col("c1") * F.col("c12"), det))
    return s.withColumn("a", F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).select("a", "b1", "b2", "n")


def fill_declared_gaps(df: DataFrame, declared: DataFrame, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Midpoints of both neighbours for declared months only, and only where the month is missing and neither neighbour is."""
    known = df.select(by, order, value)
    want = declared.select(by, order).distinct().join(known.select(by, order), [by, order], "left_anti")
    ask = want.select(by, F.col(order).alias("_at"), F.explode(F.array(F.add_months(order, -1), F.add_months(order, 1))).alias(order))
    fill = ask.join(known, [by, order]).groupBy(by, "_at").agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n")).where("_n = 2")
    return known.withColumn("is_proxy", F.lit(False)).unionByName(fill.select(by, F.col("_at").alias(order), value, F.lit(True).alias("is_proxy")))


def geltner(df: DataFrame, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """De-smoothing by the first autocorrelation, held to 0 to 0.95: (x - phi * previous x) / (1 - phi); the first row stays."""
    whole, w = Window.partitionBy(by), over(by, order)
    out = df.withColumn("_d", F.col(value) - F.avg(value).over(whole)).withColumn("_p", F.col("_d") * F.lag("_d").over(w))
    phi = F.try_divide(F.sum("_p").over(whole), F.sum(F.col("_d") * F.col("_d")).over(whole))
    out = out.withColumn("phi", F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.coalesce(phi, F.lit(0.0)))))
    truth = F.coalesce((F.col(value) - F.col("phi") * F.lag(value).over(w)) / (1 - F.col("phi")), F.col(value))
    return out.withColumn("truth", truth).drop("_d", "_p")


def recover_truth(df: DataFrame, theta: Sequence[float], by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Inverts ``x = sum of theta[j] * truth j rows ago`` row by row; rows without a value are left out.

    Rows stream by in order and only the last ``len(theta) - 1`` truths are held, so a series of any length is one pass.
    """
    k, weights = len(theta) - 1, [float(t) for t in theta]

    def step(last: tuple, x: float) -> tuple:
        truth = (x - sum(w * t for w, t in zip(weights[1:], last, strict=False))) / weights[0]
        return (truth, *last)[:k], (truth,)

    return streamed(df.where(F.col(value).isNotNull()), [by], order, [value], tuple, step, ["truth"])


def fit_smoothing(df: DataFrame, kmax: int = 3, default_k: int = 2, step: float = 0.05, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Moving-average smoothing weights of each series: for every order up to ``kmax``, the weights of a grid on
    the simplex, led by the first, under which the recovered truth has the least autocorrelation; then the
    order of the least information criterion. Nearly no smoothing gives ``fell_back``.

    The grid is data: candidates are joined to series and scored in parallel, a series never shared
    between tasks more than once for each order.
    """
    spark = df.sparkSession
    orders = spark.createDataFrame([(k,) for k in range(1, kmax + 1)], "k int")
    work = df.select(by, order, value).crossJoin(F.broadcast(orders))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["k"].iloc[0])
        x = group.sort_values(order)[value].to_numpy(dtype=float)
        theta, objective = _least_autocorrelation(x, k, step)
        score = len(x) * math.log(objective + 1e-8) + 2 * k + (0.0 if k == default_k else 1e-6)
        return pd.DataFrame({by: [group[by].iloc[0]], "k": [k], "theta": [theta.tolist()], "score": [score]})

    found = work.groupBy(by, "k").applyInPandas(best, f"{by} {dict(df.dtypes)[by]}, k int, theta array<double>, score double")
    least = found.groupBy(by).agg(F.min_by(F.struct("k", "theta"), F.struct("score", "k")).alias("e"))
    return least.select(by, "e.k", "e.theta", (F.col("e.theta")[0] >= 0.9).alias("fell_back"))


def _least_autocorrelation(x: np.ndarray, k: int, step: float) -> tuple[np.ndarray, float]:
    """All candidates at once: one column of the recursion for each."""
    points = round(1 / step)
    tails = np.array([c for c in itertools.product(range(points + 1), repeat=k) if sum(c) < points], dtype=float) * step
    head = 1 - tails.sum(axis=1)
    theta = np.concatenate([head[:, None], tails], axis=1)
    theta = theta[theta[:, 0] >= theta[:, 1:].max(axis=1)]
    theta = theta[np.argsort(-theta[:, 0], kind="stable")]  # no smoothing at all comes first and stays on ties
    truth = np.zeros((len(x), len(theta)))
    for i in range(len(x)):
        truth[i] = (x[i] - sum(theta[:, j] * truth[i - j] for j in range(1, k + 1) if i >= j)) / theta[:, 0]
    d = truth - truth.mean(axis=0)
    v = (d * d).sum(axis=0)
    total = sum((np.where(v > 0, (d[j:] * d[:-j]).sum(axis=0) / np.where(v > 0, v, 1), 0.0) ** 2 for j in range(1, k + 1)), np.zeros(len(theta)))
    at = int(np.argmin(total))
    return theta[at], float(total[at])


def smooth(df: DataFrame, theta: Sequence[float], by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Reported values: weights over the present and earlier rows; rows before the first repeat it."""
    if abs(sum(theta) - 1) > 1e-6:
        raise ValueError(f"weights sum to {sum(theta)}, not to 1")
    w = over(by, order)
    first = F.first(value).over(rows(w, Window.unboundedPreceding))
    lags = [F.col(value) if i == 0 else F.coalesce(F.lag(value, i).over(w), first) for i in range(len(theta))]
    return df.withColumn("reported", sum((c * x for c, x in zip(theta[1:], lags[1:], strict=True)), theta[0] * lags[0]))


def quarter_marks(df: DataFrame, weight: float, by: str = "sid", order: str = "dt", value: str = "r") -> DataFrame:
    """Quarter-end marks ``weight * quarter + (1 - weight) * previous mark``, the one before the first being zero; a quarter without values returned nothing."""
    quarter = df.groupBy(by, F.trunc(order, "quarter").alias("q")).agg((F.product(1 + F.col(value)) - 1).alias("x"))

    def step(mark: float, x: float) -> tuple:
        mark = weight * x + (1 - weight) * mark
        return mark, (mark,)

    return streamed(quarter, [by], "q", ["x"], float, step, ["mark"])


def ljung_box(acf: DataFrame, sizes: DataFrame, by: str = "sid") -> DataFrame:
    """Q over the lags of an autocorrelation table ``(by, lag, acf)`` and series sizes ``(by, n)``."""
    both = acf.join(sizes, by)
    return both.groupBy(by, "n").agg(F.sum(F.try_divide(F.col("acf") * F.col("acf"), F.col("n") - F.col("lag"))).alias("_q")).select(by, (F.col("n") * (F.col("n") + 2) * F.col("_q")).alias("q"))


def denton(df: DataFrame, by: str, order: str, value: str, anchor: str, every: int = 12) -> DataFrame:
    """Additive first-difference benchmarking: the path nearest in changes whose every ``every``-row sum is the block's ``anchor``.

    The last rows of a series that don't fill a block are free. Series are small (one path), so each is one
    linear system; series are spread over tasks.
    """
    kinds = dict(df.dtypes)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        z, n = group[value].to_numpy(dtype=float), len(group)
        blocks = n // every
        if not blocks:
            return pd.DataFrame({by: group[by], order: group[order], "benchmarked": z})
        difference = np.diff(np.eye(n), axis=0)
        sums = np.kron(np.eye(blocks), np.ones(every))
        sums = np.concatenate([sums, np.zeros((blocks, n - blocks * every))], axis=1)
        gap = group[anchor].to_numpy(dtype=float)[: blocks * every : every] - sums @ z
        system = np.block([[difference.T @ difference, sums.T], [sums, np.zeros((blocks, blocks))]])
        move = np.linalg.lstsq(system, np.concatenate([np.zeros(n), gap]), rcond=None)[0][:n]
        return pd.DataFrame({by: group[by], order: group[order], "benchmarked": z + move})

    return df.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, {order} {kinds[order]}, benchmarked double")

