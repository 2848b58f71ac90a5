"""Whether a simple model can tell generated series from real ones, and whether it learns from them what it would learn from real ones.

Fits are linear with a small ridge. A least-squares fit is one aggregate of products. A logistic fit takes a few
steps, each one aggregate of gradient and curvature over the executors: the driver sees as many numbers as there are pairs of
features, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles

#: The ridge on all weights, the intercept too, and what of each class, of generated pairs and of real pairs is fitted on.
RIDGE, TRAIN_SHARE, PAIR_SHARE, REAL_SHARE = 1e-3, 0.7, 0.5, 0.5
STEPS, TOLERANCE = 50, 1e-10


def window_features(df: DataFrame, length: int, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "r") -> DataFrame:
    """``(by, block, mean, deviation)`` of consecutive full blocks of ``length`` rows that have a value; the deviation is that of the population."""
    rows = df.where(F.col(value).isNotNull()).withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / length))
    out = rows.groupBy(*by, "block").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == length).drop("_n")


def one_step_pairs(df: DataFrame, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "r") -> DataFrame:
    """``(by, order, x, y)``: each value with the next of its series; never across series."""
    rows = df.where(F.col(value).isNotNull())
    return rows.withColumn("y", F.lead(value).over(Window.partitionBy(*by).orderBy(order))).where("y IS NOT NULL").select(*by, order, F.col(value).alias("x"), "y")


def drawn(df: DataFrame, ids: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``draw``: a number in [0, 1) from a digest of seed, group and ids, the same for any partitioning. Rows of equal ids share it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*by, *ids]])
    return df.withColumn("draw", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52))


def _cut(df: DataFrame, share: float, n: int, least: int, most: int) -> float:
    """The draw below which lie ``share`` of ``n`` rows, at least ``least`` and at most ``most``: between two order statistics, so exactly as many."""
    k = min(max(least, _rounded(share * n)), most)
    if k >= n:
        return 1.0
    return quantiles(df, "draw", {"cut": (k - 0.5) / (n - 1)}).first()["cut"]


def _rounded(x: float) -> int:
    """Halves go to the even number."""
    return round(x)


def _dot(features: Sequence[str], weights: Sequence[float]) -> Column:
    return sum((F.col(f) * F.lit(float(w)) for f, w in zip(features, weights[:-1], strict=True)), F.lit(float(weights[-1])))


def _logistic(z: Column) -> Column:
    z = F.least(F.lit(60.0), F.greatest(F.lit(-60.0), z))
    return 1 / (1 + F.exp(-z))


def logistic_fit(rows: DataFrame, features: Sequence[str], label: str, weight: str, steps: int = STEPS) -> tuple[list[float], int]:
    """Weights (intercept last) of least mean cross-entropy plus ``RIDGE / 2`` of their squares, and the number of aggregates taken.

    Newton's steps, halved while they don't lower the loss; each evaluation is one aggregate. ``rows`` should be persisted.
    """
    d = len(features) + 1
    ones = [*map(F.col, features), F.lit(1.0)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def at(w: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
        z = _dot(features, w)
        p = _logistic(z)
        base = rows.select(*features, F.col(label).cast("double").alias("_y"), F.col(weight).alias("_w"), z.alias("_z"), p.alias("_p"))
        # log(1 + exp(z)) - y z without overflow
        loss = F.greatest(F.col("_z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - F.col("_y") * F.col("_z")
        curve = F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum("_w"), F.sum(F.col("_w") * loss), *[F.sum(F.col("_w") * (F.col("_p") - F.col("_y")) * x) for x in ones], *[F.sum(curve * ones[i] * ones[j]) for i, j in pairs]]
        got = base.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        total, w = got[0], np.array(w)
        hessian = np.zeros((d, d))
        for (i, j), v in zip(pairs, got[2 + d :], strict=True):
            hessian[i, j] = hessian[j, i] = v / total
        return got[1] / total + RIDGE / 2 * float(w @ w), np.array(got[2 : 2 + d]) / total + RIDGE * w, hessian + RIDGE * np.eye(d)

    w, taken = np.zeros(d), 1
    loss, gradient, hessian = at(w)
    for _ in range(steps):
        if np.abs(gradient).max() < TOLERANCE:
            break
        step = np.linalg.solve(hessian, gradient)
        for k in range(30):
            taken += 1
            new = at(w - step / 2**k)
            if new[0] <= loss:
                break
        if new[0] > loss or (w == w - step / 2**k).all():
            break
        w, (loss, gradient, hessian) = w - step / 2**k, new
    return w.tolist(), taken


def discriminative_score(real: DataFrame, generated: DataFrame, features: Sequence[str], ids: Sequence[str], seed: int = 0, share: float = TRAIN_SHARE) -> DataFrame:
    """One row ``(real_rows, generated_rows, real_recall, generated_recall, score)``: how far from chance a logistic model's balanced accuracy is.

    ``share`` of each class, at least one and all but one at most, is drawn by ``ids`` and ``seed`` for the fit, where both classes weigh the same. Features are
    scaled by mean and deviation of those rows. Rows with a null feature are left out. No row if a class has fewer than two rows, or both fewer than four.
    """
    spark = real.sparkSession
    schema = "real_rows long, generated_rows long, real_recall double, generated_recall double, score double"
    whole = [F.col(f).cast("double").alias(f) for f in features]
    both = drawn(real.select(*ids, *whole).dropna(subset=list(features)), ids, seed, ()).withColumn("label", F.lit(1))
    both = both.unionByName(drawn(generated.select(*ids, *whole).dropna(subset=list(features)), ids, seed + 1, ()).withColumn("label", F.lit(0)))
    both = both.select("label", "draw", *features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r.label: r["count"] for r in both.groupBy("label").count().collect()}
        if min(sizes.get(1, 0), sizes.get(0, 0)) < 2 or sum(sizes.values()) < 4:
            return spark.createDataFrame([], schema)
        cuts = {k: _cut(both.where(F.col("label") == k), share, sizes[k], 1, sizes[k] - 1) for k in (1, 0)}
        fitted = F.col("draw") < F.when(F.col("label") == 1, cuts[1]).otherwise(cuts[0])
        stats = both.where(fitted).agg(*[g(f).alias(f"{g.__name__}_{f}") for f in features for g in (F.avg, F.stddev_pop)], F.sum("label").alias("_1"), F.count(F.lit(1)).alias("_n")).first()
        scaled = [((F.col(f) - stats[f"avg_{f}"]) / (stats[f"stddev_pop_{f}"] or 1.0)).alias(f) for f in features]
        weight = F.when(F.col("label") == 1, 0.5 / stats["_1"]).otherwise(0.5 / (stats["_n"] - stats["_1"])).alias("weight")
        rows = both.select("label", fitted.alias("fitted"), weight, *scaled).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            w, _ = logistic_fit(rows.where("fitted"), features, "label", "weight")
            right = (_logistic(_dot(features, w)) >= 0.5).cast("int") == F.col("label")
            recall = {r.label: r.recall for r in rows.where("NOT fitted").groupBy("label").agg(F.avg(right.cast("double")).alias("recall")).collect()}
        finally:
            rows.unpersist()
        return spark.createDataFrame([(sizes[1], sizes[0], recall[1], recall[0], abs((recall[1] + recall[0]) / 2 - 0.5))], schema)
    finally:
        both.unpersist()


def _line(rows: DataFrame) -> DataFrame:
    """``(a, b, n)`` of y = a + b x with the ridge on both, from one aggregate."""
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("x") * F.col("y")).alias("xy"))
    xx, one = F.col("xx") + RIDGE, 1 + RIDGE
    det = xx * one - F.col("x") * F.col("x")
    return m.select(((xx * F.col("y") - F.col("x") * F.col("xy")) / det).alias("a"), ((one * F.col("xy") - F.col("x") * F.col("y")) / det).alias("b"), "n")


def _error(rows: DataFrame, fit: DataFrame, name: str) -> DataFrame:
    gap = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    return rows.crossJoin(F.broadcast(fit.select("a", "b"))).agg(F.avg(gap * gap).alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))


def _part(pairs: DataFrame, share: float, least: int, keep: int) -> tuple[DataFrame, DataFrame]:
    n = pairs.count()
    cut = _cut(pairs, share, n, least, n - keep) if n > max(least, keep) else 1.0
    return pairs.where(F.col("draw") < cut), pairs.where(F.col("draw") >= cut)


def predictive_score(generated: DataFrame, real: DataFrame, ids: Sequence[str], seed: int = 0, share: float = PAIR_SHARE) -> DataFrame:
    """One row ``(tstr)``: mean squared error on all real pairs ``(x, y)`` of a line fitted on ``share`` of the generated ones. No row under two generated pairs or without real ones."""
    some, _ = _part(drawn(generated, ids, seed), share, 2, 0)
    fit = _line(some).where("n >= 2")
    return _error(real, fit, "tstr").where("tstr_rows > 0").select("tstr")


def tstr_degradation(generated: DataFrame, real: DataFrame, ids: Sequence[str], seed: int = 0) -> DataFrame:
    """One row ``(tstr, trtr, degradation)``: the error of ``predictive_score`` over that of a line fitted on half of the real pairs, on the other half.

    Infinite where the latter is zero. No row where either can't be told: under two generated or four real pairs.
    """
    ids = list(ids)
    fitted, rest = _part(drawn(real, ids, seed), REAL_SHARE, 2, 2)
    n = F.col("trtr_rows") >= 2
    trtr = _error(rest, _line(fitted).where("n >= 2"), "trtr").where(n).select("trtr")
    ratio = F.when(F.col("trtr") == 0, F.lit(float("inf"))).otherwise(F.col("tstr") / F.nullif(F.col("trtr"), F.lit(0.0)))
    return predictive_score(generated, real, ids, seed).crossJoin(F.broadcast(trtr)).select("tstr", "trtr", ratio.alias("degradation"))
