"""Least squares of several regressors with errors that allow for correlated residuals, and what it is used for: realised features,
backcasts, and their test on later months."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles

#: Below this share of the largest eigenvalue of the regressors' correlations the smallest counts as zero.
SINGULAR = 1e-10
CONST = "const"
TRADING_DAYS = 252


def realized_features(df: DataFrame, windows: Sequence[int], drawdown: int, least_days: int, by: Sequence[str] = ("sid",), order: str = "dt", close: str = "close") -> DataFrame:
    """``(by, month, log_rv{w}, log_maxdd)`` from daily closes: trailing statistics at each month's last row.

    Volatility is the deviation of log returns over the last ``w`` rows (from half of them on, 5 at least), annualised, in points; the drawdown is the fall below the
    highest of the last ``drawdown`` closes. Months of fewer than ``least_days`` returns, or with a feature missing, are left out. Only rows up to the month's end count.
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(close) > 0).select(*by, order, F.col(close).cast("double").alias("_c"))
    rows = rows.withColumn("_r", F.log(F.col("_c")) - F.log(F.lag("_c").over(w)))
    for k in windows:
        frame = w.rowsBetween(1 - k, 0)
        rows = rows.withColumn(f"_rv{k}", F.when(F.count("_r").over(frame) >= max(5, k // 2), F.stddev_samp("_r").over(frame) * math.sqrt(TRADING_DAYS) * 100))
    frame = w.rowsBetween(1 - drawdown, 0)
    rows = rows.withColumn("_dd", F.when(F.count("_c").over(frame) >= drawdown // 2, F.greatest(F.lit(0.0), 1 - F.col("_c") / F.max("_c").over(frame))))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    log_rv = lambda k: F.when(last(f"_rv{k}").isNotNull(), F.log(F.greatest(last(f"_rv{k}"), F.lit(1e-6)))).alias(f"log_rv{k}")
    month = rows.groupBy(*by, F.trunc(order, "MM").alias("month")).agg(*map(log_rv, windows), F.log1p(last("_dd")).alias("log_maxdd"), F.count("_r").alias("_days"))
    return month.where(F.col("_days") >= least_days).drop("_days").dropna(subset=[*[f"log_rv{k}" for k in windows], "log_maxdd"])


def _solved(k: int, least: int):
    """From a group's moments: coefficients (constant first), the inverse of X'X, and why there are none."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coefs, inverses, faults, r2s, sigmas = [], [], [], [], []
            for row in batch.to_pylist():
                n, m, my, vy = row["_n"], np.array(row["_m"], dtype=float), row["_my"], row["_vy"]
                coef = inverse = r2 = sigma = None
                fault = "too few rows" if n < max(least, k + 2) else None
                if not fault:
                    c = np.zeros((k, k))
                    c[np.triu_indices(k)] = row["_c"]
                    c = c + np.triu(c, 1).T
                    scale = np.sqrt(np.diag(c))
                    fault = "singular" if not (scale > 0).all() or not np.isfinite(c).all() else None
                    if not fault:
                        own = np.linalg.eigvalsh(c / np.outer(scale, scale))
                        fault = "singular" if own[0] <= SINGULAR * own[-1] else None
                if not fault:
                    p = np.linalg.inv(c / np.outer(scale, scale)) / np.outer(scale, scale)
                    b = p @ np.array(row["_cy"])
                    coef = [my - float(b @ m), *b.tolist()]
                    inverse = (np.block([[np.array([[1 + m @ p @ m]]), -(m @ p)[None, :]], [-(p @ m)[:, None], p]]) / n).ravel().tolist()
                    rss = max(0.0, (vy - float(b @ np.array(row["_cy"]))) * n)
                    r2, sigma = 1 - rss / (n * vy) if vy > 0 else None, math.sqrt(rss / (n - k - 1))
                coefs.append(coef), inverses.append(inverse), faults.append(fault), r2s.append(r2), sigmas.append(sigma)
            keep = [c for c in batch.schema.names if c not in ("_m", "_my", "_vy", "_c", "_cy")]
            arrays = [batch.column(c) for c in keep] + [pa.array(coefs, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64())), pa.array(faults, pa.string()), pa.array(r2s, pa.float64()), pa.array(sigmas, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "_coef", "_inv", "fault", "r2", "sigma"])

    return solve


def least_squares(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """``(by, n, fault, r2, sigma, _coef, _inv)`` for each group: one pass of means and co-moments, then a system of as many equations as regressors.

    Rows with a null among ``y`` and ``xs`` are left out. Collinear or constant regressors (``singular``) and groups under ``least`` rows, or under two more than
    regressors (``too few rows``), are refused: ``fault`` says so and the rest is null.
    """
    k = len(xs)
    rows = df.dropna(subset=[y, *xs]).select(*by, *[F.col(c).cast("double").alias(c) for c in (y, *xs)])
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    moments = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(x) for x in xs]).alias("_m"), F.avg(y).alias("_my"), F.var_pop(y).alias("_vy"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("_c"), F.array(*[F.covar_pop(x, y) for x in xs]).alias("_cy"),
    )
    moments = moments.where("_n > 0")
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in moments.schema if f.name in by)
    out = moments.mapInArrow(_solved(k, least), f"{keys}_n long, _coef array<double>, _inv array<double>, fault string, r2 double, sigma double")
    return out.select(*by, F.col("_n").alias("n"), "fault", "r2", "sigma", "_coef", "_inv")


def _joined(df: DataFrame, fit: DataFrame, by: Sequence[str]) -> DataFrame:
    fit = fit.where("fault IS NULL").select(*by, F.col("n").alias("_fn"), "_coef", "_inv")
    return df.join(fit, list(by)) if by else df.crossJoin(F.broadcast(fit))


def predicted(df: DataFrame, fit: DataFrame, xs: Sequence[str], by: Sequence[str] = (), out: str = "hat") -> DataFrame:
    """Adds the fitted value; groups without a fit are left out."""
    value = sum((F.get("_coef", F.lit(i + 1)) * F.col(x) for i, x in enumerate(xs)), F.get("_coef", F.lit(0)))
    return _joined(df, fit, by).withColumn(out, value).drop("_coef", "_inv", "_fn")


def newey_west(df: DataFrame, y: str, xs: Sequence[str], order: str, lags: int, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """``(by, term, coef, se_ols, se_hac, t_hac, n, r2, sigma, fault)``: a row for each group's constant and regressors.

    ``se_hac`` weighs products of influences up to ``lags`` rows apart by Bartlett's kernel, with the small-sample factor n / (n - terms). A row's influence
    on a coefficient is its residual times a row of the inverse; the lagged ones come from one window of the group. A refused group has one row with its fault.
    """
    terms = [CONST, *xs]
    d = len(terms)
    fit = least_squares(df, y, xs, by, least)
    rows = _joined(df.dropna(subset=[y, *xs, order]).select(*by, order, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]), fit, by)
    x = [F.lit(1.0), *map(F.col, xs)]
    rest = F.col(y) - sum((F.get("_coef", F.lit(i)) * x[i] for i in range(d)), F.lit(0.0))
    rows = rows.withColumn("_e", rest)
    rows = rows.select(*by, order, *[(F.col("_e") * sum((F.get("_inv", F.lit(i * d + j)) * x[j] for j in range(d)), F.lit(0.0))).alias(f"_p{i}") for i in range(d)])
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    back = lambda c: sum(((1 - k / (lags + 1)) * F.coalesce(F.lag(c, k).over(w), F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    for i in range(d):
        rows = rows.withColumn(f"_q{i}", F.col(f"_p{i}") * (F.col(f"_p{i}") + 2 * back(f"_p{i}")))
    hac = rows.groupBy(*by).agg(F.array(*[F.sum(f"_q{i}") for i in range(d)]).alias("_hac"))
    both = fit.join(hac, list(by), "left") if by else fit.crossJoin(F.broadcast(hac))
    n = F.col("n")
    each = [
        F.struct(
            F.lit(name).alias("term"), F.get("_coef", F.lit(i)).alias("coef"), (F.col("sigma") * F.sqrt(F.get("_inv", F.lit(i * d + i)))).alias("se_ols"),
            F.sqrt(F.greatest(F.lit(0.0), F.get("_hac", F.lit(i)) * n / (n - d))).alias("se_hac"),
        )
        for i, name in enumerate(terms)
    ]
    none = F.struct(F.lit(None).cast("string").alias("term"), *[F.lit(None).cast("double").alias(c) for c in ("coef", "se_ols", "se_hac")])
    out = both.withColumn("_t", F.explode(F.when(F.col("fault").isNull(), F.array(*each)).otherwise(F.array(none))))
    out = out.select(*by, "_t.term", "_t.coef", "_t.se_ols", "_t.se_hac", "n", "r2", "sigma", "fault")
    return out.withColumn("t_hac", F.when(F.col("se_hac") > 0, F.col("coef") / F.nullif(F.col("se_hac"), F.lit(0.0)))).select(*by, "term", "coef", "se_ols", "se_hac", "t_hac", "n", "r2", "sigma", "fault")


def backcast(features: DataFrame, observed: DataFrame, xs: Sequence[str], by: Sequence[str] = ("sid",), order: str = "month", value: str = "v", least: int = 24) -> DataFrame:
    """``(by, order, value, is_proxy)``: observed values as they are, before a group's first one the exponential of what a fit of their logarithm on the features gives.

    The fit takes the months that both sides have; groups with fewer than ``least``, or a singular design, keep their observed values only.
    """
    keys = [*by, order]
    known = observed.where(F.col(value) > 0).select(*keys, value)
    fit = least_squares(features.join(known.withColumn("_y", F.log(value)), keys), "_y", xs, by, least)
    first = known.groupBy(*by).agg(F.min(order).alias("_first"))
    early = features.join(first, list(by)) if by else features.crossJoin(F.broadcast(first))
    early = predicted(early.where(F.col(order) < F.col("_first")), fit, xs, by).select(*keys, F.exp("hat").alias(value), F.lit(True).alias("is_proxy"))
    return early.unionByName(known.withColumn("is_proxy", F.lit(False)))


def out_of_sample(df: DataFrame, y: str, xs: Sequence[str], stress: str, split, order: str = "month", by: Sequence[str] = ("sid",), least: int = 24) -> DataFrame:
    """``(by, n, rmse, bias, calm_bias, stress_bias, stress_ratio)`` on rows after ``split`` of a fit on those up to it.

    Calm rows have ``stress`` up to its median among the later rows, stress rows from its 90th percentile on; the ratio is that of mean fitted to mean actual
    values there, ``y`` being a logarithm. Groups without a fit or without later rows have no row.
    """
    rows = df.dropna(subset=[y, *xs])
    fit = least_squares(rows.where(F.col(order) <= F.lit(split)), y, xs, by, least)
    later = predicted(rows.where(F.col(order) > F.lit(split)), fit, xs, by)
    bars = quantiles(later, stress, {"_calm": 0.5, "_stress": 0.9}, by).drop("n")
    later = later.join(bars, list(by)) if by else later.crossJoin(F.broadcast(bars))
    gap = F.col(y) - F.col("hat")
    hot, calm = F.col(stress) >= F.col("_stress"), F.col(stress) <= F.col("_calm")
    return later.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"), F.avg(F.when(calm, gap)).alias("calm_bias"), F.avg(F.when(hot, gap)).alias("stress_bias"),
        F.exp(F.avg(F.when(hot, F.col("hat"))) - F.avg(F.when(hot, F.col(y)))).alias("stress_ratio"),
    ).where("n > 0")
