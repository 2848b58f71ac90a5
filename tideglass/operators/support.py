"""How far rows lie from the cloud of reference rows, and how much of a group lies beyond what the reference itself reaches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import quantiles

#: Ridge as a share of the mean variance, the quantile of the reference's own distances, and the share beyond it that flags a group.
RIDGE, QUANTILE, FLAGGED = 1e-9, 0.99, 0.25


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    precision: tuple[tuple[float, ...], ...]
    threshold: float
    n: int

    def distance(self) -> Column:
        """Mahalanobis distance of a row; null where one of the columns is."""
        gaps = [F.col(c) - F.lit(m) for c, m in zip(self.columns, self.mean, strict=True)]
        square = F.lit(0.0)
        for i, a in enumerate(gaps):
            for j in range(i, len(gaps)):
                square = square + a * gaps[j] * F.lit(self.precision[i][j] * (1 if i == j else 2))
        return F.sqrt(F.when(square < 0, 0.0).otherwise(square))  # the greatest of zero and a null would be zero


def support_reference(df: DataFrame, columns: Sequence[str], quantile: float = QUANTILE) -> Reference:
    """Mean and covariance (divisor n - 1, with a small ridge) from one aggregate, and the quantile of the rows' own distances from counts over ranges.

    Rows with a null are left out. Fewer than two rows, or columns without any variance, are refused. The driver sees a number for each pair of columns.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if got.n < 2:
        raise ValueError(f"a reference needs two rows at least, not {got.n}")
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = got[f"c{i}_{j}"]
    if not np.trace(cov) > 0:
        raise ValueError("the reference doesn't vary")
    precision = np.linalg.inv(cov + RIDGE * np.trace(cov) / k * np.eye(k))
    out = Reference(tuple(columns), tuple(got[f"m{i}"] for i in range(k)), tuple(map(tuple, precision.tolist())), float("nan"), got.n)
    bar = quantiles(rows.withColumn("_d", out.distance()), "_d", {"bar": quantile}).first()["bar"]
    return Reference(out.columns, out.mean, out.precision, bar, out.n)


def support(df: DataFrame, reference: Reference, by: Sequence[str]) -> DataFrame:
    """``(by, n, mean, p95, largest, beyond, off_support)``: distances of each group's rows and the share beyond the reference's threshold."""
    rows = df.withColumn("_d", reference.distance()).where("_d IS NOT NULL")
    far = F.avg(F.when(F.col("_d") > reference.threshold, 1.0).otherwise(0.0))
    one = rows.groupBy(*by).agg(F.avg("_d").alias("mean"), F.max("_d").alias("largest"), far.alias("beyond"))
    high = quantiles(rows, "_d", {"p95": 0.95}, by)
    return one.join(high, list(by)).select(*by, "n", "mean", "p95", "largest", "beyond", (F.col("beyond") > FLAGGED).alias("off_support"))
