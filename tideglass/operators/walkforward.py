"""Policies judged on years they haven't seen: expanding folds, quarterly weights from what came before, and what the year then brought.

Moments of all folds are running sums: each row enters once, whatever the number of folds. A weight solver sees one row of
moments for each rebalancing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles

#: Rows between rebalancings, the ridge of the optimiser, the trailing rows and the drift of the banded rule.
EVERY, RIDGE, TRAILING, BAND = 3, 1e-4, 12, 0.05


def clipped_weights(mean: np.ndarray, cov: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The unconstrained optimum without its negative weights, scaled to one; even weights if none is positive."""
    w = np.clip(np.linalg.solve(cov + ridge * np.eye(len(mean)), mean), 0, None)
    return w / w.sum() if w.sum() > 1e-12 else np.full(len(mean), 1 / len(mean))


def long_only_weights(mean: np.ndarray, cov: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of at least zero that maximise mean'w - w'(cov + ridge)w / 2, scaled to one; even weights if no mean is positive.

    Active sets after Lawson and Hanson: assets join by their gradient and leave where a step meets zero.
    """
    a, n = cov + ridge * np.eye(len(mean)), len(mean)
    w, free = np.zeros(n), np.zeros(n, dtype=bool)
    tiny = 1e-12 * max(1.0, float(np.abs(mean).max()))
    while True:
        gradient = mean - a @ w
        if free.all() or gradient[~free].max() <= tiny:
            break
        free[np.where(free, -np.inf, gradient).argmax()] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.solve(a[np.ix_(free, free)], mean[free])
            if (z[free] > 0).all():
                w = z
                break
            short = free & (z <= 0)
            step = (w[short] / (w[short] - z[short])).min()
            w = w + step * (z - w)
            free &= w > 1e-15
            w[~free] = 0
            if not free.any():
                break
        if not free.any():
            break
    return w / w.sum() if w.sum() > 1e-12 else np.full(n, 1 / n)


SOLVERS = {"clipped": clipped_weights, "long_only": long_only_weights}


def _named(assets: Sequence[str], mapping: Mapping[str, float]) -> list[float]:
    if missing := sorted(set(mapping) - set(assets)):
        raise ValueError(f"no asset {', '.join(missing)}; there are {', '.join(assets)}")
    total = sum(mapping.values())
    return [mapping.get(a, 0.0) / total for a in assets]


def _positioned(df: DataFrame, assets: Sequence[str], years: Sequence[int], start, by: Sequence[str], order: str) -> DataFrame:
    """Rows from ``start`` on with all assets, the moments of the rows before each, and their place in a fold (null outside)."""
    rows = df.dropna(subset=[order, *assets]).select(*by, order, *[F.col(a).cast("double").alias(a) for a in assets])
    rows = rows.where(F.col(order) >= F.lit(start)) if start is not None else rows
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    before, trailing = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-TRAILING, -1)
    pairs = [(a, b) for i, a in enumerate(assets) for b in assets[i:]]
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(before)).withColumn("_mean", F.array(*[F.avg(a).over(before) for a in assets]))
    rows = rows.withColumn("_cov", F.array(*[F.covar_samp(a, b).over(before) for a, b in pairs])).withColumn("_grown", F.array(*[F.product(1 + F.col(a)).over(trailing) for a in assets])).withColumn("_trailing", F.count(F.lit(1)).over(trailing))
    rows = rows.withColumn("fold", F.when(F.year(order).isin(*years), F.year(order)))
    own = Window.partitionBy(*by, "fold").orderBy(order)
    return rows.withColumn("_place", F.row_number().over(own) - 1).where("fold IS NOT NULL")


def _solved(rows: DataFrame, assets: Sequence[str], solver: str, ridge: float) -> DataFrame:
    k, solve = len(assets), SOLVERS[solver]

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, mean, cov in zip(*(batch.column(c).to_pylist() for c in ("_n", "_mean", "_cov")), strict=True):
                if n < 2 or any(v is None for v in [*mean, *cov]):
                    out.append(None)
                    continue
                c = np.zeros((k, k))
                c[np.triu_indices(k)] = cov
                out.append(solve(np.array(mean), c + np.triu(c, 1).T, ridge).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "w"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(weights, f"{schema}, w array<double>")


def _banded(target: Sequence[float], k: int) -> Column:
    """The target where a year's growth has moved a weight by more than the band, else what growth has made of it."""
    wanted = F.array(*[F.lit(t) for t in target])
    total = sum((F.get("_grown", F.lit(i)) * target[i] for i in range(k)), F.lit(0.0))
    moved = F.array(*[F.get("_grown", F.lit(i)) * target[i] / F.nullif(total, F.lit(0.0)) for i in range(k)])
    far = F.aggregate(F.zip_with(moved, wanted, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return F.when((F.col("_trailing") < 2) | F.get(moved, F.lit(0)).isNull() | (far > BAND), wanted).otherwise(moved)


def weights(df: DataFrame, assets: Sequence[str], years: Sequence[int], policies: Mapping[str, object], start=None, by: Sequence[str] = (), order: str = "dt", ridge: float = RIDGE) -> DataFrame:
    """``(by, fold, policy, order, block, known, w)``: each policy's weights at each rebalancing of each fold, from the ``known`` rows before it only.

    A policy is a solver's name (``clipped``, ``long_only``), a mapping of assets to weights, or ``("banded", mapping)``. Solvers need two rows; without them the weights are null.
    """
    at = _positioned(df, assets, years, start, by, order).where(F.col("_place") % EVERY == 0)
    at = at.select(*by, "fold", order, F.floor(F.col("_place") / EVERY).alias("block"), "_n", "_mean", "_cov", "_grown", "_trailing")
    parts = []
    for name, policy in policies.items():
        if isinstance(policy, str):
            one = _solved(at, assets, policy, ridge)
        elif isinstance(policy, Mapping):
            one = at.withColumn("w", F.array(*[F.lit(x) for x in _named(assets, policy)]))
        else:
            one = at.withColumn("w", _banded(_named(assets, policy[1]), len(assets)))
        parts.append(one.select(*by, "fold", F.lit(name).alias("policy"), order, "block", F.col("_n").alias("known"), "w"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def walk_forward(df: DataFrame, assets: Sequence[str], years: Sequence[int], policies: Mapping[str, object], start=None, by: Sequence[str] = (), order: str = "dt", ridge: float = RIDGE) -> DataFrame:
    """``(by, fold, policy, rows, terminal_log_wealth, max_drawdown)``: what each policy's weights earn over each fold's year, held between rebalancings.

    Drawdowns are from a peak of one at least. A fold whose policy has no weights somewhere has null results; years without rows have none. A total loss gives a null log.
    """
    rows = _positioned(df, assets, years, start, by, order).select(*by, "fold", order, F.floor(F.col("_place") / EVERY).alias("block"), *assets)
    held = weights(df, assets, years, policies, start, by, order, ridge).drop(order, "known")
    both = rows.join(held, [*by, "fold", "block"])
    both = both.withColumn("r", sum((F.get("w", F.lit(i)) * F.col(a) for i, a in enumerate(assets)), F.lit(0.0)))
    w = Window.partitionBy(*by, "fold", "policy").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_wealth", F.product(1 + F.col("r")).over(w)).withColumn("_dd", 1 - F.col("_wealth") / F.greatest(F.lit(1.0), F.max("_wealth").over(w)))
    whole = F.count("r") == F.count(F.lit(1))
    log = F.log(F.when(F.product(1 + F.col("r")) > 0, F.product(1 + F.col("r"))))
    return both.groupBy(*by, "fold", "policy").agg(F.count(F.lit(1)).alias("rows"), F.when(whole, log).alias("terminal_log_wealth"), F.when(whole, F.greatest(F.lit(0.0), F.max("_dd"))).alias("max_drawdown"))


def drawdown_surprise(realized: DataFrame, ensemble: DataFrame, by: Sequence[str] = (), level: float = 0.95, depth: str = "max_drawdown") -> DataFrame:
    """``(by, paths, predicted, surprise)``: the realised depth less the quantile of the ensemble's depths, one row a path in ``ensemble``."""
    bar = quantiles(ensemble, depth, {"predicted": level}, by).withColumnRenamed("n", "paths")
    both = realized.select(*by, depth).join(bar, list(by)) if by else realized.select(depth).crossJoin(F.broadcast(bar))
    return both.select(*by, "paths", "predicted", (F.col(depth) - F.col("predicted")).alias("surprise"))


def alpha_by_window(df: DataFrame, own: str, twin: str, by: Sequence[str] = ("sid",), order: str = "dt") -> DataFrame:
    """``(by, order, alpha)``: change of the log of own over twin wealth since the boundary before; summed, they are the whole. Boundaries without two positive wealths are left out."""
    rel = F.log(F.col(own) / F.col(twin))
    rows = df.where((F.col(own) > 0) & (F.col(twin) > 0)).withColumn("_rel", rel)
    return rows.withColumn("alpha", F.col("_rel") - F.lag("_rel").over(Window.partitionBy(*by).orderBy(order))).where("alpha IS NOT NULL").select(*by, order, "alpha")
