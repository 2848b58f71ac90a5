"""Nearest neighbours of a stated set of queries among all candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that are broadcast at once: more are answered block by block.
QUERIES = 4096
#: More queries than this are refused, as each block of them reads all candidates.
MOST = 1 << 20
#: Distances, and numbers of vectors, that are worked on at once, whatever the queries, the candidates and their ties.
CELLS = 1 << 18


def closer(q: np.ndarray, ids: np.ndarray, squares: np.ndarray, c: np.ndarray, others: np.ndarray, best: np.ndarray) -> None:
    """Lowers ``best`` where one of these candidates is nearer to a query."""
    sums = squares[:, None] + (c * c).sum(1)[None, :]
    square = sums - 2 * q @ c.T
    square[(ids[:, None] == others[None, :]) | ~np.isfinite(square)] = np.inf
    # A product of matrices loses digits of small distances: what may be the least is measured again. Nothing is nearer than zero.
    close = (square <= np.minimum(square.min(axis=1), best**2)[:, None] + 1e-9 * sums) & np.isfinite(square) & (best > 0)[:, None]
    x, y = np.nonzero(close)
    step = max(1, CELLS // max(1, q.shape[1]))
    for lo in range(0, len(x), step):
        a, b = x[lo : lo + step], y[lo : lo + step]
        np.minimum.at(best, a, np.sqrt(((q[a] - c[b]) ** 2).sum(1)))


def nearest(queries: DataFrame, candidates: DataFrame, key: str, vector: str) -> DataFrame:
    """Euclidean distance from each query to its nearest candidate of another key, by exact differences of the nearest few.

    Candidates stay where they lie and send one row a query and task. A block of queries, of a bounded number, is
    broadcast at once, and meets the candidates in tiles of a bounded size. Queries without any other candidate have no row.
    """
    spark = queries.sparkSession
    n = queries.count()
    if n > MOST:
        raise ValueError(f"{n} queries would read the candidates {-(-n // QUERIES)} times: this is for a stated set of {MOST} at most")
    out = None
    for block in range(max(1, -(-n // QUERIES))):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // QUERIES)))) == block).select(key, vector).toPandas()
        ids = part[key].to_numpy()
        held = spark.sparkContext.broadcast((ids, np.stack(part[vector].to_numpy()).astype(float) if len(part) else np.zeros((0, 0))))

        def least(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            best, squares = np.full(len(ids), np.inf), (q * q).sum(1)
            wide = max(1, min(1024, CELLS // max(1, q.shape[1])))
            for batch in batches:
                for lo in range(0, len(batch) if len(ids) else 0, wide):
                    some = batch.iloc[lo : lo + wide]
                    c, others = np.stack(some[vector].to_numpy()).astype(float), some[key].to_numpy()
                    for at in range(0, len(ids), CELLS // wide):
                        here = slice(at, at + CELLS // wide)
                        closer(q[here], ids[here], squares[here], c, others, best[here])
            yield pd.DataFrame({key: ids, "distance": best})

        one = candidates.select(key, vector).mapInPandas(least, f"{key} long, distance double")
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min("distance").alias("distance")).where("distance < double('infinity')")
