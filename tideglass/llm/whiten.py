"""Whitening of embeddings from an exact scatter matrix (operator 13).

Entries become whole numbers. Each block of rows is cut into bit planes: one bit of one dimension, of 64 rows
in a word. The cross-product of two dimensions is the weighted sum of the set bits that two planes share, so
all sums are exact whatever the blocks and their order. Blocks add up in Spark; the driver sees one number for
each pair of dimensions, centres them as whole numbers and takes the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * entry) + SHIFT. Nothing below depends on the shift, so it is left out of all sums.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Whole numbers saturate here; a block holds so many rows at most, and about so many bits in all.
LARGEST, ROWS, BLOCK_BITS = 1 << 61, 8192, 1 << 29


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector isn't null and holds finite entries only, as array<double>."""
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(F.col(column).isNotNull() & finite).withColumn(column, F.col(column).cast("array<double>"))


def whole(column: pa.Array, size: int) -> np.ndarray:
    """floor(SCALE * entry) of a batch, a row for each vector."""
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * SCALE), -LARGEST, LARGEST).astype(np.int64)


def planes(y: np.ndarray) -> np.ndarray:
    """Bits of non-negative rows as words: dimension, bit, word of 64 rows."""
    bits = max(1, int(y.max()).bit_length())
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), dtype=np.int64)
    padded[: len(y)] = y
    packed = [np.ascontiguousarray(np.packbits(((padded >> b) & 1).astype(bool), axis=0).T).view(np.uint64) for b in range(bits)]
    return np.stack(packed, axis=1)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of a block's columns and of the products of each two (upper triangle), as Python's whole numbers."""
    low = x.min(axis=0)
    words = planes(x - low)
    size, bits, _ = words.shape
    small = 2 * bits + len(x).bit_length() <= 61  # all weighted counts fit 64 bits
    weight = np.array([1 << b for b in range(bits)], dtype=np.int64 if small else object)
    ones = np.bitwise_count(words).sum(axis=2, dtype=np.int64)
    sums = ((ones if small else ones.astype(object)) @ weight).astype(object)
    products = np.zeros((size, size), dtype=object)
    for i in range(size):
        for b in range(bits):
            if ones[i, b]:
                shared = np.bitwise_count(words[i:] & words[i, b]).sum(axis=2, dtype=np.int64)
                products[i, i:] += ((shared if small else shared.astype(object)) @ weight).astype(object) * (1 << b)
    low, n = low.astype(object), len(x)
    products = products + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return sums + n * low, np.triu(products)


@dataclass(frozen=True)
class Whitening:
    """What the rows have given: count, sums without SHIFT, unit components (columns), eigenvalues and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def by(self) -> np.ndarray:
        """Divides by the root of an eigenvalue; directions in which nothing varies give 0."""
        return self.components * np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64 bits where they hold it, else Python's whole numbers."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums))
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.by


def commonest_size(vectors: DataFrame, column: str) -> int:
    found = vectors.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def _summed(vectors: DataFrame, column: str, size: int) -> list:
    """Rows (i, j, v): products of dimensions i <= j; sums have i = -1, the count i = -2."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(size, dtype=object), np.zeros((size, size), dtype=object)
        rows = max(64, min(ROWS, BLOCK_BITS // (64 * size) // 64 * 64))
        for batch in batches:
            x = whole(batch.column(0), size)
            for at in range(0, len(x), rows):
                s, p = scatter(x[at : at + rows])
                n, sums, products = n + len(x[at : at + rows]), sums + s, products + p
        if n:
            i, j = np.triu_indices(size)
            first, second = [-2, *[-1] * size, *i.tolist()], [0, *range(size), *j.tolist()]
            values = [Decimal(int(v)) for v in (n, *sums, *products[i, j])]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "v"])

    return vectors.select(column).mapInArrow(blocks, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()


def fit(vectors: DataFrame, column: str, size: int, components: int = COMPONENTS) -> Whitening | None:
    """None without rows."""
    found = {(r.i, r.j): int(r.v) for r in _summed(vectors, column, size)}
    if not found:
        return None
    n, sums = found[-2, 0], [found[-1, d] for d in range(size)]
    # n * n * covariance, centred in whole numbers before anything is rounded
    centred = [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    covariance = np.array([[v / (n * n) for v in row] for row in centred])
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1][:components], vectors_[:, ::-1][:, :components]
    values = np.where(values > values[0] * size * np.finfo(float).eps, values, 0.0)
    signs = np.sign(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(vectors_.shape[1])])
    return Whitening(n, tuple(sums), vectors_ * signs, values, sum(centred[d][d] for d in range(size)) / (n * n))


def identity_error(vectors: DataFrame, column: str, size: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over the components along which the rows vary."""
    k = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(model.centred(whole(batch.column(0), size)))
            total, products = total + w.sum(axis=0), products + w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array([*[-1] * k, *i], pa.int32()), pa.array([*range(k), *j], pa.int32()), pa.array([*total, *products[i, j]], pa.float64())], ["i", "j", "v"])

    got = {(r.i, r.j): r.v / model.n for r in vectors.select(column).mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    varying = [i for i in range(k) if model.values[i] > 0]
    return max((abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i in varying for j in varying if i <= j), default=0.0)


def whiten_embeddings(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)`` for each usable vector and component.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another length than
    the commonest (of equally common ones the longest); empty vectors give no rows. Repeated rows and ids count and
    come back each for themselves, null ids too. Entries of 2^51 and more saturate. ``deviation`` is null where the exact
    value exceeds 64 bits; ``deviation_exact`` has it as a decimal. Components along which nothing varies have 0 for
    whitened and explained, and don't enter ``identity_error``. No usable rows give an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    rows = usable(vectors.select(id_column, column), column)
    size = commonest_size(rows, column)
    rows = rows.where(F.size(column) == size)
    model = fit(rows, column, size, components) if size else None
    if model is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(rows, column, size, model), len(model.values)
    explained = model.values / model.trace if model.trace else np.zeros(k)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            c = model.centred(whole(batch.column(1), size))
            w = model.whitened(c)
            most = int(np.abs(c).max())
            exact = (c if most * most * size < 1 << 63 else c.astype(object)) ** 2
            exact = [int(v) for v in exact.sum(axis=1)]
            deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            index = pa.array(np.repeat(np.arange(len(w)), k))
            columns = [
                batch.column(0).take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(w) * k, model.n)), deviation.take(index),
                pa.array(w.reshape(-1)), pa.array(np.tile(explained, len(w))), pa.array(np.full(len(w) * k, error)), pa.array([Decimal(v) for v in exact], pa.decimal128(38, 0)).take(index),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(outputs, schema)
