"""Quality classifier: Naive Bayes support vectors (operator 4).

Indicators of word n-grams and of n-grams of word shapes are scaled by the log-count ratio of the two
classes; a linear hinge-loss model is fitted to them by dual coordinate descent, and its margins are
turned into probabilities on rows that the fit didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import SPACED, grams, hashed_words, text_slices

#: Labelled ids that the model is fitted to at most, those of the lowest hash, one row of each; bytes of their features at most, of 4 each.
FIT_ROWS, FIT_BYTES = 10_000, 64 << 20
#: Hashed features; texts a feature must be in; smoothing, cost, rounds, seed.
FEATURES, MIN_TEXTS, SMOOTHING, COST, EPOCHS, SEED = 1 << 20, 5, 1.0, 1.0, 20, 20_250_101


def shapes(hashes: np.ndarray, bounds: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small number for each word: its case, its signs and digits, and whether it repeats the word before in its text."""
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122) | (data >= 128)
    n = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (upper, lower, digit)]
    up, low, dig = (c[ends] - c[starts] for c in n)
    signs = np.minimum(ends - starts - up - low - dig, 3)
    case = np.where(up + low == 0, 0, np.where((up > 1) & (low <= up // 4), 3, np.where(up > 0, 2, 1)))
    again = np.zeros(len(hashes), dtype=np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    again[bounds[bounds < len(again)]] = 0
    return (((case * 4 + signs) * 2 + (dig > 0)) * 2 + again + 1).astype(np.uint64)


def features(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sorted distinct feature numbers of each text: words and pairs of words, and one to three shapes in a row."""
    for low, high, data, offsets in text_slices(batch):
        words, bounds, starts, ends = hashed_words(data, offsets, SPACED)
        shape = shapes(words, bounds, data, starts, ends)
        for i in range(high - low):
            own, form = words[bounds[i] : bounds[i + 1]], shape[bounds[i] : bounds[i + 1]]
            found = np.concatenate([grams(own, 1), grams(own, 2), *(grams(form, k) for k in (1, 2, 3))])
            yield np.unique((found % np.uint64(FEATURES)).astype(np.int32))


@dataclass
class Model:
    """``scale``: log-count ratios; ``weights``: the hinge-loss model over scaled features of unit length; ``slope`` and ``shift``: the logistic curve."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> float:
        s = self.scale[x]
        norm = float(np.sqrt(s @ s))
        return (float(s @ self.weights[x]) / norm if norm else 0.0) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -500, 500))))


def fit(index: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Model:
    """A model of ``labels`` (0 or 1); the features of text i are ``index[bounds[i]:bounds[i + 1]]``.

    With one class only, or none, every score is the smoothed share of label 1. A fifth of the texts is kept
    apart for the curve. Features and their values are held once, as compact arrays.
    """
    labels, size = np.asarray(labels), np.diff(bounds)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), shift=float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        return model
    order = np.random.default_rng(SEED).permutation(len(labels))
    apart = order[: len(order) // 5]
    train = order[len(order) // 5 :] if len(set(labels[order[len(order) // 5 :]].tolist())) == 2 else order
    kind = np.full(len(labels), -1, dtype=np.int8)
    kind[train] = labels[train]
    kind = np.repeat(kind, size)
    count = [np.bincount(index[kind == c], minlength=FEATURES).astype(np.float32) for c in (0, 1)]
    del kind
    ratio = [c + np.float32(SMOOTHING) for c in count]
    model.scale = (np.log(ratio[1] / ratio[1].sum(dtype=np.float64)) - np.log(ratio[0] / ratio[0].sum(dtype=np.float64))).astype(np.float32)
    model.scale[count[0] + count[1] < min(MIN_TEXTS, len(train) // 4 + 1)] = 0
    del count, ratio
    used = model.scale[index] != 0
    held = np.concatenate([[0], np.cumsum(used)])[bounds]
    index = index[used]
    values = model.scale[index]
    for low, high in zip(held[:-1].tolist(), held[1:].tolist(), strict=True):
        own = values[low:high]
        own /= np.sqrt(own @ own) or 1.0
    sign = np.where(labels[train] == 1, 1.0, -1.0)
    cost = np.where(sign > 0, COST * len(sign) / (2 * (sign > 0).sum()), COST * len(sign) / (2 * (sign < 0).sum()))
    weights, bias = dual_descent(index, values, np.stack([held[train], held[train + 1]], axis=1), sign, cost, FEATURES)
    model.weights, model.bias = weights.astype(np.float32), bias
    seen = apart if len(set(labels[apart].tolist())) == 2 else order
    margin = np.array([values[held[i] : held[i + 1]] @ model.weights[index[held[i] : held[i + 1]]] + bias for i in seen])
    model.slope, model.shift = logistic(margin, labels[seen])
    return model


def dual_descent(index: np.ndarray, values: np.ndarray, rows: np.ndarray, sign: np.ndarray, cost: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent: ``(weights, bias)``; row i has ``values`` of features ``index`` from ``rows[i, 0]`` to ``rows[i, 1]``.

    The bias is a feature that is always 1.
    """
    weights, bias, dual = np.zeros(n), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(SEED)
    square = np.array([values[a:b] @ values[a:b] + 1 for a, b in rows.tolist()], dtype=np.float64)
    for _ in range(EPOCHS):
        most = 0.0
        for i in rng.permutation(len(rows)).tolist():
            low, high = rows[i]
            x, v = index[low:high], values[low:high]
            slope = sign[i] * (v @ weights[x] + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            if (step := new - dual[i]) != 0:
                dual[i] = new
                weights[x] += step * sign[i] * v
                bias += step * sign[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return weights, float(bias)


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton's method with smoothed targets."""
    up, down = (label == 1).sum(), (label != 1).sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, float(np.log((up + 1) / (down + 1)))])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        gradient = x.T @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), gradient)
        at -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """The model of labelled rows that aren't held out.

    At most ``rows`` ids, those of the lowest hash, with one row each (of several texts that of the lowest hash), and of
    these, in the same order, as many as have ``size`` bytes of features together. That is all the driver gets.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked.where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "h")), pa.array([x.tobytes() for x in features(batch)], pa.binary())], ["id", "label", "h", "x"])

    known = docs.select(F.col(id_col).cast("long").alias("id"), "text").join(F.broadcast(marked), "id").select("id", "label", F.xxhash64("text").alias("h"), "text")
    known = known.mapInArrow(numbered, "id long, label int, h long, x binary").groupBy("id").agg(F.min_by(F.struct("label", "x"), "h").alias("e"))
    scratch = Scratch(docs.sparkSession, "quality")
    known = scratch.save(known.select("id", F.xxhash64("id").alias("place"), "e.*"), "labelled")
    sizes = known.select("place", "id", F.octet_length("x").alias("n")).toArrow().sort_by([("place", "ascending"), ("id", "ascending")])
    fits = np.cumsum(np.array(sizes["n"], dtype=np.int64)) <= size
    last = np.array(sizes["place"])[fits][-1] if fits.any() else None
    got = known.where(F.col("place") <= int(last) if last is not None else F.lit(False)).select("id", "label", "x").orderBy("id").toArrow().combine_chunks()
    scratch.drop("labelled")
    labels = np.array(got["label"], dtype=np.int64)
    x = got["x"].combine_chunks() if got.num_rows else pa.array([], pa.binary())
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    bounds = np.frombuffer(x.buffers()[1], dtype=np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64) // 4 if len(x) else np.zeros(1, np.int64)
    return fit(np.frombuffer(x.buffers()[2], dtype=np.int32) if len(x) else np.zeros(0, np.int32), bounds, labels)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """One row ``(doc_id, held_out, score, predicted)`` for each row of ``docs``; ``score`` is the chance that its label is 1.

    Held out are ids whose crc32 as text, modulo 4, is 2: their labels are never learned. Of an id with
    several labels the lowest counts; labels other than 0 and 1 are passed over. Null, empty and very long
    texts are scored as any; repeated rows alike. A null id is not held out. Of ``docs`` only ``id_col``
    and ``text`` are read. Without usable labels every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, id_col))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.value.score(x) for x in features(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), "text")
    rows = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with all their columns whose score reaches ``threshold``; each is judged where it lies, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, id_col))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(x) >= threshold for x in features(batch)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
