"""Benchmark decontamination by winnowing (operator 7).

Of every window of consecutive k-gram hashes the minimum is kept, in training and in test texts, so
any shared span of ``window`` words shares a kept hash. Hits are joined to the items' fingerprints
and extended word by word to the whole shared span.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from .words import ALPHANUMERIC, grams, hashed_words, text_slices

#: Words of a fingerprint; words of items broadcast at once (8 bytes each, and about as much for fingerprints): more items take more passes.
GRAM, BLOCK_WORDS = 6, 2_000_000
#: Items of one fingerprint from which they are first told apart all at once.
FEW = 4


def winnowed(g: np.ndarray, w: int) -> np.ndarray:
    """Which hashes are the minimum of some run of ``w`` consecutive ones; all of them if there are fewer than ``w``."""
    if len(g) < w:
        return np.ones(len(g), dtype=bool)
    low = np.lib.stride_tricks.sliding_window_view(g, w)
    least = low[:, 0].copy()
    for i in range(1, w):
        np.minimum(least, low[:, i], out=least)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    best = padded[: len(g)].copy()
    for i in range(1, w):
        np.maximum(best, padded[i : i + len(g)], out=best)
    return best == g


class Items:
    """Fingerprints of a block of benchmark items, as sorted arrays that are broadcast."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)
        data = [(t or "").encode() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in data])]).astype(np.int64)
        self.words, self.bounds, _, _ = hashed_words(np.frombuffer(b"".join(data), np.uint8), bounds, ALPHANUMERIC)
        self.ids = ids
        prints, item, place = [], [], []
        short: dict[int, tuple[list[np.ndarray], list[int]]] = {}
        for i in range(len(ids)):
            own = self.words[self.bounds[i] : self.bounds[i + 1]]
            if len(own) >= window:
                g = grams(own, self.gram)
                at = np.flatnonzero(winnowed(g, window - self.gram + 1))
                prints.append(g[at])
                item.append(np.full(len(at), i))
                place.append(at)
            elif len(own):
                hashes, which = short.setdefault(len(own), ([], []))
                hashes.append(grams(own, len(own)))
                which.append(i)
        none = np.zeros(0, np.int64)
        self.prints, self.item, self.place = np.concatenate([none.astype(np.uint64), *prints]), np.concatenate([none, *item]), np.concatenate([none, *place])
        order = np.argsort(self.prints, kind="stable")
        self.prints, self.item, self.place = self.prints[order], self.item[order], self.place[order]
        self.short = {}
        for n, (hashes, which) in short.items():
            joined, which = np.concatenate(hashes), np.array(which)
            order = np.argsort(joined, kind="stable")
            self.short[n] = joined[order], which[order]

    def mark(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of the texts lie in an occurrence of an item's window, and the ids of such items by text."""
        hit, found = np.zeros(len(words), dtype=bool), {}
        for n, (hashes, which) in self.short.items():
            for p, a, b in _lookup(grams(words, n), None, hashes):
                text = int(np.searchsorted(bounds, p, side="right")) - 1
                if p + n <= bounds[text + 1]:
                    hit[p : p + n] = True
                    found.setdefault(text, set()).update(self.ids[i] for i in which[a:b])
        if not len(self.prints):
            return hit, found
        g = grams(words, self.gram)
        past: dict[tuple[int, int, int], int] = {}
        for p, a, b in _lookup(g, winnowed(g, self.window - self.gram + 1), self.prints):
            text = int(np.searchsorted(bounds, p, side="right")) - 1
            low, high = bounds[text], bounds[text + 1]
            if p + self.gram > high:
                continue
            items, places = self.item[a:b], self.place[a:b]
            if b - a > FEW:
                long = self._long(words, p, low, high, items, places)
                items, places = items[long], places[long]
            for i, q in zip(items.tolist(), places.tolist(), strict=True):
                if past.get((text, i, p - q), -1) >= p:
                    continue
                first, last = self.bounds[i], self.bounds[i + 1]
                back, on = min(p - low, q), min(high - p, last - first - q)
                differ = np.flatnonzero(words[p - back : p] != self.words[first + q - back : first + q])
                left = p - back + (differ[-1] + 1 if len(differ) else 0)
                differ = np.flatnonzero(words[p : p + on] != self.words[first + q : first + q + on])
                right = p + (differ[0] if len(differ) else on)
                past[text, i, p - q] = right
                if right - left >= self.window:
                    hit[left:right] = True
                    found.setdefault(text, set()).add(self.ids[i])
        return hit, found


    def _long(self, words: np.ndarray, p: int, low: int, high: int, items: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which of many items that share a fingerprint with the text's place ``p`` agree with it over a whole window, all at once."""
        left = self.window - self.gram
        off = np.arange(-left, self.window)
        doc, first, last = p + off, self.bounds[items], self.bounds[items + 1]
        at = (first + places)[:, None] + off
        there = (doc >= low) & (doc < high) & (at >= first[:, None]) & (at < last[:, None])
        same = there & (words[np.clip(doc, 0, len(words) - 1)] == self.words[np.clip(at, 0, len(self.words) - 1)])
        return np.cumprod(same[:, :left][:, ::-1], axis=1).sum(1) + np.cumprod(same[:, left:], axis=1).sum(1) >= self.window


def _lookup(g: np.ndarray, chosen: np.ndarray | None, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(position, from, to)``: where a chosen hash stands in ``prints``."""
    at = np.arange(len(g)) if chosen is None else np.flatnonzero(chosen)
    first = np.searchsorted(prints, g[at])
    there = prints[np.minimum(first, len(prints) - 1)] == g[at]
    at, first = at[there], first[there]
    yield from zip(at.tolist(), first.tolist(), np.searchsorted(prints, g[at], side="right").tolist(), strict=True)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` for each row of ``docs``.

    A word is hit inside any occurrence of ``window`` consecutive words of an item, or of all words of an
    item that has fewer. ``contaminated``: some word is hit and ``share`` times the hit words are no fewer
    than all. Null and empty texts have no words; items without words or with a null id match nothing.
    Repeated rows are judged each; an item that occurs twice under one id counts once. Columns other than
    the ids and ``text`` are not read. Items are matched in blocks of ``BLOCK_WORDS``, so what is broadcast
    is bounded; every block adds one pass within the same tasks and no shuffle.
    """

    def judged(batch: pa.RecordBatch, hits: list[np.ndarray], names: list[set[str]]) -> pa.RecordBatch:
        columns = ([len(h) for h in hits], [int(np.count_nonzero(h)) for h in hits], [len(x) for x in names])
        digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
        verdicts = [is_contaminated(h, share) for h in hits]
        arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string()), pa.array(verdicts, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return _marked(rows, items, window, item_col, judged, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` with all their columns that aren't contaminated; each is judged where it lies, without a shuffle."""

    columns = docs.columns

    def kept(batch: pa.RecordBatch, hits: list[np.ndarray], names: list[set[str]]) -> pa.RecordBatch:
        return batch.select(columns).filter(pa.array([not is_contaminated(h, share) for h in hits], pa.bool_()))

    return _marked(docs, items, window, item_col, kept, docs.schema)


def is_contaminated(hit: np.ndarray, share: int) -> bool:
    n = int(np.count_nonzero(hit))
    return n > 0 and share * n >= len(hit)


#: Columns that carry hits from one block of items to the next.
_HITS, _NAMES = "hits of earlier blocks of items", "earlier items that were hit"


def _marked(rows: DataFrame, items: DataFrame, window: int, item_col: str, finish: Callable, schema) -> DataFrame:
    items = items.select(F.col(item_col).cast("string").alias("item_id"), "text").where("item_id is not null")
    # A word has at least one character and, but for the last, a separator.
    words = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, math.ceil(words / BLOCK_WORDS))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        held = rows.sparkSession.sparkContext.broadcast(Items(own["item_id"].to_pylist(), own["text"].to_pylist(), window))
        last = block == blocks - 1
        passed = rows.schema if block else StructType([*rows.schema.fields, StructField(_HITS, BinaryType()), StructField(_NAMES, ArrayType(StringType()))])
        rows = rows.mapInArrow(_marker(held, block == 0, finish if last else None), schema if last else passed)
    return rows


def _marker(held, first: bool, finish: Callable | None):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, names = [], []
            for low, high, data, offsets in text_slices(batch):
                words, bounds, _, _ = hashed_words(data, offsets, ALPHANUMERIC)
                hit, found = held.value.mark(words, bounds)
                hits += [hit[bounds[i] : bounds[i + 1]] for i in range(high - low)]
                names += [found.get(i, set()) for i in range(high - low)]
            if not first:
                hits = [h | np.frombuffer(b, dtype=bool) for h, b in zip(hits, batch.column(_HITS).to_pylist(), strict=True)]
                names = [x.union(b) for x, b in zip(names, batch.column(_NAMES).to_pylist(), strict=True)]
            if finish:
                yield finish(batch, hits, names)
                continue
            own = {_HITS: pa.array([h.tobytes() for h in hits], pa.binary()), _NAMES: pa.array([sorted(x) for x in names], pa.list_(pa.string()))}
            columns = {c: batch.column(c) for c in batch.schema.names} | own
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return mark
