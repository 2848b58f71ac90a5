"""Words of whole texts as 64-bit hashes, found on Arrow's own bytes without making Python strings.

Word classes hold every byte of 0x80 and above, so they can be told byte by byte. A hash sums one
pseudo-random 64-bit value for each byte and its place in the word, finished by a bijective mixer. No
value is a multiple of another, so words of a regular build don't meet; of n different words, two get
one hash with a chance of about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Places of a word whose values are tabled; those of later ones are computed.
_PLACES = 64
SLICE_BYTES = 1 << 18


def _members(ranges: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, dtype=bool)
    for low, high in ranges:
        inside[low : high + 1] = False
    return inside


#: The byte ranges that end a word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing) and of `[^\x20\x09-\x0D]+`.
ALPHANUMERIC = _members([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
SPACED = _members([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * _BASE)


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, past last row, bytes, offsets)`` of slices of about ``size`` bytes; a longer text stands alone; null is empty."""
    col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def hashed_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, bounds, starts, ends)``: the words of text i are ``hashes[bounds[i]:bounds[i + 1]]``, over bytes ``starts`` to ``ends``."""
    n = len(data)
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] |= w[edges]
    last[edges - 1] |= w[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), starts, ends
    size = ends - starts
    begin = np.cumsum(size) - size
    kind = np.int32 if n < 1 << 23 else np.int64
    at = np.arange(begin[-1] + size[-1], dtype=kind) - np.repeat(begin.astype(kind), size)
    long = np.flatnonzero(at >= _PLACES) if size.max() > _PLACES else at[:0]
    at <<= 8
    at |= _LOWER[data[w]]
    if len(long):
        late = mix((at[long].astype(np.uint64) + np.uint64(1)) * _BASE)
        at[long] = 0
    values = _VALUES[at]
    if len(long):
        values[long] = late
    return mix(np.add.reduceat(values, begin)), np.searchsorted(starts, offsets), starts, ends


def hash_word(word: bytes) -> int:
    """The hash that ``hashed_words`` gives a single word."""
    return int(hashed_words(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]), np.ones(256, dtype=bool))[0][0])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words; ``len(hashes) - n + 1`` of them, none if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(m, n, dtype=np.uint64)
    for i in range(n):
        out *= _BASE
        out ^= out >> np.uint64(32)
        out += hashes[i : i + m]
    return mix(out)


def binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values that hold ``values[bounds[i]:bounds[i + 1]]`` each."""
    offsets = (np.asarray(bounds, dtype=np.int64) * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
