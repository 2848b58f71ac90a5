"""Token counts and token ids of whole texts (operator 1, and the ids that operator 10 packs).

A text falls into pre-tokens, and a pre-token's ids depend on nothing around it. Each slice of texts is cut
on its own bytes, and only its distinct pre-tokens are looked up, in two tiers: a compact table of
frequent ones, broadcast once, then a cache in each Python worker which the tokenizer itself fills for what
the table lacks. No pre-token is ever shuffled. Both tiers compare whole strings and only save work:
counts are those of the library whatever they hold.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_slices

#: Rows of which the frequent pre-tokens are counted, and how many of them the table keeps: about 16 bytes each.
SAMPLE_ROWS, TABLE_SIZE = 2000, 32_768
#: Entries of a worker's cache, which keeps but the last slice's when it is full; longer keys are never kept; bytes of texts looked up at once.
CACHE_SIZE, CACHED_CHARS, SLICE = 400_000, 64, 1 << 22
#: Fixed value: the pre-tokenizer of the byte-level vocabularies whose pre-tokens ``cuts`` can tell.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_WORKER: dict[str, "PreTokens"] = {}

# Classes of bytes: white space, letters, digits, other ASCII signs; 0 for what only Unicode tables can tell.
_SPACE, _LETTER, _DIGIT, _SIGN = 1, 2, 3, 4
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[:128] = _SIGN
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
#: Bytes that may begin a character of white space outside ASCII.
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_EXOTIC = re.compile(r"[^\S \n]")
#: Pieces that surely are one pre-token each.
_SINGLE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch
#: Byte-level vocabularies write a byte that isn't printable as the next character from 256 on.
_WRITTEN = np.arange(256, dtype=np.uint32)
_WRITTEN[[*range(33), *range(127, 161), 173]] = np.arange(256, 256 + 33 + 34 + 1)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks bytes at which a pre-token surely begins, whatever stands around: the first of each text is one.

    A run of white space begins one, but for its last blank, which goes with what follows; so do, within ASCII
    and the accented letters of Latin-1, a change between letters, digits and signs, save after an apostrophe, and what follows
    a lone line feed. Next to other characters nothing is marked, and a piece between two marks
    may hold several pre-tokens.
    """
    n = len(data)
    kind = _CLASS[data]
    accents = np.flatnonzero(data[:-1] == 0xC3)
    accents = accents[(data[accents + 1] != 0x97) & (data[accents + 1] != 0xB7)]
    kind[accents] = kind[accents + 1] = _LETTER
    mark = np.zeros(n + 1, dtype=bool)
    before, here = kind[:-1], kind[1:]
    # A space after an unknown character may go on a run of white space outside ASCII: those pieces stay whole.
    mark[1:n] = (before != here) & (before != 0) & (here != 0) & (before != _SPACE) & ~((data[:-1] == 39) & (here == _LETTER))
    unknown = np.flatnonzero((before == 0) & (here == _SPACE)) + 1
    if len(unknown):
        a, b, c = data[unknown - 1], data[np.maximum(unknown - 2, 0)], data[np.maximum(unknown - 3, 0)]
        exotic = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) | (c == 0xE2) & ((b == 0x80) | (b == 0x81)) | (c == 0xE3) & (b == 0x80)
        mark[unknown[~exotic]] = True
    mark[offsets] = True
    feeds = np.flatnonzero(mark[:n] & (data == 10)) + 1
    feeds = feeds[feeds < n]
    mark[feeds[(kind[feeds] != _SPACE) & ~_LEADS[data[feeds]]]] = True
    return mark[:n]


class PreTokens:
    """The tokenizer of one file with a worker's cache; ids equal those of the library, without added special tokens.

    Vocabularies with another pre-tokenizer or a normalizer are never cut: each text goes to the library whole.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.encode, self.model, self.added, self.cut = sentencepiece.SentencePieceProcessor(model_file=path).encode, None, [], False
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            self.encode, self.model = lambda text: own.encode(text, add_special_tokens=False).ids, own.model.tokenize
            self.added = [t.content for t in own.get_added_tokens_decoder().values()]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            first = spec.get("pre_tokenizer") or {}
            self.cut = not spec.get("normalizer") and {k: first.get(k, True) for k in BYTE_LEVEL} == BYTE_LEVEL and spec["model"].get("dropout") is None
            self.cut = self.cut and all(t.lstrip == t.rstrip == t.single_word == False for t in own.get_added_tokens_decoder().values())  # noqa: E712
        self.feed = self.encode("\n") if self.cut else []
        self.cut = self.cut and len(self.feed) == 1
        self.ends, self.last = np.zeros(1, np.int64), ([], np.zeros(0, np.int64))
        self._restart()

    def _restart(self) -> None:
        """Empties the cache but for what the last slice used; slot 0 is of the closing id."""
        tokens, slots = self.last
        kept = [(t, x) for t, x in zip(tokens, slots.tolist(), strict=True) if len(t) <= CACHED_CHARS][: CACHE_SIZE // 2]
        slots = np.array([0, *(x for _, x in kept)], dtype=np.int64)
        self.flat, past = self._gathered(slots) if len(self.ends) > 1 else (np.zeros(1, np.uint32), np.arange(2))
        self.ends, self.slots = past.astype(np.int64), {t: i for i, (t, _) in enumerate(kept, 1)}
        self.last = [], np.zeros(0, np.int64)

    def _gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)`` of slots in a row. A slot's ids lie in a row in the cache: one gather brings them into order."""
        starts, ends = self.ends[slots], self.ends[slots + 1]
        past = np.concatenate([[0], np.cumsum(ends - starts)])
        kind = np.int32 if past[-1] < 1 << 31 else np.int64
        at = np.repeat((starts - past[:-1]).astype(kind), ends - starts)
        at += np.arange(past[-1], dtype=kind)
        return self.flat[at], past

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """``(pieces, bounds)``: pieces of text i are ``pieces[bounds[i]:bounds[i + 1]]``."""
        n = len(data)
        if not n:
            return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
        if self.cut:
            mark = cuts(data, offsets)
            raw = data.tobytes()
            for token in map(str.encode, self.added):
                at = raw.find(token)
                while at >= 0:  # such a text stays whole
                    text = int(np.searchsorted(offsets, at, side="right")) - 1
                    mark[offsets[text] + 1 : offsets[text + 1]] = False
                    at = raw.find(token, int(offsets[text + 1]))
        else:
            mark = np.zeros(n, dtype=bool)
            mark[offsets[offsets < n]] = True
        starts = np.flatnonzero(mark)
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, n)), pa.py_buffer(data))
        return cut, np.searchsorted(starts, offsets)

    def _fill(self, tokens: list[str]) -> None:
        """Puts into the cache what it lacks of ``tokens``.

        Single pre-tokens go to the tokenizer's model, which takes bytes as characters; other plain pieces are
        encoded in one text, between line feeds, which are pre-tokens of their own there; the rest one by one.
        """
        single, plain, rest = [], [], []
        for t in tokens:
            if len(t) > CACHED_CHARS or not self.cut:
                rest.append(t)
            elif _SINGLE(t):
                single.append(t)
            elif "\n" in t or " " in t[1:] or t == " " or _EXOTIC.search(t) or any(x in t for x in self.added):
                rest.append(t)
            else:
                plain.append(t)
        found, lengths = [], []
        if single:
            written = _WRITTEN[np.frombuffer("\n".join(single).encode(), np.uint8)].tobytes().decode("utf-32-le")
            each = [[x.id for x in self.model(w)] for w in written.split(chr(_WRITTEN[10]))]
            lengths.append([*map(len, each)])
            found.append(np.fromiter(chain.from_iterable(each), dtype=np.uint32))
        if plain:
            ids = np.array(self.encode("\n".join(plain)), dtype=np.uint32)
            between = np.flatnonzero(ids == self.feed[0])
            found.append(np.delete(ids, between))
            lengths.append(np.diff(np.concatenate([[-1], between, [len(ids)]])) - 1)
        for t in rest:
            found.append(np.array(self.encode(t), dtype=np.uint32))
            lengths.append([len(found[-1])])
        first = len(self.ends) - 1
        self.slots.update(zip(chain(single, plain, rest), range(first, first + len(tokens)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))])
        self.flat = np.concatenate([self.flat, *found])

    def look_up(self, tokens: list[str]) -> np.ndarray:
        """Slots of the cache for distinct ``tokens``; lengths and ids of a slot stay valid until the next call."""
        if len(self.ends) > CACHE_SIZE or len(self.flat) > 8 * CACHE_SIZE:
            self._restart()
        lacking = [t for t in tokens if t not in self.slots]
        if lacking:
            self._fill(lacking)
        slots = np.fromiter(map(self.slots.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        for t in lacking:
            if len(t) > CACHED_CHARS:
                del self.slots[t]
        self.last = tokens, slots
        return slots

    def lengths(self, tokens: pa.Array, table: tuple[pa.Array, np.ndarray] | None = None) -> np.ndarray:
        """Ids of each of distinct ``tokens``: by the table first, then by the cache."""
        out = np.zeros(len(tokens), dtype=np.int64)
        lacking = np.arange(len(tokens))
        if table is not None and len(table[0]):
            at = np.asarray(pc.fill_null(pc.index_in(tokens, table[0]), -1))
            out[at >= 0] = table[1][at[at >= 0]]
            lacking = np.flatnonzero(at < 0)
        slots = self.look_up(_strings(tokens.take(pa.array(lacking))))
        out[lacking] = self.ends[slots + 1] - self.ends[slots]
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray, table: tuple[pa.Array, np.ndarray] | None = None) -> np.ndarray:
        """Tokens of each text."""
        pieces, bounds = self.pieces(data, offsets)
        coded = pieces.dictionary_encode()
        each = self.lengths(coded.dictionary, table)[np.asarray(coded.indices)]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[bounds])

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: each text's ids and ``end_id`` after them are ``ids[bounds[i]:bounds[i + 1]]``."""
        pieces, bounds = self.pieces(data, offsets)
        coded = pieces.dictionary_encode()
        slots = np.insert(self.look_up(_strings(coded.dictionary))[np.asarray(coded.indices)], bounds[1:], 0)
        self.flat[0] = end_id
        ids, past = self._gathered(slots)
        return ids, past[bounds + np.arange(len(bounds))]


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def worker(path: str) -> PreTokens:
    if path not in _WORKER:
        _WORKER[path] = PreTokens(path)
    return _WORKER[path]


def frequent_pre_tokens(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, size: int = TABLE_SIZE) -> tuple[pa.Array, np.ndarray]:
    """The table: at most ``size`` frequent pre-tokens, and their lengths in tokens.

    Counted over a random sample of about ``rows`` texts, drawn where they lie. Each task counts its own
    and sends at most ``size`` pre-tokens, so what reaches the driver is bounded by the sample, not by
    the corpus. The sample decides how much work the table saves, never a count.
    """
    docs = docs.select("text")
    sample = docs.sample(min(1.0, rows / max(1, docs.count())), seed=1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = worker(path), Counter()
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, size=SLICE):
                found = own.pieces(data, offsets)[0].value_counts()
                for token, n in zip(_strings(found.field("values")), found.field("counts").to_pylist(), strict=True):
                    if len(token) <= CACHED_CHARS:
                        seen[token] += n
        top = seen.most_common(size)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])

    total: Counter[str] = Counter()
    for row in sample.mapInArrow(counted, "token string, n long").collect():
        total[row["token"]] += row["n"]
    kept = pa.array([t for t, n in total.most_common(size) if n > 1], pa.large_string())
    return kept, PreTokens(path).lengths(kept).astype(np.int32)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """One row ``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``; whole texts, repeated rows kept.

    A null text counts as empty: no bytes, no tokens. A null id stays null. Columns other than
    ``id_col`` and ``text`` are not read. An empty table gives an empty result. Files ending in .model are read
    by sentencepiece, others by tokenizers.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_pre_tokens(docs, path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker(path)
        for batch in batches:
            size, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in text_slices(batch, size=SLICE):
                size.append(np.diff(offsets))
                counts.append(own.count(data, offsets, table.value))
            columns = [batch.column("doc_id"), pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(counts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32)`` of at most ``size`` tokens; each document ends in ``end_id``.

    Only documents of more than ``size`` tokens are cut, into pieces of ``size`` of which the first
    may be shorter. A null or empty text is one piece that holds ``end_id`` alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker(path)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for first, _, data, offsets in text_slices(batch, size=SLICE):
                ids, bounds = own.ids(data, offsets, end_id)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                text, starts, ends, number = piece_bounds(np.diff(bounds), size)
                sums = [zlib.crc32(raw[4 * low : 4 * high]) for low, high in zip((bounds[text] + starts).tolist(), (bounds[text] + ends).tolist(), strict=True)]
                columns = [batch.column("doc_id").take(pa.array(first + text)), *(pa.array(c, k) for c, k in zip((number, starts, ends - starts, sums), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def piece_bounds(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end, number)`` of the pieces of documents of ``n`` tokens each: the first may be shorter, the others have ``size``."""
    pieces = -(-n // size)
    text = np.repeat(np.arange(len(n)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    ends = n[text] - (pieces[text] - 1 - number) * size
    return text, np.maximum(ends - size, 0), ends, number
