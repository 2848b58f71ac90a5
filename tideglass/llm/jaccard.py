"""N-gram Jaccard join (operator 9): size-banded tiles, hashed bitmap signatures, exact intersection.

Sets of word shingles fall into size bands. For each band the hash space is cut into segments, one
more than two similar sets of that band can differ in, so such a pair agrees on a whole segment:
a tile is a band, a segment and its content. Within a tile, set bits of hashed bitmaps bound the
overlap from above; what the bound leaves is settled by intersecting the sorted hash arrays.

Links are wanted for reachability. Each tile first tests its members against its first one only;
tiles whose members are then still apart are compared in full, block against block: bitmaps tell which
members have any partner left, and only these bring their sets, of which a block sends a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .words import SPACED, binaries, grams, hashed_words, mix, text_slices

#: Ratio of a size band's edges; members of a tile, and bytes of their bitmaps, that are compared at once; sets a task remembers so as to send a copy once.
BAND, BLOCK, BLOCK_BYTES, REMEMBERED = 1.5, 512, 8 << 20, 200_000
#: Sets that are sent at once.
SENT = 1000
#: Leaders whose numbers of blocks are broadcast, at most.
BROADCAST = 100_000
#: Bits of a bitmap that are compared at once for all pairs of a block.
WIDTH = 4096
#: Tiles of a block's members that are looked at at once.
TILE_SLICE = 1 << 14
#: Bits of the filter for each text that is read again, and at most; it keeps most others from being shuffled. A full one costs time, never results.
FILTER_SHARE, FILTER_BITS = 16, 1 << 27
#: Stands for a null id where sets are fetched again.
NO_ID = -(1 << 63)


class Bands:
    """The schemes in which a set of a given size takes part: ``(scheme, segments, empty segments that need no tile)``."""

    def __init__(self, threshold: Fraction):
        self.threshold, self.edges, self.found = threshold, [1], {}

    def of(self, n: int) -> list[tuple[int, int, int]]:
        if n not in self.found:
            while self.edges[-1] <= n:
                self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
            out = []
            for i in range(len(self.edges) - 1):
                small = self.edges[i + 1] - 1
                large = math.floor(small / self.threshold)
                if self.edges[i] <= n <= large:
                    differ = math.floor((small + large) * (1 - self.threshold) / (1 + self.threshold))
                    spare = 0
                    while 2 * (differ + 1 + spare) < self.edges[i] and _more_empty(differ + 1 + spare, self.edges[i], spare) > 1e-3:
                        spare += 1
                    out.append((i, differ + 1 + spare, spare))
            self.found[n] = out
        return self.found[n]


def _more_empty(segments: int, n: int, spare: int) -> float:
    """The chance that more than ``spare`` of the segments of a set of ``n`` are empty, by Poisson's law."""
    log_mean = math.log(segments) - n / segments
    return 1 - sum(math.exp(k * log_mean - math.exp(log_mean) - math.lgamma(k + 1)) for k in range(spare + 1))


def shingle_sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` of each text; a shorter text is one shingle, one without words has none."""
    for low, high, data, offsets in text_slices(batch):
        hashes, bounds, _, _ = hashed_words(data, offsets, SPACED)
        for i in range(high - low):
            own = hashes[bounds[i] : bounds[i + 1]]
            yield low + i, np.unique(grams(own, min(words, len(own)))) if len(own) else own


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    return int(mix(np.array([np.sum(mix(s)) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def tiles(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The tiles of a sorted set, as 64-bit keys."""
    out, content = [], np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)))])
    for scheme, segments, spare in bands.of(len(s)):
        edges = np.array([(j << 64) // segments for j in range(1, segments)], dtype=np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        keys = mix((content[at[1:]] - content[at[:-1]]) ^ mix(np.arange(segments, dtype=np.uint64) + np.uint64(scheme << 40)))
        full = at[1:] > at[:-1]
        out.append(keys if segments - np.count_nonzero(full) > spare else keys[full])
    return np.concatenate(out).view(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A hashed bitmap of four to eight bits a member, as 64-bit words: few members hide behind others, so the bound is tight."""
    bits = 1 << max(6, (4 * len(s) - 1).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def most_common(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap of sets of ``n_a`` and ``n_b`` members from bitmaps of one width (in the last axis)."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def ngram_jaccard(docs: DataFrame, threshold: Fraction = Fraction(85, 100), words: int = 4, id_col: str = "doc_id") -> DataFrame:
    """One row ``(doc_id, n_shingles, component_id)`` for each row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``threshold``; ``component_id`` is the smallest id reachable by links, the row's own included.
    No link is lost. A null, empty or blank text has no shingles and stands alone. A text of fewer
    words is one shingle. Repeated rows come back as often; equal texts always share a component.
    A null id takes part, but is no component's smallest unless no other is there. Columns other than
    ``id_col`` and ``text`` are not read.
    """
    named = _components(docs, threshold, words, id_col)
    least = named.where("node is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, threshold: Fraction = Fraction(85, 100), words: int = 4, id_col: str = "doc_id") -> DataFrame:
    """Of the rows of each component of ``ngram_jaccard``, with all their columns, the one of the smallest id.

    Where rows of that id have several texts, the text of the smallest hash stays; rows with one id and one text are one.
    A null id comes after all others. Texts without words are no copies of each other: each id keeps one of a kind.
    """
    named = _components(docs, threshold, words, id_col)
    first = named.where("node is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("e"))
    kept = first.select("e.doc_id", "e.key").union(named.where("node is null").select("doc_id", "key").distinct())
    kept = Scratch(docs.sparkSession, "kept").save(kept.toDF("__id", "__key"), "rows")
    own = F.col(id_col).cast("long")
    out = docs.join(kept, own.eqNullSafe(F.col("__id")) & _key("text").eqNullSafe(F.col("__key")), "left_semi")
    once = named.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    return out if once else out.dropDuplicates([id_col, "text"])


def _key(text: str) -> F.Column:
    """With the id, tells rows apart."""
    return F.xxhash64(F.col(text))


def _components(docs: DataFrame, threshold: Fraction, words: int, id_col: str) -> DataFrame:
    """``(doc_id, key, n_shingles, node, component)`` for each row; ``node`` stands for its set and is null where that is empty."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key("text").alias("key"), "text")
    scratch = Scratch(spark, "jaccard")
    num, den = threshold.numerator, threshold.denominator

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One pass over the texts. Equal sets of a task send their bitmap and tiles once.
        bands, seen = Bands(threshold), set()
        for batch in batches:
            ids, texts, n, keys, maps, found = batch.column("doc_id"), batch.column("key"), [], [], [], []

            def gathered() -> pa.RecordBatch:
                low = done[0]
                done[0] += len(n)
                columns = [ids.slice(low, len(n)), texts.slice(low, len(n)), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(maps, pa.binary()), _lists(found)]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "node", "bits", "tiles"])

            done = [0]
            for _, s in shingle_sets(batch, words):
                node = set_key(s) if len(s) else None
                fresh = node is not None and node not in seen
                if fresh and len(seen) < REMEMBERED:
                    seen.add(node)
                n.append(len(s))
                keys.append(node)
                maps.append(bitmap(s).tobytes() if fresh else None)
                found.append(tiles(s, bands) if fresh else None)
                if len(n) >= SENT:
                    yield gathered()
                    n, keys, maps, found = [], [], [], []
            if n:
                yield gathered()

    rows = scratch.save(docs.mapInArrow(digest, "doc_id long, key long, n_shingles long, node long, bits binary, tiles array<long>"), "rows")
    # Range partitions by tile and member: a tile that many sets share spreads over partitions.
    live = rows.where("tiles is not null").select(F.explode("tiles").alias("tile"), "node")
    live = scratch.save(live.repartitionByRange("tile", "node").sortWithinPartitions("tile", "node").mapInArrow(shared_tiles, "tile long, node long, leader long"), "live")
    tested = live.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    wanted = live.select("node").distinct()
    owners = rows.where("node is not null").groupBy("node").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("doc_id")).join(wanted, "node", "left_semi")
    owners = scratch.save(owners, "owners")
    slim = rows.where("bits is not null").select("node", F.col("n_shingles").alias("n"), "bits").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    slim = scratch.save(slim, "bitmaps")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (np.array(batch.column(c)) for c in ("n_a", "n_b"))
            keep = np.zeros(len(n_a), dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                width = min(len(x), len(y))
                common = most_common(n_a[i], folded(x, width), n_b[i], folded(y, width))
                keep[i] = (den + num) * common >= num * (n_a[i] + n_b[i])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        # Whole sets are fetched for the pairs that are left only.
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        full = _sets(docs, scratch.save(owners.join(nodes, "node", "left_semi"), "asked"), words)
        both = pairs.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        return both.mapInArrow(exact, "a long, b long")

    sized = tested.join(slim.toDF("a", "n_a", "bits_a"), "a").join(slim.toDF("b", "n_b", "bits_b"), "b")
    sized = sized.where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    links = scratch.save(linked(scratch.save(sized.mapInArrow(bounded, "a long, b long"), "near")), "links")
    found = connected_components(links, scratch, "first")

    # Tiles of three or more, or that a partition's bound cut, whose members are still apart: every pair that is, block
    # against block. The tiles of one first member go together, so that a member travels with its bitmap once for all of them.
    placed = live.distinct().join(found, "node", "left").select("tile", "node", "leader", F.coalesce("component", "node").alias("component"))
    apart = placed.groupBy("tile").agg(
        F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("leader").alias("leader"), F.max("leader").alias("last_leader")
    )
    apart = scratch.save(apart.where("(members > 2 or leader <> last_leader) and low <> high").select("tile", "leader"), "apart")
    placed = placed.drop("leader")
    if not apart.isEmpty():
        gathered = placed.join(apart, "tile").groupBy("leader", "node").agg(F.min("component").alias("component"), F.collect_list("tile").alias("tiles"))
        gathered = scratch.save(gathered.join(slim, "node"), "gathered")

        def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for run in _runs(batches, ["leader", "i", "j"]):
                yield _near_members(run, num, den)

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for run in _runs(batches, ["leader", "i", "j"]):
                yield _forest(run, num, den)

        near = scratch.save(_blocks(gathered, "bits").mapInArrow(partnered, "leader long, node long").distinct(), "partnered")
        full = _sets(docs, scratch.save(owners.join(near.select("node").distinct(), "node", "left_semi"), "asked-all"), words)
        whole = scratch.save(gathered.select("leader", "node", "component", "n").join(near, ["leader", "node"]).join(full, "node"), "whole")
        more = scratch.save(_blocks(whole, "hashes").mapInArrow(joined, "a long, b long").distinct(), "more")
        found = connected_components(links.union(more), scratch, "all")
    return rows.join(found, "node", "left").select("doc_id", "key", "n_shingles", "node", F.coalesce("component", "node").alias("component"))


def shared_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``tile, node``, those of tiles with two or more members, and with each the first of its tile.

    The first and the last tile of a partition may go on in another one, so their rows always stay.
    Nothing but the row before the present batch is remembered, however large a tile is.
    """
    tile = leader = last = None
    held = False  # whether the leader's own row waits for a second member
    for batch in batches:
        t, v = np.array(batch.column("tile")), np.array(batch.column("node"))
        if tile is not None:
            t, v = np.concatenate([[tile], t]), np.concatenate([[last], v])
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
        new[0] = tile is None
        t, v = t[new], v[new]
        if not len(t):
            continue
        start = np.ones(len(t), dtype=bool)
        start[1:] = t[1:] != t[:-1]
        goes_on = tile is not None and t[0] == tile
        start[0] = not goes_on
        at = np.maximum.accumulate(np.where(start, np.arange(len(t)), -1))
        lead = np.where(at >= 0, v[np.maximum(at, 0)], leader if goes_on else 0)
        keep = ~start
        keep[:-1] |= start[:-1] & ~start[1:]
        keep[0] |= tile is None
        columns = [t[keep], v[keep], lead[keep]]
        if goes_on and held:
            columns = [np.concatenate([[x], c]) for x, c in zip((tile, leader, leader), columns, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["tile", "node", "leader"])
        tile, leader, last, held = int(t[-1]), int(lead[-1]), int(v[-1]), bool(start[-1] and not keep[-1])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (tile, leader, leader)], ["tile", "node", "leader"])


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    """A list of 64-bit numbers each, or null."""
    offsets = np.cumsum([0, *(0 if v is None else len(v) for v in values)])
    flat = np.concatenate([np.zeros(0, np.int64), *(v for v in values if v is not None)])
    # An offset that is null makes its list null.
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.array([*(v is None for v in values), False])), pa.array(flat))


def _sets(docs: DataFrame, owners: DataFrame, words: int) -> DataFrame:
    """``node`` and ``hashes`` of the owners' texts. A bitmap of their ids, of a bounded size, keeps most other texts from the shuffle."""
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    size = min(FILTER_BITS, 1 << max(10, (FILTER_SHARE * owners.count() - 1).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    bits = owners.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    kept = np.zeros(size // 64, dtype=np.int64)
    found = bits.toArrow()
    kept[np.array(found["word"])] = np.array(found["bits"])
    del found
    kept = docs.sparkSession.sparkContext.broadcast(kept)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.array(batch.column("slot"))
            batch = batch.filter(pa.array((kept.value[slots >> 6] >> (slots & 63)) & 1 == 1))
            sets = [s for _, s in shingle_sets(batch, words)]
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            hashes = binaries(np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum([0, *map(len, sets)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), keys, hashes], ["doc_id", "node", "hashes"])

    rows = docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(whole, "doc_id long, node long, hashes binary")
    # Only the node is a key of the join, so that its shuffle also serves to leave one row a node.
    both = rows.join(owners.withColumnRenamed("doc_id", "owner"), "node").where(F.col("doc_id").between(F.col("owner"), F.col("owner")))
    return both.dropDuplicates(["node"]).select("node", "hashes")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``keys`` in sorted rows, one at a time; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([np.array(batch.column(k)) for k in keys])
        edges = [0, *(np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(own[:, low].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _blocks(members: DataFrame, payload: str) -> DataFrame:
    """Rows of ``members (leader, node, ...)`` dealt out so that any two of a leader meet in a task, in blocks ``i, j`` of bounded numbers and bytes."""
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length(payload)) / BLOCK_BYTES)
    large = members.groupBy("leader").agg(F.ceil(size).cast("int").alias("blocks")).where("blocks > 1")
    # Leaders of more than one block are few, as their members are many: where that is so, no group is sent to one task to learn it.
    few = large.limit(BROADCAST + 1).count() <= BROADCAST
    dealt = members.join(F.broadcast(large) if few else large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    return dealt.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "n", "node")


def _near_members(run: pa.Table, num: int, den: int) -> pa.RecordBatch:
    """Members that some other of the run, of another component and in a common tile, may link with by sizes and bitmaps."""
    n, own, part, node = (np.array(run[c]) for c in ("n", "own", "component", "node"))
    maps = [np.frombuffer(b, np.uint64) for b in run["bits"].to_pylist()]
    cross = run["i"][0] != run["j"][0]
    # Which members meet in a tile: a product of the member-by-tile matrix with itself.
    tiles = run["tiles"].combine_chunks()
    found, column = np.unique(np.array(tiles.flatten()), return_inverse=True)
    member = np.repeat(np.arange(len(n)), np.diff(np.array(tiles.offsets)))
    meet = np.zeros((len(n), len(n)), dtype=bool)
    for low in range(0, len(found), TILE_SLICE):  # so many tiles at once: long texts have hundreds of thousands
        here = (low <= column) & (column < low + TILE_SLICE)
        inside = np.zeros((len(n), min(TILE_SLICE, len(found) - low)), dtype=np.float32)
        inside[member[here], column[here] - low] = 1
        meet |= inside @ inside.T > 0
    x, y = np.nonzero(np.triu(den * n[:, None] >= num * n[None, :], 1) & meet & (part[:, None] != part[None, :]) & (not cross or own[:, None] != own[None, :]))
    if len(x):
        # Coarse maps first, for all pairs at once: folding a map keeps the bound, and shared bits are a product of matrices.
        width = max(1, min(map(len, maps)) // 2)
        coarse = np.stack([folded(m, width) for m in maps])
        set_bits, shared = np.bitwise_count(coarse).sum(1, dtype=np.int64), np.zeros((len(n), len(n)), dtype=np.float32)
        for low in range(0, width, WIDTH // 64):
            bits = np.unpackbits(coarse[:, low : low + WIDTH // 64].copy().view(np.uint8), axis=1).astype(np.float32)
            shared += bits @ bits.T
        common = np.minimum(n[x] - set_bits[x] + shared[x, y], n[y] - set_bits[y] + shared[x, y])
        near = (den + num) * common >= num * (n[x] + n[y])
        x, y = x[near], y[near]
        some = np.zeros(len(n), dtype=bool)
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if not (some[a] and some[b]):
                width = min(len(maps[a]), len(maps[b]))
                if (den + num) * most_common(n[a], folded(maps[a], width), n[b], folded(maps[b], width)) >= num * (n[a] + n[b]):
                    some[a] = some[b] = True
        x, y = np.flatnonzero(some), x[:0]
    near = node[np.unique(np.concatenate([x, y]))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(near), run["leader"][0].as_py()), pa.int64()), pa.array(near, pa.int64())], ["leader", "node"])


def _forest(run: pa.Table, num: int, den: int) -> pa.RecordBatch:
    """Links between members of the run, by exact intersection, as few as join all that any links of it join."""
    n, own, part, node = (np.array(run[c]) for c in ("n", "own", "component", "node"))
    cross = run["i"][0] != run["j"][0]
    sets = [np.frombuffer(h, np.uint64) for h in run["hashes"].to_pylist()]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum([0, *map(len, sets)])
    _, group = np.unique(part, return_inverse=True)
    there, a, b = np.zeros(len(values), dtype=bool), [], []
    for i in range(len(n) - 1):
        if (group == group[0]).all():
            break
        there[place[begin[i] : begin[i + 1]]] = True
        common = np.add.reduceat(there[place[begin[i + 1] :]], begin[i + 1 : -1] - begin[i + 1], dtype=np.int64)
        there[place[begin[i] : begin[i + 1]]] = False
        for k in (i + 1 + np.flatnonzero(den * common >= num * (n[i] + n[i + 1 :] - common))).tolist():
            if group[k] != group[i] and not (cross and own[k] == own[i]):
                a.append(node[i])
                b.append(node[k])
                group[group == group[k]] = group[i]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
