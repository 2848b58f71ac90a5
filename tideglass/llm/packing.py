"""Best-fit packing with certified bounds (operator 10).

Pieces are dealt over groups of bounded size, and each group is packed by best-fit decreasing. A
lower bound from dual-feasible functions certifies a group whose bins are as few as can be; the
others, and the emptiest bin of each, give up their worst-filled bins. What was given up is mixed,
dealt out anew and packed again, as long as that saves bins.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import token_pieces

#: Pieces of a group, which one task packs; rounds at most; of a group's slack, the share whose bins are given up.
GROUP, ROUNDS, GIVEN = 50_000, 8, 0.9
_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, released boolean"


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The largest of several dual-feasible bounds on the bins of ``size`` that ``lengths`` need; all bins when it is met."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    n_above, sum_upto = np.cumsum(count[::-1])[::-1], np.cumsum(count * x)
    cut = np.arange(size // 2 + 1)  # below cut: 0; above size - cut: a whole bin; else as it is
    large = np.where(size - cut + 1 <= size, n_above[np.minimum(size - cut + 1, size)], 0)
    between = sum_upto[size - cut] - np.where(cut > 0, sum_upto[np.maximum(cut - 1, 0)], 0)
    best = int((large + -(-between // size)).max())
    for k in range(1, 65):  # (k + 1) x / size rounded down, over k, where it isn't whole
        whole = (x * (k + 1)) % size == 0
        best = max(best, math.ceil((np.where(whole, x * k, (x * (k + 1)) // size * size) * count).sum() / (k * size) - 1e-9))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: ``(bin, offset)`` of each length, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms, n = 0, 0  # bit r: some bin has exactly r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        want = int(lengths[i])
        fits = open_rooms >> want
        if fits:
            left = want + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, at, n = size, n, n + 1
        bins[i], offsets[i] = at, size - left
        left -= want
        if left:
            if not room[left]:
                open_rooms |= 1 << left
            room[left].append(at)
    return bins, offsets, n


def _packed(pieces: DataFrame, size: int, round_no: int, groups: int) -> DataFrame:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "row"], kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets, n = best_fit(lengths, size)
        slack = size - np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        worst = np.argsort(-slack, kind="stable")
        given = 1
        if n > lower_bound(lengths, size):
            given = int(np.searchsorted(np.cumsum(slack[worst]), GIVEN * slack.sum())) + 1
        released = np.zeros(n, dtype=bool)
        released[worst[:given]] = slack[worst[:given]] > 0
        ids = (round_no << 56) + (int(group["slot"].iloc[0]) << 24) + bins
        return group.drop(columns="slot").assign(sequence_id=ids, offset=offsets, released=released[bins])

    slot = slot_of(round_no, groups).alias("slot")
    return pieces.select("row", "doc_id", "piece", "start", "length", "ids_crc32", slot).groupBy("slot").applyInPandas(pack, _SCHEMA)


def slot_of(round_no: int, groups: int) -> Column:
    """A piece's group in a round, by the number its row got when the pieces were written: copies of a row spread like any other rows."""
    return F.pmod(F.xxhash64(F.lit(round_no), "row"), F.lit(groups))


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id") -> DataFrame:
    """One row ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece of a document.

    Sequences hold at most ``size`` tokens, pieces lie gapless from offset 0. Null and empty texts are
    one token, the closing id. Repeated rows are packed as often as they occur; a null id stays null.
    Columns other than ``id_col`` and ``text`` are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, path, size, end_id, id_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = pieces.count()
    now = scratch.save(_packed(pieces, size, 0, max(1, math.ceil(n / GROUP))), "round-0")
    kept = [now.where("not released")]
    for round_no in range(1, ROUNDS):
        loose = now.where("released")
        n, before = loose.agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))).first()
        if not n:
            break
        again = scratch.save(_packed(loose, size, round_no, max(1, math.ceil(n / GROUP))), f"round-{round_no}")
        if again.where("offset = 0").count() >= before:
            kept.append(loose)
            break
        now = again
        kept.append(again.where("not released"))
    else:
        kept.append(now.where("released"))
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return out.drop("released", "row")
