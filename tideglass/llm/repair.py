"""Conversation structure repair by iterative-deepening A* (operator 11).

Rows are sorted once over all conversations and written down; what the search needs of a row is one letter. A
conversation's letters lie in blocks of bounded length, however long it is. The search runs over slices of a
block, depth first in ASCII order of the edits, under bounds that grow by the least excess met, with a table of states that have
failed and what was left to spend there. Slices, and blocks of a conversation that has several, are joined by their states at
the seams. The edits are then applied to the texts in one sorted, streaming pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Costs of edits, and what a truncated row costs that isn't deleted.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
ROLES = {"u": "user", "a": "assistant"}
#: States by the initial kept last: nothing yet, system, user, assistant. After each, the initial that may follow (besides s at the start).
STATES, ENDS, FOLLOWS = "0sua", "0a", {"0": "u", "s": "u", "u": "a", "a": "u"}
LEGAL = ("su", "ua", "au")
#: Rows searched at once, and rows of a block as a power of two.
SLICE, BLOCK_BITS = 32, 12
#: Characters of a text that order rows of one turn and role.
HEAD = 256
_NEVER = 1 << 60

# A row's letter: its initial (x: another than s, u, a) if it may stay, as a capital if it is truncated; b or d if it is blank or a duplicate.


def estimates(codes: str, goals: str) -> list[dict[str, int]]:
    """For each place and state, what the rest costs at least.

    A row that must go, or is truncated, costs 2 at least, one with another role 1. Of the others, two neighbours that can't
    follow each other cost 1 more, counted over pairs that share no row; the state before and the goal after pair like rows.
    """
    n = len(codes)

    def bad(a: str, b: str) -> int:
        if "x" in (a, b):
            return 0
        if not b:
            return int(a not in goals)
        return int(not (b == FOLLOWS[a] or a == "0" and b == "s"))

    least, pairs = [0] * (n + 1), [0] * (n + 2)
    after = [n] * (n + 1)  # the next row at or after a place that is neither truncated nor must go
    out: list[dict[str, int]] = [{}] * (n + 1)
    system = False
    for i in range(n, -1, -1):
        if i < n:
            c = codes[i]
            system = system or c in "sS"
            stays = c in "suax"
            least[i] = least[i + 1] + (c == "x" if stays else DELETE)
            after[i] = i if stays else after[i + 1]
            if stays:
                j = after[i + 1]
                pairs[i] = max(pairs[j], bad(c, codes[j : j + 1]) + (pairs[after[j + 1]] if j < n else 0))
        j = after[i]
        out[i] = {}
        for state in STATES:
            reached = any(g in "ua" or g == state or g == "s" and state == "0" and system for g in goals)
            more = max(pairs[j] if j < n else 0, bad(state, codes[j : j + 1]) + (pairs[after[j + 1]] if j < n else 0))
            out[i][state] = least[i] + more if reached else _NEVER
    return out


@lru_cache(maxsize=1 << 16)
def search(codes: str, start: str, goals: str) -> tuple[int, str] | None:
    """Least cost and the ASCII-least edits of that cost that lead over all rows from ``start`` to a state of ``goals``; None if none do."""
    n, rest = len(codes), estimates(codes, goals)
    path: list[str] = []
    failed: dict[tuple[int, str], int] = {}
    excess = _NEVER

    def visit(i: int, state: str, left: int) -> bool:
        nonlocal excess
        need = rest[i][state]
        if need > left:
            excess = min(excess, need - left) if need < _NEVER else excess
            return False
        if failed.get((i, state), -1) >= left:
            return False
        if i == n and state in goals:
            return True
        follows, c = FOLLOWS[state], codes[i : i + 1]
        steps = [("D", DELETE, i + 1, state)] if c else []
        steps.append(("I", INSERT, i, follows))
        if c and c not in "bd":
            own, more = c.lower(), TRUNCATED if c.isupper() else 0
            if own == follows or own == "s" and state == "0":
                steps.append(("K", more, i + 1, own))
            steps.append(("R", REROLE + more, i + 1, follows))
        for letter, cost, j, to in steps:
            if cost <= left:
                path.append(letter)
                if visit(j, to, left - cost):
                    return True
                path.pop()
            else:
                excess = min(excess, cost - left)
        failed[i, state] = left
        return False

    bound = rest[0][start]
    while bound < _NEVER:
        if visit(0, start, bound):
            return bound, "".join(path)
        failed.clear()
        bound, excess = bound + excess, _NEVER
    return None


def joined(paths: dict[str, tuple[int, str]], parts: dict[tuple[str, str], tuple[int, str]]) -> dict[str, tuple[int, str]]:
    """The best way to each state over one part more. Of two ways of one cost to one state neither's edits begin the other's, so their order holds whatever follows."""
    out: dict[str, tuple[int, str]] = {}
    for (state, to), (cost, edits) in parts.items():
        if state in paths:
            way = (paths[state][0] + cost, paths[state][1] + edits)
            out[to] = min(out.get(to, way), way)
    return out


def solve(codes: str, starts: str = STATES, goals: str = STATES) -> dict[tuple[str, str], tuple[int, str]]:
    """The best way over all rows for each two states."""
    out = {}
    slices = [codes[i : i + SLICE] for i in range(0, len(codes), SLICE)] or [""]
    for start in starts:
        paths = {start: (0, "")}
        for k, part in enumerate(slices):
            to = goals if k == len(slices) - 1 else STATES
            found = {(s, g): search(part, s, g) for s in paths for g in to}
            paths = joined(paths, {key: way for key, way in found.items() if way})
        out |= {(start, g): way for g, way in paths.items()}
    return out


def repair(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    if len(codes) <= SLICE:
        return search(codes, "0", ENDS)
    return min(solve(codes, "0", ENDS).values())


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage by the checksum of ``conv_id:turn``: rows lost, emptied, without full stops, repeated, or given to the user. Nulls in texts become a blank."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    rows = turns.select("conv_id", "turn", said["role"].alias("role"), said["text"].alias("text"), (F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")) % 20).alias("fate")).where("fate <> 0")
    rows = rows.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fate", "copy")


def _arrow(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _letters(rows: DataFrame) -> DataFrame:
    """``(conv_id, block, place, code)`` of sorted rows."""
    # 128 bits of a row's conversation, role and text; equal rows after the first are duplicates
    own = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    said = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    light = rows.select(
        "conv_id", "place", F.xxhash64(own, "role", "text").alias("h"), F.xxhash64(F.lit(1), own, "role", "text").alias("k"),
        F.substring("role", 1, 1).alias("initial"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    again = light.where("NOT blank").groupBy("h", "k").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    light = light.join(again, ["h", "k"], "left")
    stays = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("blank"), "b").when(F.col("place") > F.col("first"), "d").when(F.col("truncated"), F.upper(stays)).otherwise(stays)
    return light.select("conv_id", F.expr(f"shiftright(place, {BLOCK_BITS})").alias("block"), "place", code.alias("code"))


_PARTS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("codes", pa.string()), ("state", pa.string()), ("goal", pa.string()), ("cost", pa.int64()), ("edits", pa.string())])
_PARTS_SQL = "conv_id long, block long, codes string, state string, goal string, cost long, edits string"
_EDITS_SQL = "conv_id long, block long, codes string, edits string"
_EDITS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("codes", pa.string()), ("edits", pa.string())])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _arrow([(conv, block, codes, repair(codes)[1]) for conv, block, codes in _rows(batch)], _EDITS)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conv, block, codes in _rows(batch):
            yield _arrow([(conv, block, codes, state, goal, cost, edits) for (state, goal), (cost, edits) in solve(codes).items()], _PARTS)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation come in a row, the parts of one block together. Of what was seen, the edits of four ways and the blocks' letters are held."""
    conv, block, paths, parts, seen = None, None, {"0": (0, ())}, {}, []

    def close() -> None:
        nonlocal paths
        if parts:
            ways: dict[str, tuple[int, tuple]] = {}
            for (state, goal), (cost, edits) in parts.items():
                if state in paths:
                    way = (paths[state][0] + cost, (*paths[state][1], edits))
                    if goal not in ways or way[0] < ways[goal][0] or way[0] == ways[goal][0] and "".join(way[1]) < "".join(ways[goal][1]):
                        ways[goal] = way
            paths = ways

    def done() -> pa.RecordBatch:
        close()
        best = min((paths[g] for g in ENDS if g in paths), key=lambda way: (way[0], "".join(way[1])))
        return _arrow([(conv, b, codes, edits) for (b, codes), edits in zip(seen, best[1], strict=True)], _EDITS)

    for batch in batches:
        for c, b, codes, state, goal, cost, edits in _rows(batch):
            if seen and c != conv:
                yield done()
                paths, parts, seen = {"0": (0, ())}, {}, []
            elif seen and b != block:
                close()
                parts = {}
            if not seen or b != block:
                conv, block = c, b
                seen.append((b, codes))
            parts[state, goal] = (cost, edits)
    if seen:
        yield done()


_TURNS_SQL = "conv_id long, turn long, edit string, cost long, fault string, was string, role string, text string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("fault", pa.string()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's edits come before its rows."""
    conv, state, edits, codes, at = None, "0", iter(()), "", 0
    letter = None

    def inserted(out: list) -> None:
        nonlocal state, letter
        while letter == "I":
            state = FOLLOWS[state]
            out.append((conv, None, "I", INSERT, None, None, ROLES[state], ""))
            letter = next(edits, None)

    first = True
    for batch in batches:
        out: list[tuple] = []
        for c, place, turn, role, text, more, letters in _rows(batch):
            if place < 0:
                inserted(out)
                if first or c != conv:
                    conv, state, first = c, "0", False
                edits, codes, at = iter(more), letters, 0
                letter = next(edits, None)
                continue
            inserted(out)
            code, edit = codes[at], letter
            fault = {"b": "blank", "d": "duplicate"}.get(code) or ("truncated" if code.isupper() else None)
            extra = TRUNCATED if code.isupper() else 0
            if edit == "D":
                out.append((conv, turn, edit, DELETE, fault, role, role, text))
            else:
                state = code.lower() if edit == "K" else FOLLOWS[state]
                out.append((conv, turn, edit, extra + REROLE * (edit == "R"), fault, role, role if edit == "K" else ROLES[state], text))
            at, letter = at + 1, next(edits, None)
        yield _arrow(out, _TURNS)
    out = []
    inserted(out)
    yield _arrow(out, _TURNS)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, edit, cost, fault, was, role, text)`` in repaired order: each row of ``turns (conv_id, turn, role, text)`` and each inserted one.

    ``edit`` is Keep, Rerole, Delete or Insert by its initial; rows with D aren't part of the repaired conversation. ``role`` and ``text`` are those after
    the edit, ``was`` is the role before. ``fault`` is blank, duplicate (role and text seen earlier in the conversation), truncated or null.

    Rows go by turn, nulls first; those of one turn by role, the text's first 256 characters and their place in the input. Null ids are one
    conversation. Null roles and texts count as one space. A role whose first character isn't s, u or a, an empty one too, can't stay; of
    the others the first character decides. An empty table gives an empty result; other columns are ignored. Within a partition the output is sorted.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "repair")
    said = {c: F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")}
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said["role"], said["text"], F.monotonically_increasing_id().alias("row")).withColumn("head", F.left("text", F.lit(HEAD)))
    order = ("conv_id", "turn", "role", "head", "row")
    # by ranges: a conversation of any size spreads over partitions, and places follow the order of all rows
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "row").withColumn("place", F.monotonically_increasing_id())
    rows = scratch.save(rows, "rows")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x.code), "")
    blocks = _letters(rows).groupBy("conv_id", "block").agg(codes.alias("codes")).repartition(tasks, "conv_id")
    blocks = scratch.save(blocks.withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))), "blocks")
    alone = blocks.where("n = 1").drop("n").mapInArrow(_alone, _EDITS_SQL)
    parts = blocks.where("n > 1").drop("n").repartition(tasks, "conv_id", "block").mapInArrow(_parts, _PARTS_SQL)
    several = parts.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_composed, _EDITS_SQL)

    at = F.expr(f"shiftright(place, {BLOCK_BITS})").alias("block")
    nothing = F.lit(None).cast("string")
    texts = rows.select("conv_id", at, "place", "turn", "role", "text", nothing.alias("edits"), nothing.alias("codes"))
    edits = alone.unionByName(several).select("conv_id", "block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), "edits", "codes")
    both = texts.unionByName(edits).repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "block", "place")
    return both.select("conv_id", "place", "turn", "role", "text", "edits", "codes").mapInArrow(_applied, _TURNS_SQL)


_AUDIT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_AUDIT = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _AUDIT_SQL.split(", ")])


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, own = None, None

    def row() -> tuple:
        turns, faults, edits = own["turns"], own["faults"], own["edits"]
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], own["illegal"], own["cost"], "".join(edits), own["sha"].hexdigest())

    for batch in batches:
        out = []
        for c, turn, edit, cost, fault, was, role, text in _rows(batch):
            if own is None or c != conv:
                if own is not None:
                    out.append(row())
                conv, own = c, {"turns": None, "faults": dict.fromkeys(("blank", "duplicate", "truncated"), 0), "edits": [], "illegal": 0, "cost": 0, "sha": hashlib.sha256(), "last": None, "said": False}
            own["edits"].append(edit)
            own["cost"] += cost
            if edit != "I":
                if own["last"] is not None and own["last"][:1] + was[:1] not in LEGAL:
                    own["illegal"] += 1
                own["last"] = was
                if fault:
                    own["faults"][fault] += 1
                if turn is not None:  # in order
                    low, high, n = own["turns"] or (turn, turn, 0)
                    own["turns"] = (low, turn, n + (n == 0 or turn != high))
            if edit != "D":
                own["sha"].update(("\n" * own["said"] + f"{role}:{text}").encode())
                own["said"] = True
        yield _arrow(out, _AUDIT)
    if own is not None:
        yield _arrow([row()], _AUDIT)


def audits(repaired: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation that ``conversations`` names, from what ``repaired_turns`` returns."""
    found = repaired.mapInArrow(_audited, _AUDIT_SQL).withColumnRenamed("conv_id", "own")
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
