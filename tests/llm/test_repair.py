"""Conversation repair against a search by cost, and the query against its SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.llm import repair, sql

SCHEMA = "conv_id long, turn long, role string, text string, audit int"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Cost, edits and repaired rows of (role, text, must go, truncated): the first end reached in order of cost and edits."""
    follows = {"0": "u", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "0", ())], set()
    while heap:
        cost, edits, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in "0a":
            return cost, edits, list(said)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        f = follows[state]
        name = {"u": "user", "a": "assistant"}[f]
        heapq.heappush(heap, (cost + 5, edits + "I", i, f, (*said, f"{name}:")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, said))
            if not gone:
                own = role[:1]
                if own and (own == f or own == "s" and state == "0"):
                    heapq.heappush(heap, (cost + 5 * cut, edits + "K", i + 1, own, (*said, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + 5 * cut, edits + "R", i + 1, f, (*said, f"{name}:{text}")))


def plain(table):
    """The whole contract in loops."""
    convs = {}
    for conv, turn, role, text, *_ in table:
        rows = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            judged.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for t, *_ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, said = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes. ", "No!", "cut", "", " \n", None, "é😀?", "Yes. ", "a.b", rng.choice(("x" * 300 + ".", "y" * 300 + ","))])
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.choice((0, 1, 2, 4, 9, 40)) if conv else 6):
            role = rng.choice(("user", "assistant")) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            role = rng.choice(("system", "tool", "", None, "s", "ask")) if rng.random() < 0.1 else role
            rows.append((conv, rng.choice((turn, turn, turn, 2 * turn, None)), role, f"{turn}: {text()}." if rng.random() < 0.6 else text(), 3))
    return rows


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = repair.audits(repair.repaired_turns(repair.damaged(df)), df)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_search_against_cheapest_first():
    rng = random.Random(7)
    for _ in range(3000):
        codes = "".join(rng.choice("suaxSUAXbduaua") for _ in range(rng.randrange(10)))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "", c in "bd", c.isupper()) for c in codes]
        assert repair.repair(codes) == cheapest(rows)[:2], codes


def test_search_is_one_of_growing_bounds():
    assert repair.search.__wrapped__("ua", "0", "0a") == (0, "KK")
    start, (cost, _) = repair.estimates("uau", "0a")[0]["0"], repair.search.__wrapped__("uau", "0", "0a")
    assert start < cost
    assert repair.search.__wrapped__("ab", "0", "s") is None and repair.search.__wrapped__("", "u", "0") is None


@pytest.mark.parametrize("size", [1, 2, 5])
def test_slices_and_blocks_change_nothing(monkeypatch, size):
    rng = random.Random(size)
    monkeypatch.setattr(repair, "SLICE", size)
    for _ in range(300):
        codes = "".join(rng.choice("suaxSUAbduauaua") for _ in range(rng.randrange(14)))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "", c in "bd", c.isupper()) for c in codes]
        want = cheapest(rows)[:2]
        assert repair.repair(codes) == want
        batches = []
        for block, at in enumerate(range(0, len(codes), 3)):
            batches += repair._parts([pa_rows([(1, block, codes[at : at + 3])])])
        if batches:
            done = [r for b in repair._composed(iter(batches)) for r in b.to_pylist()]
            assert "".join(r["edits"] for r in done) == want[1] and "".join(r["codes"] for r in done) == codes


def pa_rows(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["conv_id", "block", "codes"])


def test_query_against_loops_and_sql(spark):
    rows = made(1, 120)
    rows += rows[:5]
    got = run(spark, rows)
    assert got == plain(rows)
    con = duckdb.connect()
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "audit"]).astype({"conv_id": "Int64", "turn": "Int64"})
    table["role"], table["text"] = (table[c].astype(object).where(table[c].notna(), None) for c in ("role", "text"))
    con.register("conversations", table)
    want = con.sql(sql.repairs())
    assert want.columns == COLUMNS and sorted(want.fetchall(), key=repr) == got


def test_long_conversation_over_blocks_and_partitions(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    rows = [(7, t, ("user", "assistant")[t % 2] if rng.random() < 0.9 else "tool", rng.choice(("Yes.", f"It is {t}.", f"{t}")), 0) for t in range(1500)] + made(3, 40)
    assert run(spark, rows, 7) == plain(rows)


def test_empty_and_all_dropped(spark):
    assert run(spark, []) == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.", 0)]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well."), (1, 2, "user", "Hm."), (2, 0, "assistant", "No."), (2, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.edit, r.cost, r.fault, r.was, r.role, r.text) for r in repair.repaired_turns(turns.withColumn("edit", F.lit(1))).where("conv_id = 2").collect())
    assert got == [(2, 0, "D", 2, None, "assistant", "assistant", "No."), (2, 1, "D", 2, "blank", "assistant", "assistant", "")]
    one = repair.repaired_turns(turns).where("conv_id = 1").collect()
    assert sum(r.cost for r in one) == 3 and "".join(r.edit for r in one) == "DKR"
