"""Partly seen durations, and decay fits, against loops."""

import math
import random
from datetime import date
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import decay, hazard


def month(k):
    return date(2000 + k // 12, k % 12 + 1, 1)


def made(seed, n=140):
    rng = random.Random(seed)
    out, state = [], "a"
    for k in range(n):
        state = rng.choice("abc") if rng.random() < 0.3 else state
        if rng.random() > 0.06:
            out.append((k, state))
    return out


def plain(rows):
    segments, last = [], None
    for k, s in rows:
        if last is None or k != last + 1:
            segments.append([])
        segments[-1].append((k, s))
        last = k
    spells, steps = [], []
    for n, seg in enumerate(segments, 1):
        runs = [list(g) for _, g in groupby(seg, key=lambda r: r[1])]
        for i, run in enumerate(runs[1:], 1):
            spells.append((n, run[0][1], month(run[0][0]), len(run), i == len(runs) - 1))
            steps.append((n, month(run[0][0]), runs[i - 1][0][1], run[0][1]))
    return spells, steps


def test_spells_against_loops(spark):
    table = {key: made(i) for i, key in enumerate(["x", "y", "z"])}
    rows = [(key, month(k), s) for key, own in table.items() for k, s in own] + [("x", None, "a"), ("one", month(3), "a"), ("one", month(4), "a"), ("two", month(3), "b"), ("two", month(5), "a")]
    df = spark.createDataFrame(rows, "sid string, dt date, label string").withColumn("state", F.lit(0)).repartition(3)
    df = df.unionByName(spark.createDataFrame([("two", month(4), None, 0)], df.schema))
    spells = hazard.segmented_spells(df)
    got = sorted((r.sid, r.segment, r.state, r.start, r.duration, r.censored) for r in hazard.spell_observations(spells).collect())
    assert got == sorted((key, *s) for key, own in table.items() for s in plain(own)[0])
    steps = sorted((r.sid, r.segment, r.start, r["from"], r.to) for r in hazard.segment_transitions(spells).collect())
    assert steps == sorted((key, *s) for key, own in table.items() for s in plain(own)[1])
    seen = [s for own in table.values() for s in plain(own)[0]]
    for r in hazard.duration_hazards(hazard.spell_observations(spells)).collect():
        own = [s for s in seen if s[1] == r.state]
        risk = lambda k: sum(s[3] >= k for s in own)  # noqa: B023, E731
        ended = lambda k: sum(s[3] == k and not s[4] for s in own)  # noqa: B023, E731
        assert (r.at_risk, r.ended) == (risk(r.duration), ended(r.duration))
        assert r.survival == pytest.approx(math.prod(1 - ended(k) / risk(k) for k in {s[3] for s in own} if k <= r.duration))


def test_onsets_against_loops(spark):
    rng = random.Random(4)
    rows = [(key, month(k), rng.choice([0, 1, 1, 1, None]), rng.random() < 0.2) for key in "pq" for k in range(90) if rng.random() > 0.05]
    df = spark.createDataFrame(rows, "sid string, dt date, cell int, on boolean")
    by = {(s, d): (c, o) for s, d, c, o in rows}
    nxt = lambda d: date(d.year + d.month // 12, d.month % 12 + 1, 1)
    risk = [(c, by[s, nxt(d)][1]) for (s, d), (c, o) in by.items() if c is not None and not o and (s, nxt(d)) in by]
    got = {r.cell: r for r in hazard.onset_hazard(df, "cell", F.col("on"), [0, 1, 7], least=30).collect()}
    every = sum(e for _, e in risk) / len(risk)
    for cell in (0, 1, 7):
        own = [e for c, e in risk if c == cell]
        assert (got[cell].months, got[cell].onsets) == (len(own), sum(own))
        assert got[cell].fell_back == (len(own) < 30) and got[cell].rate == pytest.approx(sum(own) / len(own) if len(own) >= 30 else every)
    assert [r.rate for r in hazard.onset_hazard(df.limit(0), "cell", F.col("on"), [0]).collect()] == [0.0]


def rate(lags, values):
    def misfit(r):
        e = np.exp(-r * lags)
        return float(((values - (values * e).sum() / (e * e).sum() * e) ** 2).sum())

    grid = np.linspace(decay.LOW, decay.HIGH, decay.POINTS)
    k = int(np.argmin([misfit(r) for r in grid]))
    lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, decay.POINTS - 1)]
    while hi - lo >= decay.TOLERANCE:
        c, d = hi - decay.GOLDEN * (hi - lo), lo + decay.GOLDEN * (hi - lo)
        lo, hi = (lo, d) if misfit(c) < misfit(d) else (c, hi)
    return (lo + hi) / 2


def test_decay_rates_against_a_loop(spark):
    rng = np.random.default_rng(1)
    lags = np.arange(1.0, 25.0)
    curves = {"slow": 0.4 * np.exp(-0.05 * lags), "fast": 0.9 * np.exp(-1.7 * lags), "grows": 0.1 * np.exp(0.04 * lags), "faster": np.exp(-9 * lags), "noise": rng.standard_normal(24), "bent": 1 / lags}
    rows = [(name, int(k), float(v)) for name, own in curves.items() for k, v in zip(lags, own)]
    rows += [("one", 1, 0.5), ("zero", 1, 0.0), ("zero", 2, 0.0), ("null", 1, None), ("null", 2, 1.0), ("nan", 1, float("nan")), ("nan", 2, 1.0)]
    got = {r.sid: r for r in decay.decay_rates(spark.createDataFrame(rows, "sid string, lag int, acf double").repartition(3), ["sid"]).collect()}
    for name, own in curves.items():
        # about the minimum the misfit is flat to half of the digits
        assert got[name].rate == pytest.approx(rate(lags, own), abs=1e-7 if name != "faster" else 1e-6), name
    assert got["slow"].rate == pytest.approx(0.05, abs=1e-9) and got["fast"].rate == pytest.approx(1.7, abs=1e-8) and got["faster"].rate > 4.97
    assert all(got[name].rate is None for name in ("one", "zero", "null", "nan"))
