"""Nearest windows against all pairs, with the number of exact distances; quantiles over ranges against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import memorization as mem
from tideglass.operators.ranges import quantiles


def series(seed, n, key="a", scale=1.0):
    rng = np.random.default_rng(seed)
    return [(key, i, float(v)) for i, v in enumerate(np.cumsum(rng.standard_normal(n)) * scale)]


def brute(queries, candidates, exclude):
    return {s: min((float(np.sqrt(((q - c) ** 2).sum())) for t, c in candidates if abs(s - t) >= exclude), default=None) for s, q in queries}


@pytest.mark.parametrize("exclude", [0, 8])
def test_equals_all_pairs_and_prunes(spark, exclude):
    rows = series(1, 700) + series(2, 90, "b")
    df = spark.createDataFrame(rows, "sid string, dt int, r double")
    sliding, blocks = mem.windows(df, 8), mem.windows(df, 8, 8)
    got = mem.nearest_windows(blocks, sliding if exclude else mem.windows(df, 8).where("start % 3 = 1"), 8, exclude).collect()
    for key in "ab":
        x = np.array([r for k, _, r in rows if k == key])
        win = [(i, x[i : i + 8]) for i in range(len(x) - 7)]
        want = brute([w for w in win if w[0] % 8 == 0], win if exclude else [w for w in win if w[0] % 3 == 1], exclude)
        own = {r.start: r.distance for r in got if r.sid == key}
        assert own.keys() == want.keys() and all(math.isclose(own[s], want[s], rel_tol=1e-12) for s in want)
    pairs = sum(87 * 693 // (1 if exclude else 3) for _ in "a")
    assert sum(r.tried for r in got if r.sid == "a") < pairs / 15


def test_copies_ties_and_constant_series(spark):
    flat = [("c", i, 1.0) for i in range(40)]
    wave = [("w", i, float(i % 4)) for i in range(60)]
    df = spark.createDataFrame([*flat, *wave, ("short", 0, 1.0), ("n", 0, None), ("n", 1, 2.0)], "sid string, dt int, r double")
    got = mem.nearest_windows(mem.windows(df, 4, 4), mem.windows(df, 4), 4, exclude=4).collect()
    assert {r.sid for r in got} == {"c", "w"} and all(r.distance == 0 for r in got) and max(r.tried for r in got) <= 5
    alone = mem.nearest_windows(mem.windows(df, 40, 40), mem.windows(df, 40), 40, exclude=40)
    assert alone.collect() == []
    empty = spark.createDataFrame([], "sid string, dt int, r double")
    assert mem.nearest_windows(mem.windows(empty, 4, 4), mem.windows(empty, 4), 4).collect() == []


def test_epsilon_and_summary(spark):
    train, held = spark.createDataFrame(series(3, 200), "sid string, dt int, r double"), spark.createDataFrame(series(4, 100), "sid string, dt int, r double")
    copied = train.withColumn("path", F.lit(1)).unionByName(held.withColumn("path", F.lit(2)).withColumn("r", F.col("r") + 50))
    one = mem.summary(mem.signals(train, held, copied, 8, 0.05)).first()
    x = np.array([r for _, _, r in series(3, 200)])
    z = (x - x.mean()) / x.std()
    win = [(i, z[i : i + 8]) for i in range(193)]
    epsilon = float(np.percentile(list(brute([w for w in win if w[0] % 8 == 0], win, 8).values()), 5))
    assert mem.leave_one_out_epsilon(mem.standardized(train, train), 8, 0.05).first().epsilon == pytest.approx(epsilon, rel=1e-9)
    assert one.blocks == 25 + 12 and one.p05 == 0 and one.near_duplicates == pytest.approx(25 / 37) and one.membership_auc == 1.0
    assert mem.summary(mem.signals(train, held, copied, 8, 0.05, least_blocks=26)).collect() == []


def test_quantiles(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 500)] + [("b", float(v)) for v in rng.standard_normal(77)] + [(None, 1.5), ("a", None), ("z", None)] + [("c", 2.0)] * 300
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        points = {"low": 0.05, "mid": 0.5, "high": 0.93, "top": 1.0}
        got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", points, ["k"]).collect()}
        assert got.keys() == {"a", "b", "c", None}
        for k, r in got.items():
            own = [v for key, v in rows if key == k and v is not None]
            assert r.n == len(own) and all(math.isclose(r[name], float(np.quantile(own, q)), rel_tol=1e-12, abs_tol=1e-12) for name, q in points.items())
        pooled = quantiles(spark.createDataFrame(rows, "k string, v double"), "v", points).first()
        assert pooled.mid == pytest.approx(float(np.quantile([v for _, v in rows if v is not None], 0.5)))
        assert quantiles(spark.createDataFrame([], "v double"), "v", points).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
