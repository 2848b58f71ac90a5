"""Every query against its SQL at the smallest size, and what SQL can't express against plain loops."""

import itertools
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass import plans
from tideglass.operators import joins, resample, statistics, transforms
from tideglass.operators import windows as w

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    if x is None or x is pd.NA:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.sql(plans.ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    want = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in names) for r in rel.fetchall()), key=repr)
    assert got == want


def test_smoothing_weights_against_a_loop(spark):
    rng = np.random.default_rng(3)
    truth = rng.standard_normal(80)
    x = np.array([0.6 * truth[i] + 0.4 * truth[i - 1] if i else truth[0] for i in range(80)])

    def objective(theta):
        out = np.zeros(len(x))
        for i in range(len(x)):
            out[i] = (x[i] - sum(theta[j] * out[i - j] for j in range(1, len(theta)) if i >= j)) / theta[0]
        d = out - out.mean()
        return sum(((d[k:] * d[:-k]).sum() / (d * d).sum()) ** 2 for k in range(1, len(theta)))

    grid = [(1 - 0.05 * a, 0.05 * a) for a in range(11)]
    want = min(grid, key=objective)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "sid string, dt int, r double")
    fit = transforms.fit_smoothing(df, kmax=1, default_k=1).first()
    assert fit.k == 1 and np.allclose(fit.theta, want)
    back = transforms.recover_truth(df, [0.6, 0.4]).orderBy("dt").toPandas()
    assert np.allclose(back.truth[0], x[0] / 0.6)
    again = transforms.smooth(spark.createDataFrame(back.rename(columns={"truth": "r"})), [0.6, 0.4])
    assert np.allclose(again.orderBy("dt").toPandas().reported[1:], x[1:])


def test_benchmarked_years_meet_their_anchors(spark):
    rows = [(p, m, math.sin(m * p), 0.5 * p) for p in (1, 2) for m in range(30)]
    got = transforms.denton(spark.createDataFrame(rows, "path int, m int, r double, anchor double"), "path", "m", "r", "anchor").toPandas()
    for p, g in got.groupby("path"):
        x = g.sort_values("m").benchmarked.to_numpy()
        assert np.allclose([x[:12].sum(), x[12:24].sum()], 0.5 * p)


def test_draws_are_blocks(spark):
    d = resample.block_draws(spark, 200, spark.createDataFrame([("a", 60)], "sid string, n long"), 1 / 6, 1).orderBy("path", "m").toPandas()
    row = d.row.to_numpy().reshape(200, 60)
    on = (row[:, 1:] == (row[:, :-1] + 1) % 60).mean()
    assert row.min() == 0 and row.max() == 59 and abs(on - (5 / 6 + 1 / 6 / 60)) < 0.02


def test_as_of_takes_the_last_fact_by_then(spark):
    facts = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 5, "c")], "k int, t int, x string")
    asks = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 9), (2, 4), (3, 4)], "k int, at int")
    got = joins.as_of(asks, facts, ["k"], "at", "t", ["x"]).collect()
    assert sorted(((r.k, r["at"], r.x) for r in got), key=repr) == sorted([(1, 0, None), (1, 1, "a"), (1, 2, "a"), (1, 9, "b"), (2, 4, None), (3, 4, None)], key=repr)


def test_tolerance_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-3, 3, (60, 2)), rng.uniform(-3, 3, (70, 2))
    left = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], "k int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(b)], "k int, x double, y double")
    got = {(r.k, r.o) for r in joins.within_tolerance(left, right, {"x": 0.4, "y": 0.7}, "k", "o").collect()}
    assert got == {(i, j) for i, j in itertools.product(range(60), range(70)) if abs(a[i, 0] - b[j, 0]) <= 0.4 and abs(a[i, 1] - b[j, 1]) <= 0.7}


def test_overlaps_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    made = lambda n, top: [(int(k), float(x), float(x + w)) for k, x, w in zip(rng.integers(0, 2, n), rng.integers(0, top, n), rng.choice([0, 1, 3, 50, -2], n))]
    a, b = [*made(60, 90), (0, None, 1.0), (5, 0.0, 1.0)], [*made(50, 90), (0, 1.0, None), (6, 0.0, 1.0)]
    got = joins.overlapping(spark.createDataFrame(a, "k int, lo double, hi double"), spark.createDataFrame(b, "k int, lo double, hi double"), ["k"]).collect()
    want = [(x[0], *x[1:], *y[1:]) for x, y in itertools.product(a, b) if x[0] == y[0] and None not in x + y and x[1] < y[2] and y[1] < x[2]]
    assert sorted(map(tuple, got)) == sorted(want)
    dated = lambda df: df.select("k", F.date_add(F.lit("2020-01-01").cast("date"), F.col("lo").cast("int")).alias("lo"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("hi").cast("int")).alias("hi"))
    days = joins.overlapping(dated(spark.createDataFrame(a, "k int, lo double, hi double")), dated(spark.createDataFrame(b, "k int, lo double, hi double")), ["k"])
    assert days.count() == len(want)


def test_windows_plan_has_one_shuffle(spark):
    df = spark.createDataFrame([("a", i, 0.01) for i in range(30)], "sid string, dt int, r double")
    plan = w.realized_vol(w.drawdown_state(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_auc_over_ranges_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(bool(p), float(v)) for p, v in zip(rng.integers(0, 2, 300), rng.integers(0, 60, 300))] + [(True, None), (False, None)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = statistics.rank_auc(spark.createDataFrame(rows, "p boolean, v double"), F.col("p"), "v")
        got = df.first()
        assert "rangepartitioning" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    of = lambda k: [-1 if v is None else v for p, v in rows if p == k]
    want = np.mean([(a > b) + (a == b) / 2 for a in of(True) for b in of(False)])
    assert (got.positives, got.negatives) == (len(of(True)), len(of(False))) and abs(got.auc - want) < 1e-12
