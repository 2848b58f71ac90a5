"""Fits by aggregates against loops over the same rows."""

import hashlib
import math

import numpy as np
import pytest

from tideglass.operators import utility as ut


def draw(seed, i):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)


def descent(x, y, w):
    """Plain full-batch steps until the gradient is gone."""
    x = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (0.25 * (w[:, None] * x * x).sum() / w.sum() + ut.RIDGE)
    v = np.zeros(x.shape[1])
    for _ in range(200_000):
        g = x.T @ (w * (1 / (1 + np.exp(-x @ v)) - y)) / w.sum() + ut.RIDGE * v
        if np.abs(g).max() < 1e-11:
            break
        v = v - step * g
    return v


def test_logistic_fit_equals_descent(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3)) * [1, 4, 0.2]
    y = (x @ [1, -0.5, 3] + rng.standard_normal(300) > 0.3).astype(float)
    w = rng.uniform(0.1, 2, 300)
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w)], "a double, b double, c double, y double, w double").repartition(5)
    got, taken = ut.logistic_fit(df, ["a", "b", "c"], "y", "w")
    assert np.allclose(got, descent(x, y, w), atol=1e-7) and taken < 15
    apart = spark.createDataFrame([(float(k), float(k > 0), 1.0) for k in (-500, -2, 2, 500)], "a double, y double, w double")
    assert all(map(math.isfinite, ut.logistic_fit(apart, ["a"], "y", "w")[0]))


def test_discriminative_score_on_the_same_split(spark):
    rng = np.random.default_rng(2)
    real, made = rng.standard_normal((40, 2)), rng.standard_normal((400, 2)) * [1, 1.7] + [0.8, 0]
    frame = lambda rows: spark.createDataFrame([(i, *map(float, r), "x") for i, r in enumerate(rows)] + [(9999, None, 1.0, "x")], "i long, m double, s double, label string").repartition(3)
    got = ut.discriminative_score(frame(real), frame(made), ["m", "s"], ["i"], seed=5).first()
    parts = {}
    for label, rows, seed in ((1, real, 5), (0, made, 6)):
        order = sorted(range(len(rows)), key=lambda i: draw(seed, i))
        n = round(0.7 * len(rows))
        parts[label] = rows[order[:n]], rows[order[n:]]
    x = np.vstack([parts[1][0], parts[0][0]])
    y = np.repeat([1.0, 0.0], [len(parts[1][0]), len(parts[0][0])])
    mean, sd = x.mean(0), x.std(0)
    v = descent((x - mean) / sd, y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())))
    recall = {k: float(((((parts[k][1] - mean) / sd) @ v[:-1] + v[-1] >= 0) == (k == 1)).mean()) for k in (1, 0)}
    assert (got.real_rows, got.generated_rows) == (40, 400) and got.real_recall == recall[1] and got.generated_recall == recall[0]
    assert got.score == pytest.approx(abs((recall[0] + recall[1]) / 2 - 0.5))
    assert ut.discriminative_score(frame(real[:1]), frame(made), ["m", "s"], ["i"]).collect() == []


def test_degradation(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(90)
    real = [(i, float(a), float(0.5 * a + b)) for i, (a, b) in enumerate(zip(x, rng.standard_normal(90) * 0.1))]
    made = [(i, float(a), float(-0.5 * a)) for i, a in enumerate(rng.standard_normal(61))]
    frame = lambda rows: spark.createDataFrame(rows, "i long, x double, y double")

    def line(rows):
        m = np.array([[np.mean([a * a for _, a, _ in rows]) + ut.RIDGE, np.mean([a for _, a, _ in rows])], [np.mean([a for _, a, _ in rows]), 1 + ut.RIDGE]])
        b, a = np.linalg.solve(m, [np.mean([p * q for _, p, q in rows]), np.mean([q for *_, q in rows])])
        return a, b

    def error(rows, fit):
        return np.mean([(q - fit[0] - fit[1] * p) ** 2 for _, p, q in rows])

    by = lambda rows: sorted(rows, key=lambda r: draw(7, r[0]))
    tstr, trtr = error(real, line(by(made)[:30])), error(by(real)[45:], line(by(real)[:45]))
    got = ut.tstr_degradation(frame(made), frame(real), ["i"], 7).first()
    assert got.tstr == pytest.approx(tstr) and got.trtr == pytest.approx(trtr) and got.degradation == pytest.approx(tstr / trtr)
    assert ut.tstr_degradation(frame(made), frame(real[:3]), ["i"]).collect() == [] and ut.predictive_score(frame(made[:1]), frame(real), ["i"]).collect() == []


def test_features_and_pairs_stay_within_series(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 0, 9.0), ("a", 9, None)], "sid string, dt int, r double")
    assert sorted((r.sid, r.block, r["mean"], r.deviation) for r in ut.window_features(df, 2).collect()) == [("a", 0, 0.5, 0.5), ("a", 1, 2.5, 0.5)]
    assert sorted((r.sid, r.x, r.y) for r in ut.one_step_pairs(df).collect()) == [("a", float(i), i + 1.0) for i in range(4)]
