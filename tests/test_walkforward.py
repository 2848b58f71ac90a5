"""Walk-forward weights and results against loops; optimality of the constrained weights."""

from datetime import date

import numpy as np
import pytest

from tideglass.operators import walkforward as wf


def test_long_only_weights_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 7))
        x = rng.standard_normal((n + 3, n)) * rng.uniform(0.01, 0.2, n)
        cov, mean = np.cov(x, rowvar=False).reshape(n, n), rng.normal(0.0, 0.02, n)
        w = wf.long_only_weights(mean, cov)
        assert (w >= 0).all() and w.sum() == pytest.approx(1)
        a = cov + wf.RIDGE * np.eye(n)
        if (mean > 0).any():
            # w is a multiple of the optimum: the multiple that meets the first condition must meet all
            scale = (mean @ w) / (w @ a @ w)
            gradient = mean - a @ (scale * w)
            assert scale > 0 and np.abs(gradient[w > 1e-9]).max(initial=0) < 1e-7 and gradient[w <= 1e-9].max(initial=-1) < 1e-7
        else:
            assert np.allclose(w, 1 / n)


def test_folds_against_loops(spark):
    rng = np.random.default_rng(2)
    months = [date(1990 + k // 12, k % 12 + 1, 1) for k in range(130)]
    x = rng.normal(0.01, 0.05, (130, 3))
    rows = [("u", m, *map(float, r)) for m, r in zip(months, x)] + [("u", date(2005, 1, 1), 0.1, None, 0.1), ("v", date(1990, 1, 1), 0.1, 0.1, 0.1), ("v", date(1999, 5, 1), 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "k string, dt date, p double, q double, s double").repartition(3)
    target = {"p": 3.0, "q": 2.0}
    policies = {"clip": "clipped", "long": "long_only", "fixed": target, "band": ("banded", target)}
    years = [1991, 1995, 1999, 2000, 2003]
    got = {(r.k, r.fold, r.policy): r for r in wf.walk_forward(df, ["p", "q", "s"], years, policies, date(1990, 3, 1), ["k"]).collect()}
    known = [i for i, m in enumerate(months) if m >= date(1990, 3, 1)]
    fixed = np.array([0.6, 0.4, 0.0])
    for year in (1991, 1995, 1999, 2000):
        test = [i for i in known if months[i].year == year]
        for name in policies:
            path = []
            for q in range(0, len(test), 3):
                past = x[[i for i in known if i < test[q]]]
                drifted = fixed * np.prod(1 + past[-12:], axis=0)
                drifted = drifted / drifted.sum()
                w = {"clip": wf.clipped_weights(past.mean(0), np.cov(past, rowvar=False)), "long": wf.long_only_weights(past.mean(0), np.cov(past, rowvar=False)), "fixed": fixed, "band": fixed if np.abs(drifted - fixed).max() > 0.05 else drifted}[name]
                path += list(x[test[q : q + 3]] @ w)
            wealth = np.concatenate([[1.0], np.cumprod(1 + np.array(path))])
            r = got["u", year, name]
            assert (r.rows, r.terminal_log_wealth, r.max_drawdown) == pytest.approx((len(test), np.log(wealth[-1]), (1 - wealth / np.maximum.accumulate(wealth)).max()), abs=1e-9)
    assert not any(k[1] == 2003 for k in got) and ("v", 1999, "clip") in got and got["v", 1999, "clip"].terminal_log_wealth is None and got["v", 1999, "fixed"].rows == 1
    with pytest.raises(ValueError, match="no asset z"):
        wf.weights(df, ["p", "q", "s"], years, {"x": {"z": 1.0}})
    assert wf.walk_forward(df.limit(0), ["p", "q", "s"], years, policies, by=["k"]).collect() == []


def test_surprise_and_alphas(spark):
    real = spark.createDataFrame([("a", 0.3), ("b", 0.1)], "k string, max_drawdown double")
    ens = spark.createDataFrame([("a", i / 100) for i in range(101)] + [("b", 0.2)], "k string, max_drawdown double")
    assert {r.k: (r.paths, r.surprise) for r in wf.drawdown_surprise(real, ens, ["k"]).collect()} == {"a": (101, pytest.approx(0.3 - 0.95)), "b": (1, pytest.approx(-0.1))}
    rows = [("a", 0, 1.0, 1.0), ("a", 1, 1.1, 1.1), ("a", 2, 1.5, 1.35), ("a", 3, -1.0, 1.0), ("b", 0, 1.0, 1.0)]
    got = [r.alpha for r in wf.alpha_by_window(spark.createDataFrame(rows, "sid string, dt int, o double, t double"), "o", "t").orderBy("dt").collect()]
    assert got == [pytest.approx(0, abs=1e-12), pytest.approx(np.log(1.5 / 1.35))]
