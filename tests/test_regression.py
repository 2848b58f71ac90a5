"""Regressions against numpy, distances against numpy."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import regression as reg
from tideglass.operators import support as sup


def plain(x, y, lags):
    x = np.column_stack([np.ones(len(x)), x])
    n, k = x.shape
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    inv = np.linalg.inv(x.T @ x)
    u = x * e[:, None]
    s = u.T @ u
    for lag in range(1, lags + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    hac = np.sqrt(np.diag(inv @ s @ inv) * n / (n - k))
    return b, np.sqrt(np.diag(inv) * (e @ e) / (n - k)), hac, 1 - e @ e / ((y - y.mean()) ** 2).sum()


def test_newey_west_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, n in (("a", 120), ("b", 40)):
        x = rng.standard_normal((n, 4)) * [1, 0.1, 5, 1] + [0, 3, 100, -2]
        y = x @ [0.5, -2, 0.1, 1] + np.convolve(rng.standard_normal(n + 3), np.ones(4))[3 : n + 3]
        want[key] = plain(x, y, 12)
        rows += [(key, i, *map(float, x[i]), float(y[i])) for i in range(n)]
    rows += [("a", 500, None, 1.0, 1.0, 1.0, 1.0), ("a", 501, 1.0, 1.0, 1.0, 1.0, None), ("few", 0, 1.0, 2.0, 3.0, 4.0, 5.0)]
    rows += [("same", i, float(i), 2.0 * i, float(i % 3), float(i % 5), float(i % 7)) for i in range(50)] + [("flat", i, 1.0, float(i), float(i % 3), float(i % 5), 1.0) for i in range(50)]
    xs = ["p", "q", "r", "s"]
    df = spark.createDataFrame(rows, "sid string, t int, p double, q double, r double, s double, y double").withColumn("term", F.lit(0)).repartition(4)
    got = reg.newey_west(df, "y", xs, "t", 12, ["sid"]).collect()
    for key, (b, ols, hac, r2) in want.items():
        own = {r.term: r for r in got if r.sid == key}
        assert list(own) == ["const", *xs] or set(own) == {"const", *xs}
        for i, term in enumerate(["const", *xs]):
            r = own[term]
            assert (r.coef, r.se_ols, r.se_hac, r.r2) == pytest.approx((b[i], ols[i], hac[i], r2), rel=1e-8) and r.t_hac == pytest.approx(b[i] / hac[i], rel=1e-8)
    assert {r.sid: r.fault for r in got if r.fault} == {"few": "too few rows", "same": "singular", "flat": "singular"}
    whole = reg.newey_west(df.where("sid = 'b'"), "y", xs, "t", 12).collect()
    assert len(whole) == 5 and whole[0].coef == pytest.approx(want["b"][0][0], rel=1e-8)
    assert reg.newey_west(df.where("sid = 'none'"), "y", xs, "t", 12, ["sid"]).collect() == []


def test_features_know_no_later_day(spark):
    rng = np.random.default_rng(2)
    days = [date(2000, 1, 1) + timedelta(k) for k in range(200)]
    rows = [("s", d, float(c)) for d, c in zip(days, np.exp(np.cumsum(rng.standard_normal(200) * 0.02)))]
    df = spark.createDataFrame(rows, "sid string, dt date, close double")
    whole = {r.month: tuple(r) for r in reg.realized_features(df, [22, 66], 66, 15).collect()}
    early = {r.month: tuple(r) for r in reg.realized_features(df.where("dt < '2000-05-01'"), [22, 66], 66, 15).collect()}
    assert early and all(whole[m] == v for m, v in early.items()) and len(whole) > len(early)
    x = np.diff(np.log([c for _, _, c in rows]))
    end = [i for i, d in enumerate(days) if d < date(2000, 5, 1)][-1]
    assert early[date(2000, 4, 1)][2] == pytest.approx(np.log(x[end - 22 : end].std(ddof=1) * np.sqrt(252) * 100))
    top = max(c for _, _, c in rows[end - 65 : end + 1])
    assert early[date(2000, 4, 1)][4] == pytest.approx(np.log1p(1 - rows[end][2] / top))


def test_backcast_keeps_what_was_observed(spark):
    months = [date(2000 + k // 12, k % 12 + 1, 1) for k in range(60)]
    features = spark.createDataFrame([("s", m, float(k % 7), float(k * k % 11)) for k, m in enumerate(months)], "sid string, month date, a double, b double")
    observed = spark.createDataFrame([("s", m, float(np.exp(1 + 0.1 * (k % 7) - 0.2 * (k * k % 11)))) for k, m in enumerate(months) if k >= 24], "sid string, month date, v double")
    got = reg.backcast(features, observed, ["a", "b"]).orderBy("month").collect()
    assert [r.is_proxy for r in got] == [True] * 24 + [False] * 36
    assert [r.v for r in got] == pytest.approx([float(np.exp(1 + 0.1 * (k % 7) - 0.2 * (k * k % 11))) for k in range(60)])
    assert not any(r.is_proxy for r in reg.backcast(features, observed, ["a", "b"], least=37).collect())


def test_support_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([(i % 5, *map(float, r)) for i, r in enumerate(x)] + [(0, *[None] * 12)], "k int, " + ", ".join(f"{c} double" for c in names))
    ref = sup.support_reference(df, names, 0.95)
    cov = np.cov(x, rowvar=False)
    inv = np.linalg.inv(cov + sup.RIDGE * np.trace(cov) / 12 * np.eye(12))
    d = np.sqrt(np.einsum("ij,jk,ik->i", x - x.mean(0), inv, x - x.mean(0)))
    assert ref.n == 400 and ref.threshold == pytest.approx(np.quantile(d, 0.95), rel=1e-8)
    for r in sup.support(df, ref, ["k"]).collect():
        own = d[np.arange(400) % 5 == r.k]
        assert (r.n, r["mean"], r.p95, r.largest, r.beyond) == pytest.approx((80, own.mean(), np.quantile(own, 0.95), own.max(), (own > ref.threshold).mean()), rel=1e-7)
    for bad in (df.limit(1), df.where("k = 9"), spark.createDataFrame([(1, *[2.0] * 12)] * 4, df.schema)):
        with pytest.raises(ValueError):
            sup.support_reference(bad, names)
