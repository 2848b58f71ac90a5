"""Reference statistics against loops, and bands against the same resamples in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import reference as rf
from tideglass.operators import resample as rs


def plain(x, lags=rf.LAGS, horizons=rf.HORIZONS):
    n, d = len(x), x - x.mean()
    a = np.abs(d) - np.abs(d).mean()
    out = {"mean": x.mean(), "std": x.std(ddof=1), "skew": (d**3).mean() / (d**2).mean() ** 1.5, "excess_kurtosis": (d**4).mean() / (d**2).mean() ** 2 - 3}
    for kind, v in (("r", d), ("abs", a)):
        for k in lags:
            out[f"acf_{kind}_lag{k}"] = (v[k:] * v[:-k]).sum() / (v * v).sum() if n > k else None
        own = [out[f"acf_{kind}_lag{k}"] for k in lags]
        out[f"acf_{kind}_sum"] = None if None in own else sum(own)
    out["leverage"] = np.corrcoef(x[:-1], np.abs(d[1:]))[0, 1]
    k = max(1, round(n * rf.TAIL))
    top = np.sort(-x)[::-1][: k + 1]
    out["hill"] = 1 / np.log(top[:-1] / top[-1]).mean() if top[-1] > 0 else None
    wealth = np.concatenate([[1.0], np.cumprod(1 + x)])
    out["max_drawdown"] = (1 - wealth / np.maximum.accumulate(wealth)).max()
    for h in horizons:
        s = x[: n // h * h].reshape(-1, h).sum(1)
        e = s - s.mean()
        out[f"agg_gaussianity_{h}"] = (e**4).mean() / (e**2).mean() ** 2 - 3 if len(s) >= rf.LEAST_BLOCKS else None
        out[f"variance_ratio_{h}"] = s.var(ddof=1) / (h * x.var(ddof=1)) if len(s) >= rf.LEAST_BLOCKS else None
    return out


def test_statistics_against_loops(spark):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(0.01, 0.05, 70), "b": rng.standard_t(3, 30) * 0.03, "short": rng.normal(0, 0.1, 9)}
    rows = [(k, i, float(v)) for k, own in series.items() for i, v in enumerate(own)] + [("a", 500, None), ("one", 0, 0.1), ("flat", 0, 0.25), ("flat", 1, 0.25), ("flat", 2, 0.25)]
    df = spark.createDataFrame(rows, "sid string, t int, r double").withColumn("mean", F.lit("x")).repartition(3)
    wide = rf.statistics(df, ["sid"], "t", "r")
    got = {r.sid: r for r in wide.collect()}
    for k, own in series.items():
        want = plain(own)
        assert set(want) == set(rf.names()) and got[k].n == len(own)
        for name, v in want.items():
            assert got[k][name] == (None if v is None else pytest.approx(v, rel=1e-9, abs=1e-12)), (k, name)
    flat = {(r.sid, r.stat): r.value for r in rf.long(wide, ["sid"], rf.names()).collect() if r.sid in ("one", "flat")}
    assert flat["one", "mean"] == 0.1 and flat["flat", "std"] == 0 and all(flat[k, s] is None for k in ("one", "flat") for s in ("skew", "leverage", "hill", "acf_r_lag1", "variance_ratio_3"))
    assert rf.statistics(df.limit(0), ["sid"], "t", "r").collect() == []


def test_bands_over_the_same_resamples(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.0, 0.05, 40)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "sid string, t int, r double")
    got = {r.stat: r for r in rf.bands(df, "sid", "t", "r", 50, 0.2, 3, length=25).collect()}
    draws = rs.block_draws(spark, 50, spark.createDataFrame([("s", 40)], "sid string, n long"), 0.2, 3, length=25).orderBy("path", "m").toPandas()
    stats = [plain(x[own.row.to_numpy()]) for _, own in draws.groupby("path")]
    for name in rf.names():
        own = [s[name] for s in stats if s[name] is not None and np.isfinite(s[name])]
        assert got[name].n == len(own), name
        if own:
            assert (got[name].lo, got[name].hi) == pytest.approx((np.quantile(own, 0.05), np.quantile(own, 0.95)), rel=1e-8, abs=1e-10), name
    made = spark.createDataFrame([("s", "mean", 0.0), ("s", "mean", 1.0), ("s", "std", got["std"].lo), ("s", "hill", None)], "sid string, stat string, value double")
    told = {r.stat: r for r in rf.judged(made, rf.bands(df, "sid", "t", "r", 50, 0.2, 3, length=25), "sid").collect()}
    assert told["mean"].verdict == "fail" and told["mean"].outside > 1 and told["std"].verdict == "pass" and told["std"].outside == 0 and told["hill"].verdict == "missing" and len(told) == len(rf.names())


def test_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 50))
    rows = [("a", i, float(v)) for i, v in enumerate(a)] + [("b", i + 10, float(v)) for i, v in enumerate(b)] + [("c", 99, 1.0)]
    got = {(r.pair, r.stat): r for r in rf.pair_bands(spark.createDataFrame(rows, "sid string, t int, r double"), [("a", "b"), ("a", "c")], "sid", "t", "r", 30, 0.2, 1).collect()}
    assert set(got) == {("a~b", "correlation"), ("a~b", "abs_correlation")} and got["a~b", "correlation"].value == pytest.approx(np.corrcoef(a[10:], b[:40])[0, 1]) and got["a~b", "correlation"].n == 30
