"""Extensions on both ends against numpy."""

from datetime import date

import numpy as np
import pytest

from tideglass.operators import extend as ex


def month(k):
    return date(1990 + k // 12, k % 12 + 1, 1)


def frame(spark, rows, columns="sid string, dt date, v double"):
    return spark.createDataFrame(rows, columns)


def test_segments(spark):
    rng = np.random.default_rng(1)
    base, mid, old = rng.normal(5, 1, 40), rng.normal(2, 1, 40), rng.normal(9, 1, 60)
    new = [("a", month(60 + k), float(v)) for k, v in enumerate(base)] + [("b", month(0), 1.0), ("a", month(61), None), ("a", None, 3.0)]
    middle = [("a", month(45 + k), float(v)) for k, v in enumerate(mid)] + [("b", month(50), 2.0)]
    oldest = [("a", month(k), float(v)) for k, v in enumerate(old)] + [("z", month(0), 1.0)]
    whole, told = ex.joined_segments([frame(spark, x) for x in (new, middle, oldest)], 12)
    got = {(r.sid, r.dt): r.v for r in whole.collect()}
    first = base[:25].mean() - mid[15:].mean()
    one = mid + first
    chained = np.concatenate([one[:15], base])
    second = chained[:15].mean() - old[45:].mean()
    want = np.concatenate([old[:45] + second, chained])
    assert [got["a", month(k)] for k in range(100)] == pytest.approx(list(want)) and [k for k in got if k[0] != "a"] == [("b", month(0))]
    by = {(r.sid, r.join): r for r in told.collect()}
    assert by["a", 1].offset == pytest.approx(first) and by["a", 1].rmse == pytest.approx((base[:25] - mid[15:]).std()) and by["a", 2].overlap == 15 and by["b", 1].fault == "too few common months" and ("z", 2) not in by


def test_both_ends_and_holes(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(3, 1, 100), rng.normal(0, 1, 100)
    y = 1 + 2 * x - z + rng.normal(0, 0.1, 100)
    have = [k for k in range(30, 80) if k != 50]
    target = frame(spark, [("a", month(k), float(y[k])) for k in have] + [("few", month(k), 1.0) for k in range(5)] + [("flat", month(k), float(k)) for k in range(20)])
    donors = frame(spark, [("a", month(k), float(x[k]), float(z[k])) for k in range(100)] + [("few", month(k), float(k), 1.0) for k in range(40)] + [("flat", month(k), 1.0, float(k)) for k in range(40)] + [("a", month(200), None, 1.0)], "sid string, dt date, x double, z double")
    got = {(r.sid, r.dt): r for r in ex.extended(target, donors, ["x", "z"], "rule", month(35), month(70), 12).collect()}
    fit = [k for k in have if 35 <= k <= 70]
    design = np.column_stack([np.ones(100), x, z])
    b, *_ = np.linalg.lstsq(design[fit], y[fit], rcond=None)
    for k in range(100):
        r = got["a", month(k)]
        assert r.is_proxy == (k not in have) and r.v == pytest.approx(y[k] if k in have else design[k] @ b) and r.rule == "rule"
    assert len(got) == 125 and not any(r.is_proxy for (sid, _), r in got.items() if sid != "a")
    told = {r.sid: r for r in ex.overlap_report(target, donors, ["x", "z"], month(35), month(70), 12).collect()}
    assert told["a"].n == len(fit) and told["a"].coefficients == pytest.approx(list(b)) and told["a"].corr == pytest.approx(np.corrcoef(y[fit], design[fit] @ b)[0, 1]) and told["a"].rmse == pytest.approx(np.sqrt(((y[fit] - design[fit] @ b) ** 2).mean()))
    assert told["few"].fault == "too few rows" if "few" in told else True
    logs = ex.extended(frame(spark, [("a", month(k), float(np.exp(1 + 2 * np.log(k + 1)))) for k in range(10, 50)]), frame(spark, [("a", month(k), float(k + 1)) for k in range(60)] + [("a", month(70), -1.0)], "sid string, dt date, x double"), ["x"], "log", least=12, log=True)
    assert {r.dt: r.v for r in logs.collect()} == {month(k): pytest.approx(float(np.exp(1 + 2 * np.log(k + 1)))) for k in range(60)}
    assert ex.extended(target.limit(0), donors, ["x", "z"], "r").collect() == []


def test_collateral_and_checks(spark):
    excess = frame(spark, [("a", month(k), 0.01 * k) for k in range(30)] + [("b", month(k), 0.1) for k in range(11)] + [("c", month(0), 0.1)])
    rate = frame(spark, [("a", month(k), 0.001) for k in range(10, 40) if k != 15] + [("b", month(k), 0.1) for k in range(11)] + [("a", month(16), None)])
    total, told = ex.collateral_return(excess, rate)
    assert {r.dt: r.v for r in total.collect()} == {month(k): pytest.approx(0.01 * k + 0.001) for k in range(10, 30) if k != 15}
    assert {r.sid: tuple(r)[1:] for r in told.collect()} == {"a": (19, month(0), month(9), None), "b": (11, None, None, "too few common months"), "c": (0, None, None, "too few common months")}
    rng = np.random.default_rng(4)
    level = np.exp(np.cumsum(rng.normal(0, 0.1, 40)))
    spot = np.diff(np.log(level)) + rng.normal(0, 0.02, 39)
    got = ex.return_check(frame(spark, [("a", month(k + 1), float(v)) for k, v in enumerate(spot)] + [("b", month(1), 0.1)]), frame(spark, [("a", month(k), float(v)) for k, v in enumerate(level)]))
    by = {r.sid: r for r in got.collect()}
    assert by["a"].n == 39 and by["a"].correlation == pytest.approx(np.corrcoef(spot, np.diff(np.log(level)))[0, 1]) and (by["b"].n, by["b"].correlation, by["b"].fault) == (0, None, "too few common months")


def test_stepped_index_and_pin(spark):
    steps = frame(spark, [("x", month(0), 2.0), ("x", month(5), 4.0), ("y", month(2), 10.0), ("y", month(5), 5.0), ("y", month(5), 4.0), ("x", month(7), -1.0), ("y", None, 3.0)], "sid string, dt date, rate double")
    months = frame(spark, [(month(k),) for k in range(9)] * 2, "dt date")
    got = {r.dt: (r["index"], r.members) for r in ex.stepped_index(steps, months).collect()}
    assert got == {month(k): (pytest.approx(100.0 if k < 5 else 100 * (2 * 0.5) ** 0.5), 2) for k in range(2, 9)}
    out = ex.pinned_front(frame(spark, [(month(6), 8.0), (month(7), 9.0)], "dt date, v double"), frame(spark, [(month(k), float(k + 1)) for k in range(9)], "dt date, v double"), "pin")
    assert {r.dt: (r.v, r.is_proxy) for r in out.collect()} == {**{month(k): (pytest.approx((k + 1) * 8 / 6), True) for k in range(6)}, month(6): (8.0, False), month(7): (9.0, False)}
    assert ex.stepped_index(steps.limit(0), months).collect() == []
