"""The derived-series graph: refusals by name, units, pruning, and values against loops."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tideglass.operators import derived as d

A, B = {"kind": "series", "series": "A", "units": "pct"}, {"kind": "series", "series": "B", "units": "idx"}


def of(expr, *inputs, **more):
    return {"kind": "derived", "expr": expr, "inputs": list(inputs), **more}


@pytest.mark.parametrize(
    "declared,said",
    [
        ({"a": A, "x": of("add", "a", "y"), "y": of("add", "x", "a")}, "a cycle: x <- y <- x"),
        ({"x": of("change", "x")}, "a cycle: x <- x"),
        ({"a": A, "x": of("add", "a", "b")}, "x: unknown input b"),
        ({"a": A, "b": B, "x": of("difference", "a", "b")}, "x: inputs of differing units: idx, pct"),
        ({"a": A, "x": of("change", "a", units="idx")}, "x: stated in idx, but change gives pct"),
        ({"a": A, "x": of("cube", "a")}, "x: unknown expression cube"),
        ({"a": A, "x": of("add", "a")}, "x: add takes 2 input"),
        ({"a": A, "x": of("growth", "a")}, "x: growth needs rows"),
        ({"a": {"kind": "file"}}, "a: kind must be one of derived, series, unavailable"),
        ({"a": {**A, "reason": "x"}}, "must not state reason"),
        ({"a": {"kind": "unavailable"}}, "needs reason"),
        ({"a": {**A, "proxy": True}}, "a proxy must be flagged"),
        ({"a": {**A, "proxy_for": "z"}}, "a proxy must be flagged"),
        ({"a": {**A, "numeraire": "shells"}}, "numeraire must be one of"),
        ({"a": {**A, "series": 3}}, "series must be a text"),
        ({"a": 3}, "must be a mapping"),
        ({}, "nothing is declared"),
    ],
)
def test_refusals(declared, said):
    with pytest.raises(d.DeclarationError, match=said.replace("(", r"\(")):
        d.graph(declared)


def test_blocks():
    both = {"a": A, "b": B}
    assert d.graph(both, {"x": ["a"], "y": ["b"]}).order == ("a", "b")
    for blocks, said in (({"x": ["a", "b"], "y": ["b"]}, "in several blocks: b"), ({"x": ["a"]}, "without a block"), ({"x": ["a", "b", "c"]}, "without a declaration: c")):
        with pytest.raises(d.DeclarationError, match=said):
            d.graph(both, blocks)


def test_units_and_absence():
    g = d.graph({"z": of("ratio", "s", "b"), "s": of("add", "a", "a"), "a": A, "b": B, "u": {"kind": "unavailable", "reason": "closed"}, "v": of("add", "a", "u"), "w": of("change", "v"), "k": of("spliced", "u", "b")})
    assert g.units == {"a": "pct", "s": "pct", "b": "idx", "z": "pct/idx", "k": "idx"} and g.absent == {"u": "closed", "v": "needs u", "w": "needs v"}
    assert g.order.index("a") < g.order.index("s") < g.order.index("z") and g.depth("z") == 2 and g.needed(["s"]) == ["a", "s"]
    assert d.expected_units("growth", ["usd"], {"rows": 12}) == "pct"
    with pytest.raises(d.DeclarationError, match="isn't declared"):
        g.needed(["q"])


def test_long_chains():
    n = 5000
    g = d.graph({"x0": A} | {f"x{i}": of("change", f"x{i - 1}") for i in range(n - 1, 0, -1)})
    assert g.order[0] == "x0" and g.order[-1] == f"x{n - 1}"


def test_values_against_loops(spark):
    months = [date(2000 + k // 12, k % 12 + 1, 1) for k in range(30)]
    rows = []
    for key in ("p", "q"):
        for k, m in enumerate(months):
            if k % 7 != 3:
                rows.append((key, "A", m, 10.0 + k + (key == "q")))
            if k >= 9:
                rows.append((key, "T", m, 3.0 + 2 * (5.0 + k * k)))
            rows.append((key, "D", m, 5.0 + k * k))
    rows += [("p", "A", None, 1.0), ("p", "other", months[0], 1.0), ("p", "A", months[0], 2.0), ("p", "A", months[1], None)]
    g = d.graph({"a": {**A, "series": "A"}, "t": {**A, "series": "T"}, "d": {**A, "series": "D"}, "none": {**A, "series": "Z"}, "c": of("change", "a"), "m": of("trailing_mean", "c", params={"rows": 2}), "s": of("spliced", "t", "d"), "l": of("demeaned_log", "a"), "x": of("add", "a", "none"), "free": of("average", "a", "d")})
    df = spark.createDataFrame(rows, "key string, sid string, dt date, v double")
    got = d.panel(df, g, by=["key"]).orderBy("key", "dt").collect()
    assert len(got) == 60 and all(r.x is None and r.none is None for r in got)
    for key in ("p", "q"):
        own = [r for r in got if r.key == key]
        a = [r.a for r in own]
        known = [k for k in range(30) if a[k] is not None]
        logs = [math.log(a[k]) for k in known]
        change = {k: a[k] - a[j] for j, k in zip(known, known[1:])}
        for k, r in enumerate(own):
            assert r.c == (change.get(k)) and r.s == pytest.approx(3.0 + 2 * (5.0 + k * k))
            assert (r.l is None) == (k not in known) and (k not in known or r.l == pytest.approx(math.log(a[k]) - sum(logs) / len(logs)))
            assert (r.free is None) == (k not in known)
        at = sorted(change)
        assert [r.m for k, r in enumerate(own) if k in at[1:]] == [pytest.approx((change[i] + change[j]) / 2) for i, j in zip(at, at[1:])]
    # only what is asked for is read, and depth adds no shuffle
    plan = d.panel(df, g, ["c"], by=["key"])
    assert plan.columns == ["key", "dt", "c"]
    deep = d.graph({"a": A} | {f"x{i}": of("change", f"x{i - 1}" if i else "a") for i in range(6)})
    text = d.panel(df, deep, ["x5"], by=["key"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 2 * 2  # each stands once more in the initial plan


def test_empty_table_and_clashing_names(spark):
    g = d.graph({"sid": A, "v": of("change", "sid")})
    df = spark.createDataFrame([], "sid string, dt date, v double")
    assert d.panel(df, g).collect() == [] and d.stacked(d.panel(df, g), g.order).collect() == []
    told = d.coverage(d.panel(df, g), g).collect()
    assert {(r.name, r.rows, r.missing) for r in told} == {("sid", 0, "no rows"), ("v", 0, "no rows")}
    one = spark.createDataFrame([("A", date(2000, 1, 1), 1.0), ("A", date(2000, 2, 1), 4.0)], "sid string, dt date, v double").withColumn("extra", F.lit(1))
    assert [tuple(r) for r in d.panel(one, g).orderBy("dt").collect()] == [(date(2000, 1, 1), 1.0, None), (date(2000, 2, 1), 4.0, 3.0)]
