"""Bounds and rules over nested documents on seeded faults."""

import json

from pyspark.sql import functions as F

from tideglass.operators import rules as ru

SCHEMA = "a struct<x:double,n:int,deep:struct<y:double>>, list array<struct<v:double,w:array<bigint>>>, other string"


def docs(spark, *said):
    rows = [(i, None if d is None else json.dumps(d)) for i, d in enumerate(said)]
    return spark.createDataFrame(rows, "id int, text string").select("id", F.from_json("text", SCHEMA).alias("doc"))


def test_clamps_everywhere(spark):
    df = docs(spark, {"a": {"x": 9.5, "n": 7, "deep": {"y": -3}}, "list": [{"v": 1}, {"v": 50, "w": [1, 99]}, None], "other": "x"}, {"a": {"x": 2, "n": None}}, {"list": []}, None, {"a": {"x": 3.0, "n": 3, "deep": {"y": 0}}})
    bounds = {"/a/x": (None, 5), "/a/n": (None, 4.5), "/a/deep/y": (0, None), "/list/*/v": (2, 10), "/list/*/w/*": (0, 9), "/no/such": (0, 1)}
    got = {r.id: r for r in ru.clamped(df, "doc", bounds).collect()}
    assert [(c.path, c.submitted, c.applied) for c in got[0].clamps] == [("/a/x", 9.5, 5), ("/a/n", 7, 4), ("/a/deep/y", -3, 0), ("/list/0/v", 1, 2), ("/list/1/v", 50, 10), ("/list/1/w/1", 99, 9)]
    d = got[0].doc
    assert (d.a.x, d.a.n, d.a.deep.y, d.list[0].v, d.list[1].w, d.list[2], d.other) == (5, 4, 0, 2, [1, 9], None, "x")
    assert got[1].clamps == [] and got[1].doc.a.n is None and got[1].doc.list is None and got[2].doc.list == [] and got[3].doc is None and got[3].clamps == [] and got[4].clamps == []
    assert ru.clamped(df, "doc", {}).first().clamps == [] and ru.clamped(df.limit(0), "doc", bounds).collect() == []


def test_windows(spark):
    rows = [(1, 8, [(0, 3), (6, 4), (2, 20), (None, 50), (7, 1)]), (2, None, [(6, 99)]), (3, 4, None)]
    df = spark.createDataFrame(rows, "id int, q int, w array<struct<start:bigint,length:bigint>>")
    new, told = ru.windows_inside(F.col("w"), F.col("q"), "/w")
    got = {r.id: r for r in df.select("id", new.alias("w"), told.alias("c")).collect()}
    assert [tuple(x) for x in got[1].w] == [(0, 3), (4, 4), (0, 8), (None, 50), (7, 1)]
    assert [tuple(c) for c in got[1].c] == [("/w/1/start", 6, 4), ("/w/2/length", 20, 8), ("/w/2/start", 2, 0)]
    assert [tuple(x) for x in got[2].w] == [(6, 99)] and got[2].c == [] and got[3].w is None and got[3].c == []


def test_verdicts(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, v int")
    rules = [ru.Rule("R1", True, F.col("v") > 0, F.concat(F.lit("v is "), F.col("v").cast("string"))), ru.Rule("R2", False, F.lit(False), F.lit("always")), ru.Rule("R3", True, F.lit(None).cast("boolean"), F.lit("?"))]
    got = {(r.id, r.rule): (r.blocking, r.verdict, r.message) for r in ru.judged(df, ["id"], rules).collect()}
    assert got[1, "R1"] == (True, "passed", None) and got[2, "R1"] == (True, "failed", "v is -1") and got[3, "R1"] == (True, "not evaluated", None) and got[1, "R2"] == (False, "failed", "always") and len(got) == 9
    told = {r.id: (r.accepted, r.refusals, r.warnings, r.untold) for r in ru.decided(df, ["id"], rules).collect()}
    assert told == {1: (True, [], ["R2"], ["R3"]), 2: (False, ["R1"], ["R2"], ["R3"]), 3: (True, [], ["R2"], ["R1", "R3"])}
