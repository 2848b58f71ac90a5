"""Differences of nested documents, and digests, on seeded rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tideglass.operators import digests as dg
from tideglass.operators import documents as doc


def changes(spark, old, new):
    frame = lambda docs: spark.createDataFrame([(k, v) for k, v in docs.items()], "id int, document string").withColumn("path", F.lit(0))
    return {(r.id, r.path): (r.change, r.old_kind, r.old_value, r.new_kind, r.new_value) for r in doc.difference(frame(old), frame(new), ["id"]).collect()}


def test_seeded_differences(spark):
    old = {1: {"a": {"b": [1, {"c": "x"}], "d": None}, "e": True, "odd key": 1, "s": "1"}, 2: {"same": [1, 2]}, 3: {"gone": 1}, None: {"k": 1}}
    new = {1: {"a": {"b": [1, {"c": "y"}, 3], "d": {}}, "e": True, "odd key": 1.5, "s": 1}, 2: {"same": [1, 2]}, 4: ["n"], None: {"k": 2}}
    text = lambda docs: {k: json.dumps(v) for k, v in docs.items()}
    assert changes(spark, text(old), text(new)) == {
        (1, "$.a.b[1].c"): ("changed", "string", "x", "string", "y"),
        (1, "$.a.b[2]"): ("added", None, None, "number", "3"),
        (1, "$.a.d"): ("changed", "null", "null", "object", "{}"),
        (1, '$["odd key"]'): ("changed", "number", "1", "number", "1.5"),
        (1, "$.s"): ("changed", "string", "1", "number", "1"),
        (3, "$.gone"): ("removed", "number", "1", None, None),
        (4, "$[0]"): ("added", None, None, "string", "n"),
        (None, "$.k"): ("changed", "number", "1", "number", "2"),
    }


def test_deep_wide_and_broken_documents(spark):
    rng = random.Random(2)
    deep = "[" * 900 + "1" + "]" * 900
    wide = {f"k{i}": rng.random() for i in range(3000)}
    moved = {**wide, "k17": -1}
    got = changes(spark, {1: deep, 2: json.dumps(wide), 3: "{no", 4: None, 5: "{}"}, {1: deep.replace("1", "2"), 2: json.dumps(dict(reversed(moved.items()))), 3: "{}", 4: None, 5: "[]"})
    assert {k: v[0] for k, v in got.items()} == {(1, "$" + "[0]" * 900): "changed", (2, "$.k17"): "changed", (3, "$"): "changed", (5, "$"): "changed"} and got[3, "$"][1] == "unreadable"
    assert changes(spark, {}, {}) == {}


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "p int, m int, r double, s string").repartition(parts).withColumn("block", F.floor(F.col("m") / 16))


def test_digest_is_of_the_rows_alone(spark):
    rng = random.Random(3)
    rows = [(p, m, rng.choice([rng.random(), 0.1 + 0.2, None, -0.0, 1e300, float("nan")]), rng.choice(["x", None, "", "é"])) for p in range(3) for m in range(70)]
    block = ["p", "block"]
    digest = lambda df: dg.root_digest(dg.block_digests(df, block), block).first()
    one = digest(table(spark, rows, 1))
    rng.shuffle(rows)
    assert digest(table(spark, rows, 17)) == one and one.rows == 210 and one.blocks == 15 and one.digest.startswith("sha256:")
    near = [(p, m, 0.3 if r == 0.1 + 0.2 else 0.0 if r == 0 else r, s) for p, m, r, s in rows]
    assert digest(table(spark, near, 2)) == one
    kept, told = dg.record(table(spark, rows, 3), block, {"seed": "3"})
    changed = [(p, m, (r or 0) + 1e-9 if (p, m) == (1, 40) else r, s) for p, m, r, s in rows]
    assert told["digest"] == one.digest and dg.verify_run(table(spark, rows, 5), block, told) and not dg.verify_run(table(spark, changed, 5), block, told)
    found = lambda other: sorted(tuple(r) for r in dg.verify(kept, dg.block_digests(table(spark, other, 4), block), block).collect())
    assert found(rows) == [] and found(changed) == [(1, 2, "changed")]
    assert found([*rows, rows[0], (9, 0, 1.0, "x")]) == sorted([(rows[0][0], rows[0][1] // 16, "changed"), (9, 0, "unexpected")])
    assert found([r for r in rows if (r[0], r[1] // 16) != (2, 4)]) == [(2, 4, "missing")]


def test_values_don_t_run_into_each_other(spark):
    digest = lambda rows: dg.block_digests(spark.createDataFrame(rows, "k int, a string, b string"), ["k"]).first().digest
    assert len({digest([(1, a, b)]) for a, b in [("x", None), (None, "x"), ("x", ""), ("", "x"), ("x=", "y"), ("x", "=y"), ("-", None), (None, None)]}) == 8
    assert dg.root_digest(dg.block_digests(spark.createDataFrame([], "k int, a string"), ["k"]), ["k"]).first().blocks == 0
    with pytest.raises(KeyError):
        dg.verify_run(spark.createDataFrame([(1, "x")], "k int, a string"), ["k"], {})
