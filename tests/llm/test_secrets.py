"""Secret scans against plain regular expressions and entropies, and against their SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.llm import queries, secret_scan, sql

BASE = (
    ("assign", re.compile(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def plain_spans(text):
    text = text or ""
    out = []
    for rank, (kind, p, group, least) in enumerate(BASE):
        out += [(m.start(), rank, kind, m.end()) for m in p.finditer(text) if len(m[group]) >= least]
    for rank, (kind, of) in enumerate(secret_scan.CLASSES.items(), 3):
        last = 0
        for m in re.finditer(f"{of.letters}+", text):
            if len(m[0]) < of.window:
                continue
            before, last = text[max(last, m.start() - 64) : m.start()].translate({c: c + 32 for c in range(65, 91)}), m.end()
            if re.search(secret_scan.ALLOWED.replace(r"\z", r"\Z"), m[0]) or re.search(secret_scan.ALLOWED_BEFORE.replace(r"\z", r"\Z"), before):
                continue
            bits = lambda s: -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())
            hot = [k for k in range(len(m[0]) - of.window + 1) if bits(m[0][k : k + of.window]) >= of.bits - 1e-9]
            if hot:
                out.append((m.start() + hot[0], rank, kind, m.start() + hot[-1] + of.window))
    return sorted(out)


def plain(text):
    spans = plain_spans(text)
    told = lambda some: ",".join(f"{k}:{a}:{b}" for a, _, k, b in some)
    return (*(sum(s[2] == k for s in spans) for k, *_ in BASE), hashlib.sha256(told([s for s in spans if s[1] < 3]).encode()).hexdigest(), told(spans))


def made(seed, n):
    rng = random.Random(seed)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"

    def bit():
        return rng.choice(
            (
                lambda: "".join(rng.choices(b64, k=rng.choice((3, 24, 40, 90)))),
                lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice((8, 20, 24, 32, 64)))),
                lambda: "".join(rng.choices("0123456789ABCDEF", k=32)),
                lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.choice((5, 15, 16, 30)))),
                lambda: rng.choice(("password", "PassWd", "Token", "secret", "api_key", "APIKEY", "toKen", "ſecret")) + rng.choice(("=", ": ", '" : "', "==", " = '")) + "".join(rng.choices(b64 + ".=", k=rng.choice((1, 5, 6, 20)))),
                lambda: rng.choice(("é😀", "\n", "\x00", "ab" * 20, "a" * 30, "x9" * 20, "token=token: abcdefgh", "AKIAAKIA", "123e4567-e89b-12d3-a456-426614174000", "the-quick-brown-fox-jumps-over", "sha256:", "commit ", "https://x.org/", "data:image/png;base64,", "myEXAMPLEkey12345678abcdXY")),
            )
        )()

    return [rng.choice(("", " ", "\n", "; ")).join(bit() for _ in range(rng.choice((1, 2, 5, 30)))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_plain_python_and_sql(spark):
    texts = [None, "", "password=hunter", *made(1, 250)]
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)] + [(5, texts[5], "z"), (None, texts[6], "z")], "doc_id long, text string, spans string").repartition(3)
    got = rows_of(secret_scan.digests(secret_scan.secret_spans(df)))
    assert got == sorted([(i, *plain(x)) for i, x in enumerate(texts)] + [(5, *plain(texts[5])), (None, *plain(texts[6]))], key=repr)
    said = " ".join(r[-1] for r in got)
    assert all(kind in said for kind in [*secret_scan.KINDS, *secret_scan.CLASSES])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([*range(len(texts)), 5, None], dtype="Int64"), "text": pd.Series([*texts, texts[5], texts[6]], dtype=object)}))
    want = con.sql(sql.secrets())
    assert sorted(want.fetchall(), key=repr) == got and want.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def test_empty_table_and_long_texts(spark):
    assert secret_scan.digests(secret_scan.secret_spans(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    long = " ".join(made(2, 60)) * 15
    blob = "".join(random.Random(3).choices("ABCDEFGHabcdefgh0123456789", k=60_000))
    got = secret_scan.digests(secret_scan.secret_spans(spark.createDataFrame([(1, long), (2, blob), (3, "x" * 2_000_000)], "doc_id long, text string")))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {1: plain(long), 2: plain(blob), 3: plain("x" * 2_000_000)}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_running_sums(spark, n):
    values = [k * 7 % 11 for k in range(n)]
    got = spark.createDataFrame([(values,)], "a array<int>").select(secret_scan.running(F.col("a"))).first()[0]
    assert got == [sum(values[: k + 1]) for k in range(n)]


def test_allowed_and_hot(spark):
    hot = "q7Zk2Vx9Lm4Rt8Wp1Ys6Bn3Hd5"
    texts = [hot, f"commit: {hot}", f"https://a.b/{hot}", f"data:image/png;base64,{hot}", hot.replace("7Zk2", "xxxx"), "z" * 40 + hot + "z" * 40, f"'{hot}'"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == [("entropy-base64", 0, len(hot))] and got[6] == [("entropy-base64", 1, 1 + len(hot))]
    assert not any(got[k] for k in (1, 2, 3, 4))
    (kind, start, end) = got[5][0]
    assert kind == "entropy-base64" and 30 < start <= 40 and 40 + len(hot) <= end < 76


def test_plan_is_native(spark):
    plan = queries.op12_secret_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
