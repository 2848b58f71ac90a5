"""Whitening against plain numpy and whole numbers of Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import queries, whiten

SCHEMA = "vec_id long, embedding array<float>, n int"


def plain(vectors, k):
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(size)]
    centred = [[n * r[d] - s[d] for d in range(size)] for r in x]
    v = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(size)] for i in range(size)])
    values, vectors_ = np.linalg.eigh(v)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    return [sum(c * c for c in r) for r in centred], np.array(centred, dtype=float) / n @ vectors_ / np.sqrt(values), values / np.trace(v)


def check(got, vectors, k):
    deviation, w, explained = plain(vectors, k)
    assert len(got) == len(vectors) * k and set(got.n) == {len(vectors)}
    got = got.sort_values(["component", "vec_id"])
    for c in range(k):
        rows = got[got.component == c + 1]
        assert [int(v) for v in rows.deviation_exact] == deviation
        a, b = rows.whitened.to_numpy(), w[:, c]
        assert np.allclose(a, b, atol=1e-9) or np.allclose(a, -b, atol=1e-9)
        assert np.allclose(rows.explained, explained[c], rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-7  # a row far out costs digits


@pytest.mark.parametrize("size,n", [(12, 700), (3, 65), (9, 64)])
def test_against_numpy(spark, size, n):
    rng = np.random.default_rng(size)
    vectors = (rng.standard_normal((n, size)) * rng.uniform(0.01, 3, size)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 7) for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    got = whiten.whiten_embeddings(df).toPandas()
    check(got, vectors, min(8, size))
    assert [int(a) for a in got.deviation] == [int(a) for a in got.deviation_exact]


def test_scatter_is_exact_at_any_width():
    rng = np.random.default_rng(1)
    for top in (2, 1 << 10, 1 << 40, 1 << 61):
        x = rng.integers(-top, top, (130, 5))
        s, p = whiten.scatter(x)
        rows = [[int(v) for v in r] for r in x]
        assert [int(v) for v in s] == [sum(r[d] for r in rows) for d in range(5)]
        assert all(p[i, j] == sum(r[i] * r[j] for r in rows) for i in range(5) for j in range(i, 5))


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    good = [[float(np.float32(c)) for c in v] for v in rng.uniform(-1, 1, (40, 4))] + [[0.0] * 4, [0.0] * 4, [1e4, -1e4, 0.5, -0.0]]
    bad = [None, [], [1.0], [1.0, None, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0] * 5]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(1000 + i, v, 1) for i, v in enumerate(bad)]
    got = whiten.whiten_embeddings(spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("x")).repartition(5)).toPandas()
    check(got, good, 4)
    repeated = whiten.whiten_embeddings(spark.createDataFrame([(None, v, 1) for v in good * 2], SCHEMA)).toPandas()
    assert len(repeated) == 8 * len(good) and repeated.vec_id.isna().all() and set(repeated.n) == {2 * len(good)}


def test_nothing_varies_and_nothing_there(spark):
    one = whiten.whiten_embeddings(spark.createDataFrame([(1, [0.5, 0.25], 1)] * 3, SCHEMA)).toPandas()
    assert len(one) == 6 and (one.whitened == 0).all() and (one.explained == 0).all() and (one.deviation == 0).all() and (one.identity_error == 0).all()
    none = whiten.whiten_embeddings(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert none.count() == 0 and none.columns == one.columns.tolist()
    huge = whiten.whiten_embeddings(spark.createDataFrame([(i, [float(i) * 1e12, 1.0], 1) for i in range(3)], SCHEMA)).toPandas()
    assert huge.deviation.isna().any() and len(huge) == 6


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    vectors = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], dtype=np.float32)
    check(queries.op13_embedding_whitening(spark, sf).toPandas(), vectors, 8)
