import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.operators import neighbours


def vectors(kind, n, dims=8):
    v = np.random.default_rng(3).standard_normal((n, dims))
    if kind == "copies":  # one vector is there very often, and every query beside it ties with all of its copies
        v[np.arange(n) % 7 > 1] = 0.25
    return v


@pytest.fixture
def workers(spark, monkeypatch):
    """What ``nearest`` gives to the workers, a function for each block of queries."""

    def of(queries):
        taken, frame = [], type(queries)
        real = frame.mapInPandas
        monkeypatch.setattr(frame, "mapInPandas", lambda self, f, schema: taken.append(f) or real(self, f, schema))
        neighbours.nearest(queries, queries, "k", "v")
        return taken

    return of


def table(spark, v, keys):
    return spark.createDataFrame([(int(k), v[k].tolist()) for k in keys], "k long, v array<double>")


@pytest.mark.parametrize("kind", ["all different", "copies"])
def test_memory_of_a_worker_is_bounded(spark, workers, kind):
    v = vectors(kind, 10_000)
    (least,) = workers(table(spark, v, np.arange(0, 10_000, 5)))
    batch = pd.DataFrame({"k": np.arange(10_000), "v": list(v)})
    tracemalloc.start()
    got = pd.concat(least(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    for k, distance in got.iloc[::211].itertuples(index=False):
        assert distance == pytest.approx(np.delete(np.sqrt(((v - v[k]) ** 2).sum(1)), k).min(), rel=1e-12)


@pytest.mark.parametrize("cells", [1, 12, 40, 1 << 18])
@pytest.mark.parametrize("kind", ["all different", "copies"])
def test_distances_whatever_the_tiles(spark, workers, monkeypatch, cells, kind):
    monkeypatch.setattr(neighbours, "CELLS", cells)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    v = vectors(kind, 60, 4)
    v[33, 2] = np.nan  # is nobody's neighbour, and hides no other
    batches = [pd.DataFrame({"k": np.arange(i, 60, 3), "v": list(v[i::3])}) for i in range(3)]
    got = pd.concat([part for least in workers(table(spark, v, np.arange(1, 60, 3))) for part in least(iter(batches))])
    each = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2)) + np.diag(np.full(60, np.inf))
    assert dict(got.itertuples(index=False)) == pytest.approx({k: np.nanmin(each[k]) for k in range(1, 60, 3)}, rel=1e-12)


def test_a_vector_that_is_not_finite_hides_no_other(spark):
    v = np.arange(12.0).reshape(6, 2)
    v[4] = np.nan, 1
    df = table(spark, v, np.arange(6)).coalesce(1)
    got = dict(map(tuple, neighbours.nearest(df.where(F.col("k") < 3), df, "k", "v").collect()))
    assert got == pytest.approx({0: 8**0.5, 1: 8**0.5, 2: 8**0.5})
