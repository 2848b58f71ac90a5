import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tideglass.operators import texts as tx


def frequent(texts, k, n):
    counts = Counter(" ".join(ws[i : i + n]) for ws in (t.split() for t in texts if t) for i in range(len(ws) - n + 1))
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]


def texts(kind):
    rng = random.Random(5)
    if kind == "skewed":
        return [" ".join(chr(97 + min(int(rng.expovariate(0.3)), 25)) * 2 for _ in range(30)) for _ in range(200)]
    if kind == "once":  # every term is there once: ties only
        return [" ".join(f"{chr(97 + i)}{chr(97 + j)}{chr(97 + m)}" for m in range(10)) for i in range(10) for j in range(10)]
    return [None, "", "one", "12 !"] if kind == "few" else []


@pytest.mark.parametrize("kind", ["skewed", "once", "few", "none"])
@pytest.mark.parametrize("n", [1, 2])
@pytest.mark.parametrize("buckets", [1 << 16, 64])
def test_top_terms_whatever_the_buckets(spark, monkeypatch, kind, n, buckets):
    monkeypatch.setattr(tx, "BUCKETS", buckets)
    monkeypatch.setattr(tx, "TURN", 16)
    all_texts = texts(kind)
    df = spark.createDataFrame([(t,) for t in all_texts], "text string").repartition(3)
    if buckets > 64 and kind == "once":
        monkeypatch.setattr(tx, "TURN", 1024)
    got = tx.top_terms(df, "text", 5, n)
    assert got.dtypes == [("term", "string"), ("n", "bigint")]
    assert [tuple(r) for r in got.collect()] == frequent([t for t in all_texts if t and t[0] != "1"], 5, n)


def test_memory_of_a_task_does_not_grow_with_the_number_of_terms(spark):
    """Twelve frequent bigrams among ever more that are there once."""
    sc = spark.sparkContext

    def most(n):
        rare = F.translate(F.concat(F.lit("x"), F.col("id").cast("string")), "0123456789", "abcdefghij")
        words = [F.concat_ws(" ", rare, F.concat(rare, F.lit("z"))), *[F.lit(f"often {chr(97 + i)}") for i in range(12)]]
        df = spark.range(0, n, 1, 2).select(F.when(F.col("id") % 5 > 0, words[0]).otherwise(F.concat_ws(" ", *words)).alias("text"))
        sc.setJobGroup(f"terms {n}", "")
        assert [r.n for r in tx.top_terms(df, "text", 12, 2).collect()][:12] == [n // 5] * 12
        sc.setLocalProperty("spark.jobGroup.id", None)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"terms {n}")]
        stages = [sc._jsc.sc().statusStore().lastStageAttempt(s) for j in jobs for s in j.stageIds]
        return max(s.peakExecutionMemory() / max(1, s.numCompleteTasks()) for s in stages) / 1e6

    assert most(1_200_000) < 1.5 * most(150_000)
