"""Recurrences over long series."""

import time

import pytest
from pyspark.sql import functions as F

from tideglass.operators import portfolio, transforms


def test_a_million_rows_stream_by(spark):
    df = spark.range(1_000_000).select(F.lit("s").alias("sid"), F.col("id").alias("dt"), F.sin(F.col("id").cast("double")).alias("r"))
    began = time.time()
    last = transforms.recover_truth(df, [0.7, 0.2, 0.1]).agg(F.count(F.lit(1)).alias("n"), F.max_by("truth", "dt").alias("last"), F.min("truth").alias("low")).first()
    var = portfolio.ewma_variance(df, ["sid"], "dt", "r", 0.94).agg(F.max("var").alias("v"), F.count("var").alias("n")).first()
    assert last.n == var.n == 1_000_000 and abs(last.last) < 10 and abs(last.low) < 10 and 0.4 < var.v < 1 and time.time() - began < 60


def test_states_restart_with_each_key_and_nulls_are_zero(spark):
    rows = [(None, 1, 2, 1.0), (None, 1, 1, None), ("a", 1, 1, 0.5), ("a", 2, 1, 2.0), ("a", 2, 2, 0.1)]
    df = spark.createDataFrame(rows, "k string, j int, t int, asked double").withColumn("nav", F.lit("x")).repartition(3)
    got = {(r.k, r.j, r.t): (r.paid, r.pending, r.nav) for r in portfolio.gated_redemptions(df, ["k", "j"], "t", "asked", 10.0, 0.1).collect()}
    assert got[None, 1, 1] == (0, 0, 10) and got[None, 1, 2] == (1, 0, 9) and got["a", 1, 1] == (0.5, 0, 9.5)
    assert got["a", 2, 1] == (1, 1, 9) and got["a", 2, 2] == pytest.approx((0.9, 0.2, 8.1))
    assert portfolio.gated_redemptions(df.limit(0), ["k"], "t", "asked", 1.0, 0.1).collect() == []
