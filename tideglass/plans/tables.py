"""The common tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(col: str) -> F.Column:
    return F.trunc(F.col(col).cast("date"), "MM")


def series_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("sid"), month("o_orderdate").alias("dt")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


def ret_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.simple_return(series_m(spark, sf_dir))


NAMES = {"1-URGENT": "a", "2-HIGH": "b", "3-MEDIUM": "c"}


def _wide(long: DataFrame, value: str) -> DataFrame:
    return long.groupBy("dt").agg(*[F.max(F.when(F.col("sid") == sid, F.col(value))).alias(name) for sid, name in NAMES.items()])


def wide_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(series_m(spark, sf_dir), "v")


def ret_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(ret_m(spark, sf_dir), "r")


def series_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("ts", "event_id")
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("sid"), F.col("ts").cast("date").alias("dt"))
        .agg(
            F.round(F.avg("value"), 8).alias("v"),
            F.max_by("value", place).alias("last_v"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.min_by("value", place).alias("first_v"),
        )
    )


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1 - 1995 * 12).cast("long")
    price = F.col("l_extendedprice")
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linenumber").alias("path"), m.alias("m"))
        .agg(F.round(F.sum(price * (F.col("l_discount") - 0.05)) / F.sum(price), 8).alias("r"), F.round(F.avg("l_tax") - 0.04, 8).alias("g"))
    )


def obs_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vintage y knows orders up to year y; of year y itself, it misses every tenth, so the next one revises it."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("sid"), F.year("o_orderdate").alias("y"), month("o_orderdate").alias("dt"), "o_totalprice")
    years = orders.select(F.col("y").alias("vintage")).distinct()
    # A row belongs to every later year: years are few, so each row is repeated by an array of them instead of a range join.
    last = orders.agg(F.max("y").alias("_last"))
    known = orders.crossJoin(F.broadcast(last)).withColumn("vintage", F.explode(F.sequence("y", "_last"))).drop("_last")
    known = known.join(F.broadcast(years), "vintage").where(~((F.col("y") == F.col("vintage")) & (F.col("o_orderkey") % 10 == 0)))
    return known.groupBy("sid", "vintage", "dt").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
