"""Delivered tables in the shape in which they are checked and stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class IntakeError(ValueError):
    """A delivery that isn't what was agreed."""


def _refuse_missing(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise IntakeError(f"no column {', '.join(missing)}")


def monthly_drop(vendor: DataFrame, date: str = "date", percent: str = "total_return_pct") -> DataFrame:
    """``(period, ret)`` from dated percents: rows without a percent carry nothing and go. No rows left, or a month twice, is refused."""
    _refuse_missing(vendor, [date, percent])
    rows = vendor.where(F.col(percent).isNotNull()).select(F.date_format(F.col(date).cast("date"), "yyyy-MM").alias("period"), (F.col(percent).cast("double") / 100).alias("ret"))
    found = rows.groupBy("period").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("months"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("period")))).alias("twice")).first()
    if not found.months:
        raise IntakeError("no observations")
    if found.twice:
        raise IntakeError(f"months delivered twice: {', '.join(found.twice)}")
    return rows


def indexed_drop(payload: DataFrame, names: Mapping[str, str], since: Mapping[str, str], ident: str = "indexId", data: str = "indexData", quarter: str = "QUARTER", value: str = "TWR", period: Column | None = None) -> DataFrame:
    """``(period, strategy, ret)`` of rows ``(ident, array of (quarter, value))``: each quarter of each index that has a value and isn't before the index's first good one.

    ``period`` makes ``YYYYQn`` of ``_quarter`` (as it is by default); such texts compare in order of time. An index that wasn't asked for, an observation without a quarter, and a delivery without
    observations are refused.
    """
    _refuse_missing(payload, [ident, data])
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = payload.select(F.col(ident).cast("string").alias("_id"), F.explode_outer(data).alias("e")).select("_id", F.try_element_at(known, F.col("_id")).alias("strategy"), F.col("e").isNotNull().alias("_some"), F.col(f"e.{quarter}").alias("_quarter"), F.col(f"e.{value}").cast("double").alias("ret"))
    faults = rows.agg(F.array_sort(F.collect_set(F.when(F.col("strategy").isNull(), F.coalesce("_id", F.lit("null"))))).alias("odd"), F.count_if(F.col("_some") & F.col("_quarter").isNull()).alias("undated"), F.count("ret").alias("n")).first()
    if faults.odd:
        raise IntakeError(f"indexes that weren't asked for: {', '.join(faults.odd)}")
    if faults.undated:
        raise IntakeError(f"{faults.undated} observations without a quarter")
    if not faults.n:
        raise IntakeError("no observations")
    first = F.try_element_at(F.create_map(*[F.lit(x) for pair in since.items() for x in pair]), F.col("strategy")) if since else F.lit(None).cast("string")
    dated = rows.withColumn("period", period if period is not None else F.col("_quarter").cast("string"))
    return dated.where(F.col("ret").isNotNull() & (F.col("period") >= F.coalesce(first, F.lit("")))).select("period", "strategy", "ret")


def period_start(period: Column) -> Column:
    """The first day of ``YYYYQn``, ``YYYY-Qn``, ``YYYY-MM`` or ``YYYY``; null for other text."""
    year, q, m = (F.regexp_extract(period, p, 1).try_cast("int") for p in (r"^(\d{4})", r"^\d{4}-?Q([1-4])$", r"^\d{4}-(0[1-9]|1[0-2])$"))
    whole = F.when(period.rlike(r"^\d{4}$"), 1)
    return F.make_date(year, F.coalesce((q - 1) * 3 + 1, m, whole), F.lit(1))


def series_frames(drop: DataFrame, source: str, group: str | None = None, period: str = "period", value: str = "ret") -> DataFrame:
    """``(series_id, date, value)`` of a checked table of returns: one series for each group, named ``source.group``, or one named ``source``.

    Rows with an unreadable period, or without a value, are left out; without a period or value column there are none.
    """
    spark = drop.sparkSession
    if period not in drop.columns or value not in drop.columns:
        return spark.createDataFrame([], "series_id string, date date, value double")
    name = F.concat(F.lit(f"{source}."), F.col(group).cast("string")) if group and group in drop.columns else F.lit(source)
    rows = drop.select(name.alias("series_id"), period_start(F.col(period).cast("string")).alias("date"), F.col(value).try_cast("double").alias("value"))
    return rows.where("series_id IS NOT NULL AND date IS NOT NULL AND value IS NOT NULL")
