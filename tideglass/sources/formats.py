"""Readers of the vendors' file formats, as expressions over text or JSON: nothing is parsed on the driver."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def json_observations(raw: DataFrame, text: str = "value") -> DataFrame:
    """``(date, value)`` of documents ``{"observations": [{"date", "value"}]}``; a dot or nothing is a missing value."""
    o = F.from_json(text, "observations array<struct<date:string,value:string>>")["observations"]
    e = raw.select(F.explode(o).alias("e"))
    return e.select(F.to_date("e.date").alias("date"), F.when(~F.trim("e.value").isin(".", ""), F.expr("try_cast(e.value AS double)")).alias("value"))


def factor_table(spark: SparkSession, path: str) -> DataFrame:
    """Monthly or daily percent factors of a text file with a preamble, one header and a second, yearly block.

    The header is the line that begins with a comma; rows are dated ``YYYYMM`` or ``YYYYMMDD``, up to the first
    line after them that isn't. Files are small and read whole, one a row, so line order is kept. Columns
    come as a map of names to fractions.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    dated = F.regexp_extract("line", r"^\s*(\d{6}(?:\d{2})?)\s*,", 1)
    w = Window.partitionBy("file").orderBy("i")
    rows = files.withColumn("period", dated).withColumn("header", F.last(F.when(F.col("line").rlike(r"^\s*,"), F.col("line")), ignorenulls=True).over(w))
    rows = rows.where("header IS NOT NULL").withColumn("break", F.sum(F.when((F.col("period") == "") & ~F.col("line").rlike(r"^\s*,"), 1).otherwise(0)).over(w))
    first = rows.where("period <> '' AND break = 0")
    names = F.transform(F.slice(F.split("header", ","), 2, 100), F.trim)
    values = F.transform(F.slice(F.split("line", ","), 2, 100), lambda x: F.trim(x).try_cast("double") / 100)
    date = F.when(F.length("period") == 6, F.to_date(F.concat("period", F.lit("01")), "yyyyMMdd")).otherwise(F.to_date("period", "yyyyMMdd"))
    return first.select("file", date.alias("date"), F.map_from_arrays(names, values).alias("factors"))


def quarter_start(period: Column) -> Column:
    """The first day of ``YYYY-Qn`` or ``YYYYQn``."""
    year, q = F.regexp_extract(period, r"^(\d{4})-?Q([1-4])$", 1), F.regexp_extract(period, r"^(\d{4})-?Q([1-4])$", 2)
    return F.when(year != "", F.make_date(year.try_cast("int"), (q.try_cast("int") - 1) * 3 + 1, F.lit(1)))


def decimal_month(c: Column) -> Column:
    """``YYYY.MM`` written as a decimal number (so October is .1): the first of that month."""
    month = F.least(F.lit(12), F.greatest(F.lit(1), F.round((c - F.floor(c)) * 100).cast("int")))
    return F.make_date(F.floor(c).cast("int"), month, F.lit(1))


def wide_quarters(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of a wide table whose key columns start with given codes, as ``(date, value, ...keys)``: one row a quarter column."""
    plain = df.toDF(*[c.split(":")[0] for c in df.columns])
    for name, start in keys.items():
        plain = plain.where(F.col(name).startswith(start))
    quarters = [c for c in plain.columns if c[:4].isdigit() and "Q" in c]
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"`{q}`").try_cast("double").alias("value")) for q in quarters])).alias("e")
    return plain.select(*keys, each).select(*keys, quarter_start(F.col("e.q")).alias("date"), "e.value").where("value IS NOT NULL")


def intake_name(c: Column) -> list[Column]:
    """Group and as-of part of ``<group>_<as of>.<ext>``."""
    pattern = r"^(.+)_([^_.]+)\.(csv|xlsx)$"
    return [F.regexp_extract(c, pattern, 1).alias("group"), F.regexp_extract(c, pattern, 2).alias("as_of")]


def daily_to_monthly(df: DataFrame, last: Column, by: str = "series_id", date: str = "date", value: str = "value") -> DataFrame:
    """One row a month: the last known value where ``last`` holds for the series, else the mean."""
    known = df.where(F.col(value).isNotNull())
    one = known.groupBy(by, F.trunc(date, "MM").alias(date)).agg(F.avg(value).alias("_mean"), F.max_by(value, date).alias("_last"))
    return one.select(by, date, F.when(last, F.col("_last")).otherwise(F.col("_mean")).alias(value))


def csv_directory(spark: SparkSession, path: str) -> DataFrame:
    """``(series_id, date, value)`` of the files ``<series>.csv`` with columns ``date, value`` under a folder; text that is no number is missing."""
    raw = spark.read.schema("date string, value string").csv(f"{path}/*.csv", header=True, enforceSchema=False)
    name = F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    return raw.select(name.alias("series_id"), F.col("date").try_cast("date").alias("date"), F.col("value").try_cast("double").alias("value"))


def stata_panel(spark: SparkSession, path: str, country: str, variable: str) -> DataFrame:
    """``(date, value)`` of one country's yearly ``variable`` from Stata files with ``iso`` or ``country`` and ``year``; years without a value go.

    A file is one row and is read whole by one task; the format can't be read in parts.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                frame = pd.read_stata(io.BytesIO(content))
                key = "iso" if "iso" in frame.columns else "country"
                missing = {key, "year", variable} - set(frame.columns)
                if missing:
                    raise ValueError(f"no columns {sorted(missing)} in a Stata file")
                own = frame[frame[key] == country].dropna(subset=[variable])
                yield pd.DataFrame({"year": own["year"].astype(int), "value": own[variable].astype(float)})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, "year int, value double").select(F.make_date("year", F.lit(1), F.lit(1)).alias("date"), "value")


def csv_with_notice(df: DataFrame, path: str, notice: str) -> None:
    """CSV files that each begin with ``notice`` as a comment, then a header; readers take ``comment="#"``."""
    columns = df.columns

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["".join(f"# {line}\n" for line in notice.splitlines()) + pd.DataFrame(columns=columns).to_csv(index=False).rstrip("\n")]})
        yield from batches

    lines = df.select(F.to_csv(F.struct("*")).alias("value"))
    lines.mapInPandas(headed, "value string").write.mode("errorifexists").text(path)


def json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines: range partitions keep the order over files."""
    df.orderBy(*order).write.mode("errorifexists").json(path)
