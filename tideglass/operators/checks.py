"""Quality rules over long series and intake files: one pass of windows and aggregates, findings as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import jumps, over


def month_ordinal(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def series_findings(df: DataFrame, low: float | None = None, high: float | None = None, positive: bool = False, jump_k: float = 6.0, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """``(sid, rule, n, passed)`` for duplicate dates, irregular months, bounds, positive values and jumps.

    Windows share one partitioning by series, the counts one aggregate, and rules become rows by an array.
    """
    step = month_ordinal(F.col(order)) - F.lag(month_ordinal(F.col(order))).over(over(by, order))
    marked = jumps(df.withColumn("_step", step), jump_k, by=by, order=order, value=value)
    v = F.col(value)
    rules = {"no_duplicates": F.col("_step") == 0, "frequency": F.col("_step") > 1, "missing": v.isNull(), "jump": F.col("jump")}
    if low is not None:
        rules["bounds_low"] = v < low
    if high is not None:
        rules["bounds_high"] = v > high
    if positive:
        rules["positive"] = v <= 0
    counts = marked.groupBy(by).agg(*[F.count(F.when(c, 1)).alias(name) for name, c in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])).alias("e")
    return counts.select(by, each).select(by, "e.rule", "e.n", (F.col("e.n") == 0).alias("passed"))


def staleness(df: DataFrame, as_of: str, sla_days: int, by: str = "sid", order: str = "dt") -> DataFrame:
    """Days from the end of the last row's month; ``label_age`` counts from its label instead."""
    last = df.groupBy(by).agg(F.max(order).alias("last"))
    age = F.datediff(F.lit(as_of).cast("date"), F.last_day("last"))
    return last.select(by, "last", age.alias("age"), F.datediff(F.lit(as_of).cast("date"), F.col("last")).alias("label_age"), (age <= sla_days).alias("fresh"))


def cross_identity(a: DataFrame, b: DataFrame, order: str = "dt", value: str = "v", tolerance: float = 1e-9) -> DataFrame:
    """Common dates on which ``a`` falls below ``b``."""
    both = a.select(order, F.col(value).alias("a")).join(b.select(order, F.col(value).alias("b")), order)
    return both.where(F.col("a") < F.col("b") - tolerance)


def intake_violations(df: DataFrame, columns: Sequence[tuple[str, float | None, float | None]]) -> DataFrame:
    """``(kind, column, n)`` of an intake file read as text: values that aren't numbers, and those out of bounds."""
    tests = []
    for name, low, high in columns:
        number = F.expr(f"try_cast({name} AS double)")
        tests.append((F.lit("non_numeric"), name, F.col(name).isNotNull() & number.isNull()))
        bad = F.lit(False)
        if low is not None:
            bad = bad | (number < low)
        if high is not None:
            bad = bad | (number > high)
        tests.append((F.lit("out_of_bounds"), name, bad))
    one = df.agg(*[F.count(F.when(c, 1)).alias(f"_{i}") for i, (_, _, c) in enumerate(tests)])
    each = F.explode(F.array(*[F.struct(k.alias("kind"), F.lit(name).alias("column"), F.col(f"_{i}").alias("n")) for i, (k, name, _) in enumerate(tests)])).alias("e")
    return one.select(each).select("e.*").where("n > 0")


def period_violations(df: DataFrame, by: str, ordinal: Column) -> DataFrame:
    """Repeated periods and silent gaps of each group."""
    distinct = df.groupBy(by, ordinal.alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    step = F.col("_o") - F.lag("_o").over(over(by, "_o"))
    return distinct.withColumn("_s", step).groupBy(by).agg(F.count(F.when(F.col("_n") > 1, 1)).alias("duplicates"), F.count(F.when(F.col("_s") > 1, 1)).alias("gaps"))


def tiling_faults(segments: DataFrame, by: str, start: str, end: str, horizon: int) -> DataFrame:
    """Groups whose closed integer segments don't tile ``0 .. horizon - 1``: each begins one past the last, first at 0, last at the end."""
    prev = F.lag(end).over(over(by, start))
    bad = F.when(F.coalesce(prev, F.lit(-1)) + 1 != F.col(start), 1)
    return segments.withColumn("_bad", bad).groupBy(by).agg(F.count("_bad").alias("breaks"), F.max(end).alias("last")).where((F.col("breaks") > 0) | (F.col("last") != horizon - 1))
