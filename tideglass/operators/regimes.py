"""Regime labels and what is counted of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(c: Column) -> Column:
    """NaN as null, so that no comparison with it holds (Spark puts NaN above every number)."""
    return F.nanvl(c.cast("double"), F.lit(None))


def label(dd: Column, change: Column, crisis: float, deep: float, hot: float) -> Column:
    """The first that holds of: crisis, recession, reflation, slowdown, expansion; a missing feature holds for none."""
    dd, change = _known(dd), _known(change)
    return F.when((dd <= crisis) & (change < 0), "CRI").when(change < deep, "REC").when(change > hot, "REF").when(change < 0, "SLOW").otherwise("EXP")


def seven(recession: Column, inflation: Column, growth: Column, dd: Column, spread: Column, hot: float = 4.0, weak: float = 0.0, slow: float = 1.5, crisis: float = -0.2, wide: float = 8.0) -> Column:
    """Crisis, recession, stagflation, reflation, recession by growth, slowdown or expansion: the first that holds.

    A missing feature holds for none of its tests.
    """
    recession, inflation, growth, dd, spread = map(_known, (recession, inflation, growth, dd, spread))
    return (
        F.when((recession >= 0.5) & (F.coalesce(dd <= crisis, F.lit(False)) | F.coalesce(spread >= wide, F.lit(False))), "CRI")
        .when(recession >= 0.5, "REC")
        .when((inflation >= hot) & (growth <= weak), "STAG")
        .when((inflation >= hot) & (growth > slow), "REF")
        .when(growth <= weak, "REC")
        .when(growth < slow, "SLOW")
        .otherwise("EXP")
    )


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    return df.groupBy(predicted.alias("predicted"), actual.alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def total_variation(df: DataFrame, label_col: str, side: Column) -> DataFrame:
    """Half the sum of absolute differences between the label shares of rows where ``side`` holds and the others."""
    n = df.groupBy(label_col).agg(F.sum(F.when(side, 1).otherwise(0)).alias("x"), F.sum(F.when(side, 0).otherwise(1)).alias("y"))
    total = n.agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"))
    return n.crossJoin(F.broadcast(total)).agg((F.sum(F.abs(F.try_divide("x", "tx") - F.try_divide("y", "ty"))) / 2).alias("tv"))
