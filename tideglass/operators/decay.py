"""Exponential decay fitted to a curve in its own units, by built-in array functions for each group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rates searched, points of the grid, where the search ends, its steps at most, and the golden section.
LOW, HIGH, POINTS, TOLERANCE, STEPS, GOLDEN = -1.0, 5.0, 241, 1e-10, 200, 0.6180339887498949


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it on."""
    return F.get(F.transform(F.array(value), then), 0)


def _misfit(rate: Column, points: Column) -> Column:
    """Sum of squares about the best multiple of exp(-rate * lag); ``points`` are (lag, value)."""

    def sums(r: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("ve"), F.lit(0.0).alias("ee"))
        add = lambda s, p: F.struct((s.ve + p.value * F.exp(-r * p.lag)).alias("ve"), (s.ee + F.exp(-2 * r * p.lag)).alias("ee"))
        return F.aggregate(points, zero, add)

    def rest(r: Column, s: Column) -> Column:
        square = lambda x: x * x
        fitted = F.aggregate(points, F.lit(0.0), lambda t, p: t + square(p.value - s.ve / s.ee * F.exp(-r * p.lag)))
        return F.when((s.ee > 0) & (s.ee < float("inf")), fitted).otherwise(F.lit(float("inf")))

    return _let(rate, lambda r: _let(sums(r), lambda s: rest(r, s)))


def decay_rate(points: Column) -> Column:
    """The rate of value = multiple * exp(-rate * lag) of least squared error over an array of (lag, value), both doubles.

    The best of a grid is refined between its neighbours by golden sections; a curve that falls or rises faster than the grid allows gives about its end. Null under two
    points, with a null or non-finite number among them, or if all values are zero.
    """
    step = (HIGH - LOW) / (POINTS - 1)
    at = lambda i: F.lit(LOW) + i * F.lit(step)

    def best(ps: Column) -> Column:
        zero = F.struct(F.lit(float("inf")).alias("f"), F.lit(0).alias("i"))
        tried = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.struct(_misfit(at(i), ps).alias("f"), i.alias("i")))
        return F.aggregate(tried, zero, lambda a, b: F.when(b.f < a.f, b).otherwise(a))["i"]

    def refine(ps: Column, i: Column) -> Column:
        lo, hi = at(F.greatest(i - 1, F.lit(0))), at(F.least(i + 1, F.lit(POINTS - 1)))
        start = _let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda b: F.struct(b.lo.alias("lo"), b.hi.alias("hi"), (b.hi - GOLDEN * (b.hi - b.lo)).alias("c"), (b.lo + GOLDEN * (b.hi - b.lo)).alias("d")))
        start = _let(start, lambda s: F.struct(s.lo.alias("lo"), s.hi.alias("hi"), s.c.alias("c"), s.d.alias("d"), _misfit(s.c, ps).alias("fc"), _misfit(s.d, ps).alias("fd")))

        def move(s: Column, _: Column) -> Column:
            left = s.fc < s.fd

            def narrowed(n: Column) -> Column:
                x = F.when(n.left, n.hi - GOLDEN * (n.hi - n.lo)).otherwise(n.lo + GOLDEN * (n.hi - n.lo))
                one = lambda a, b, name: F.when(n.left, a).otherwise(b).alias(name)
                return _let(
                    F.struct(x.alias("x"), _misfit(x, ps).alias("f")),
                    lambda p: F.struct(n.lo.alias("lo"), n.hi.alias("hi"), one(p.x, s.d, "c"), one(s.c, p.x, "d"), one(p.f, s.fd, "fc"), one(s.fc, p.f, "fd")),
                )

            cut = F.struct(left.alias("left"), F.when(left, s.lo).otherwise(s.c).alias("lo"), F.when(left, s.d).otherwise(s.hi).alias("hi"))
            return F.when(s.hi - s.lo < TOLERANCE, s).otherwise(_let(cut, narrowed))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, move, lambda s: (s.lo + s.hi) / 2)

    finite = F.forall(points, lambda p: F.coalesce((F.abs(p.value) < float("inf")) & (F.abs(p.lag) < float("inf")), F.lit(False)))
    usable = (F.size(points) >= 2) & finite & F.exists(points, lambda p: p.value != 0)
    return F.when(usable, _let(points, lambda ps: _let(best(ps), lambda i: refine(ps, i))))


def decay_rates(df: DataFrame, by: Sequence[str], lag: str = "lag", value: str = "acf") -> DataFrame:
    """``(by, n, rate)`` of each group's curve; a group's curve is one array, so this is for curves of some dozens of lags."""
    points = F.array_sort(F.collect_list(F.struct(F.col(lag).cast("double").alias("lag"), F.col(value).cast("double").alias("value"))))
    return df.groupBy(*by).agg(points.alias("_p")).select(*by, F.size("_p").alias("n"), decay_rate(F.col("_p")).alias("rate"))
