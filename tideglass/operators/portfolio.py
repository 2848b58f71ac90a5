"""Cash-flow recurrences: each vehicle's periods stream by in order, and only its state is held."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import streamed


def closed_end(df: DataFrame, by: Sequence[str], order: str, ret: str, committed: float, rc: Sequence[float], life: float, bow: float, rate: float, per: float = 0.25) -> DataFrame:
    """A closed-end fund's calls, distributions and values under true returns; a period without a return has none.

    Calls take the age's share of what is unfunded; distributions follow ``rate * (age / life) ** bow``; from
    ``life`` on nothing is called and all that is left is paid out.
    """

    def step(state: tuple, r: float) -> tuple:
        age, unfunded, nav = state
        over = age >= life
        call = 0.0 if over else min(unfunded, min(1.0, rc[min(int(age), len(rc) - 1)] * per) * unfunded)
        grown = max(0.0, nav * (1 + r))
        dist = (1.0 if over else min(1.0, rate * min(1.0, age / life) ** bow * per)) * grown
        unfunded, nav = 0.0 if over else unfunded - call, grown + call - dist
        return (age + per, unfunded, nav), (call, dist, nav, unfunded)

    return streamed(df, by, order, [ret], lambda: (0.0, float(committed), 0.0), step, ["call", "dist", "nav", "unfunded"])


def waterfall(df: DataFrame, by: Sequence[str], order: str, flows: tuple[str, str, str], cash: float, liquid: float, private: float, haircut: float) -> DataFrame:
    """Cash after income, calls and spending; a shortfall sells liquid assets first, then private ones at a haircut. Null flows are zero."""

    def step(state: tuple, income: float, calls: float, spending: float) -> tuple:
        held, soft, hard = state
        left = held + income - calls - spending
        short = max(0.0, -left)
        sold = min(short, soft)
        nav = min(hard, (short - sold) / (1 - haircut))
        state = left + sold + nav * (1 - haircut), soft - sold, hard - nav
        return state, (*state, sold, nav * (1 - haircut))

    return streamed(df, by, order, list(flows), lambda: (float(cash), float(liquid), float(private)), step, ["cash", "liquid", "private", "sold", "forced"])


def gated_redemptions(df: DataFrame, by: Sequence[str], order: str, asked: str, nav: float, gate: float) -> DataFrame:
    """A queue of redemptions of which each period pays at most ``gate`` of the fund's value; the rest waits. Null asks are zero."""

    def step(state: tuple, more: float) -> tuple:
        waiting = state[0] + more
        paid = min(waiting, gate * state[1])
        state = waiting - paid, state[1] - paid
        return state, (paid, *state)

    return streamed(df, by, order, [asked], lambda: (0.0, float(nav)), step, ["paid", "pending", "nav"])


def present_value(amount: Column, rate: Column, years: int) -> Column:
    """Of a level payment for ``years``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda a, i: a + amount / F.pow(1 + rate, i))


def duration(rate: Column, years: int) -> Column:
    """Macaulay's, of a level payment."""
    top = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda a, i: a + i / F.pow(1 + rate, i))
    return top / present_value(F.lit(1.0), rate, years)


def ewma_variance(df: DataFrame, by: Sequence[str], order: str, value: str, weight: float) -> DataFrame:
    """``weight * previous + (1 - weight) * x squared``, from the first square; a null counts as zero."""

    def step(var: float | None, x: float) -> tuple:
        var = x * x if var is None else weight * var + (1 - weight) * x * x
        return var, (var,)

    return streamed(df, by, order, [value], lambda: None, step, ["var"])


def bond_return(level: Column, by: str, order: str, years: float) -> Column:
    """Carry of the row before plus the fall in yield times duration; the first row carries its own yield."""
    prev = F.lag(level).over(Window.partitionBy(by).orderBy(order))
    return F.coalesce(prev / 12 + years * (prev - level), level / 12)
