"""Joins and alignment of series, vintages and as-of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def combine(a: DataFrame, b: DataFrame, how: Column, on: str | Sequence[str] = "dt", value: str = "v") -> DataFrame:
    """``how`` of columns ``a`` and ``b`` on common keys."""
    on = [on] if isinstance(on, str) else list(on)
    both = a.select(*on, F.col(value).alias("a")).join(b.select(*on, F.col(value).alias("b")), on)
    return both.select(*on, how.alias(value))


def month_panel(df: DataFrame, by: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """Every month from the first to the last of any series, for every series from its own first month on; ``gap`` marks what is missing."""
    ends = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    own = df.groupBy(by).agg(F.min(order).alias("_first"))
    spine = own.crossJoin(F.broadcast(ends)).select(by, F.explode(F.sequence("_first", "_hi", F.expr("interval 1 month"))).alias(order))
    return spine.join(df.select(by, order, value), [by, order], "left").withColumn("gap", F.col(value).isNull())


def as_of(asks: DataFrame, facts: DataFrame, by: Sequence[str], at: str, valid_from: str, take: Sequence[str]) -> DataFrame:
    """For each ask, the latest fact of its keys that was valid by then; asks without one keep nulls.

    Both sides are put in one order by key and time and the last fact carried forward: one shuffle and one
    sort, however many facts a key has. A range join would pair them first. Facts win ties in time.
    """
    marker = F.struct(*[F.col(c) for c in take])
    right = facts.select(*by, F.col(valid_from).alias("_t"), F.lit(0).alias("_o"), marker.alias("_f"), F.lit(None).cast(asks.select(F.struct("*")).schema[0].dataType).alias("_a"))
    left = asks.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(right.schema["_f"].dataType).alias("_f"), F.struct("*").alias("_a"))
    w = Window.partitionBy(*by).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = right.unionByName(left).withColumn("_l", F.last("_f", ignorenulls=True).over(w))
    return both.where("_o = 1").select("_a.*", *[F.col(f"_l.{c}").alias(c) for c in take])


def latest_by(df: DataFrame, by: Sequence[str], order: Column | str, take: Sequence[str]) -> DataFrame:
    """The row of the greatest ``order`` in each group, without a sort."""
    one = df.groupBy(*by).agg(F.max_by(F.struct(*take), order).alias("_e"))
    return one.select(*by, "_e.*")


def vintage_diff(a: DataFrame, b: DataFrame, by: str = "sid") -> DataFrame:
    """What became of each series between two vintages of ``(by, n)``: added, removed, grew, shrank, same."""
    both = a.select(by, F.col("n").alias("n_a")).join(b.select(by, F.col("n").alias("n_b")), by, "full_outer")
    status = F.when(F.col("n_a").isNull(), "added").when(F.col("n_b").isNull(), "removed").when(F.col("n_b") > F.col("n_a"), "grew").when(F.col("n_b") < F.col("n_a"), "shrank").otherwise("same")
    return both.select(by, "n_a", "n_b", status.alias("status"))


def revisions(current: DataFrame, prior: DataFrame, by: Sequence[str] = ("sid", "dt"), value: str = "v", tolerance: float = 1e-9) -> DataFrame:
    """Common rows whose value moved by more than ``tolerance``."""
    both = current.select(*by, F.col(value).alias("now")).join(prior.select(*by, F.col(value).alias("before")), list(by))
    return both.where(F.abs(F.col("now") - F.col("before")) > tolerance)


def within_tolerance(rows: DataFrame, near: DataFrame, tolerance: dict[str, float], key: str, other: str) -> DataFrame:
    """Pairs of a row and a candidate whose every named column differs by no more than its tolerance.

    The first two columns are cut into cells a little wider than their tolerances, so that rounding parts no pair, and a
    candidate is put in its own and all neighbouring cells: the pairs come from an equi-join on cells rather
    than from all pairs, and a value that many rows share is split by the second column.
    """
    cells = [(c, f"_cell{i}", t * (1 + 1e-6)) for i, (c, t) in enumerate([*tolerance.items()][:2])]
    left = rows.select(F.col(key), *tolerance, *[F.floor(F.col(c) / w).alias(name) for c, name, w in cells])
    right = near.select(F.col(key).alias(other), *[F.col(c).alias(f"_{c}") for c in tolerance])
    for c, name, w in cells:
        cell = F.floor(F.col(f"_{c}") / w)
        right = right.withColumn(name, F.explode(F.array(cell - 1, cell, cell + 1)))
    both = left.join(right, [name for _, name, _ in cells])
    for c, t in tolerance.items():
        both = both.where(F.abs(F.col(c) - F.col(f"_{c}")) <= t)
    return both.select(key, other)


def unmapped(df: DataFrame, mapping: DataFrame, on: str) -> DataFrame:
    """Distinct values that the mapping lacks, with the number of rows that have them."""
    return df.join(mapping.select(on), on, "left_anti").groupBy(on).agg(F.count(F.lit(1)).alias("n"))


def first_of(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_i") <= k).drop("_i")


def overlapping(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pairs of half-open intervals ``[lo, hi)`` of one key that meet. Ends are numbers, dates or timestamps; intervals with a null end meet nothing.

    A key's time is cut into cells of its intervals' mean length, so intervals lie in about two cells each on average, however long some are. Pairs come
    from an equi-join on cells, and each from one of them only: that of the later start.
    """
    on = list(on)
    sides = []
    for name, df in (("a", a), ("b", b)):
        rows = df.where("lo IS NOT NULL AND hi IS NOT NULL").select(*on, F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))
        sides.append(rows.withColumns({f"_{name}{k}": _number(rows, f"{name}_{k}") for k in ("lo", "hi")}))
    lengths = sides[0].select(*on, F.abs(F.col("_ahi") - F.col("_alo")).alias("_l")).unionByName(sides[1].select(*on, F.abs(F.col("_bhi") - F.col("_blo")).alias("_l")))
    widths = lengths.groupBy(*on).agg(F.avg("_l").alias("_w")).withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0))
    cell = lambda c: F.floor(c / F.col("_w"))
    left, right = (
        rows.join(widths, on).withColumn("_cell", F.explode(F.sequence(cell(F.least(f"_{n}lo", f"_{n}hi")), cell(F.greatest(f"_{n}lo", f"_{n}hi"))))) for n, rows in zip("ab", sides, strict=True)
    )
    both = left.join(right.drop("_w"), [*on, "_cell"]).where((F.col("a_lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("a_hi")))
    return both.where(F.col("_cell") == cell(F.greatest("_alo", "_blo"))).select(*on, "a_lo", "a_hi", "b_lo", "b_hi")


def _number(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")
