"""Rules over nested documents: what is out of bounds is put within and told, what is wrong is refused by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType, NumericType, StructType

_CLAMPS = "array<struct<path:string,submitted:double,applied:double>>"
#: Fixed value: so many clamps of one document make its interpretation doubtful.
HEAVY = 3


@dataclass(frozen=True)
class Rule:
    """``holds`` is true, false or null (it can't be told for this document); a ``blocking`` rule refuses the document, another warns."""

    name: str
    blocking: bool
    holds: Column
    message: Column


def _leaf(value: Column, kind: DataType, low: float | None, high: float | None) -> Column:
    out = value
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    return (out if not isinstance(kind, IntegralType) else F.floor(out)).cast(kind)


def _within(value: Column, kind: DataType, at: str, bounds: Mapping[str, tuple]) -> Column:
    """The value with everything below ``at`` within bounds."""
    if isinstance(kind, StructType) and any(p.startswith(f"{at}/") for p in bounds):
        return F.when(value.isNotNull(), F.struct(*[_within(value[f.name], f.dataType, f"{at}/{f.name}", bounds).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType) and any(p.startswith(f"{at}/*") for p in bounds):
        return F.transform(value, lambda x: _within(x, kind.elementType, f"{at}/*", bounds))
    return _leaf(value, kind, *bounds[at]) if at in bounds and isinstance(kind, NumericType) else value


def _moved(value: Column, kind: DataType, at: str, told: Column, bounds: Mapping[str, tuple]) -> Column | None:
    """The clamps at and below a place; ``told`` is its path with the numbers of array elements. None where nothing is bound."""
    if isinstance(kind, StructType):
        parts = [_moved(value[f.name], f.dataType, f"{at}/{f.name}", F.concat(told, F.lit(f"/{f.name}")), bounds) for f in kind]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, ArrayType):
        if not any(p.startswith(f"{at}/*") for p in bounds):
            return None
        each = F.transform(value, lambda x, i: _moved(x, kind.elementType, f"{at}/*", F.concat(told, F.lit("/"), i.cast("string")), bounds))
        return F.coalesce(F.flatten(each), F.array().cast(_CLAMPS))
    if at not in bounds or not isinstance(kind, NumericType):
        return None
    new = _leaf(value, kind, *bounds[at])
    return F.when(new != value, F.array(F.struct(told.alias("path"), value.cast("double").alias("submitted"), new.cast("double").alias("applied")))).otherwise(F.array().cast(_CLAMPS))


def clamped(df: DataFrame, column: str, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """The document column (a struct) with its numbers within ``bounds``, and ``clamps``: an array of (path, submitted, applied).

    Bounds are by path, ``/a/b`` or ``/list/*/c``; either end may be None. Nulls, missing parts and paths that the documents don't have are left alone;
    whole numbers stay whole. A null document has no clamps. All of it is one projection.
    """
    kind = df.schema[column].dataType
    moved = _moved(F.col(column), kind, "", F.lit(""), bounds)
    clamps = F.coalesce(moved, F.array().cast(_CLAMPS)) if moved is not None else F.array().cast(_CLAMPS)
    return df.withColumn("clamps", clamps).withColumn(column, _within(F.col(column), kind, "", bounds))


def windows_inside(windows: Column, quarters: Column, at: str, start: str = "start", length: str = "length") -> tuple[Column, Column]:
    """Windows (structs) put within ``quarters``: too long ones are cut to it, those that reach beyond start earlier; and what was changed, as clamps.

    Windows without a start or a length, and all of them where ``quarters`` is null, are left alone.
    """
    whole = lambda x: F.when(x[start].isNotNull() & x[length].isNotNull(), F.least(x[length], quarters)).otherwise(x[length])
    first = lambda x: F.when(x[start] + whole(x) > quarters, F.greatest(F.lit(0), quarters - whole(x))).otherwise(x[start])
    known = quarters.isNotNull()
    new = F.when(known, F.transform(windows, lambda x: x.withField(length, whole(x).cast("long")).withField(start, first(x).cast("long")))).otherwise(windows)

    def told(x: Column, i: Column) -> Column:
        said = [
            F.when(put(x) != x[name], F.struct(F.concat(F.lit(f"{at}/"), i.cast("string"), F.lit(f"/{name}")).alias("path"), x[name].cast("double").alias("submitted"), put(x).cast("double").alias("applied")))
            for name, put in ((length, whole), (start, first))
        ]
        return F.filter(F.array(*said), lambda c: c.isNotNull())

    return new, F.coalesce(F.when(known, F.flatten(F.transform(windows, told))), F.array().cast(_CLAMPS))


def judged(df: DataFrame, ids: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """``(ids, rule, blocking, verdict, message)`` of each rule for each document: ``passed``, ``failed`` with its message, or ``not evaluated``, which is neither."""
    each = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.blocking).alias("blocking"), F.when(r.holds.isNull(), "not evaluated").when(r.holds, "passed").otherwise("failed").alias("verdict"),
            F.when(~r.holds, r.message.cast("string")).alias("message"),
        )
        for r in rules
    ]
    return df.select(*ids, F.explode(F.array(*each)).alias("e")).select(*ids, "e.*")


def decided(df: DataFrame, ids: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """``(ids, accepted, refusals, warnings, untold)``: documents without a failed blocking rule are accepted; the rest name the rules, in their order. No shuffle."""
    pick = lambda some: F.filter(F.array(*[F.when(test, F.lit(r.name)) for r, test in some]), lambda x: x.isNotNull()) if some else F.array().cast("array<string>")
    refusals = pick([(r, ~r.holds) for r in rules if r.blocking])
    warnings = pick([(r, ~r.holds) for r in rules if not r.blocking])
    untold = pick([(r, r.holds.isNull()) for r in rules])
    return df.select(*ids, (F.size(refusals) == 0).alias("accepted"), refusals.alias("refusals"), warnings.alias("warnings"), untold.alias("untold"))
