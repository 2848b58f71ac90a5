"""A declared graph of series: some read, some derived from others, compiled to one plan.

``graph`` checks a declaration and refuses by name what can't be meant: a cycle, an input nobody declares, a wrong number
of inputs, units that don't go together. ``panel`` makes one table with a row for each date (of each key) and adds
a column for each declared series in topological order, so depth costs columns, not shuffles or scans.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DeclarationError(ValueError):
    """A declaration that can't be turned into a panel."""


@dataclass(frozen=True)
class Declared:
    """One series: read (``series``), ``derived`` by an expression from other declared ones, or ``unavailable``."""

    kind: str
    units: str | None = None
    series: str | None = None
    expr: str | None = None
    inputs: tuple[str, ...] = ()
    params: Mapping[str, float] = field(default_factory=dict)
    reason: str | None = None
    proxy: bool = False
    proxy_for: str | None = None
    numeraire: str | None = None


#: What each kind must and may state besides the flags that all may have.
SHAPES = {"series": ({"series", "units"}, set()), "derived": ({"expr", "inputs"}, {"units", "params"}), "unavailable": ({"reason"}, set())}
FLAGS = {"kind", "proxy", "proxy_for", "numeraire"}
#: What returns may be counted in.
NUMERAIRES = ("price", "total_return", "excess_return")


@dataclass(frozen=True)
class Frame:
    """Where an expression stands: the rows of its key, in order."""

    by: tuple[str, ...]
    order: str

    @property
    def whole(self):
        return Window.partitionBy(*(self.by or [F.lit(1)]))

    @property
    def back(self):
        return self.whole.orderBy(self.order)

    def lag(self, x: str, k: int) -> Column:
        """The value ``k`` own rows before: rows where the series has no value don't count."""
        keys = ", ".join(f"`{b}`" for b in self.by) or "1"
        return F.expr(f"lag(`{x}`, {k}) IGNORE NULLS OVER (PARTITION BY {keys} ORDER BY `{self.order}`)")


@dataclass(frozen=True)
class Expression:
    """Number of inputs (None: any from one), what it makes of their units, the column, and inputs that may be missing."""

    arity: int | None
    units: Callable[[tuple[str, ...]], str]
    value: Callable[[Frame, Sequence[str], Mapping[str, float]], Column]
    optional: tuple[int, ...] = ()
    params: tuple[str, ...] = ()


def _same(units: tuple[str, ...]) -> str:
    if len(set(units)) != 1:
        raise DeclarationError(f"inputs of differing units: {', '.join(sorted(set(units)))}")
    return units[0]


def _quotient(units: tuple[str, ...]) -> str:
    return "1" if units[0] == units[1] else f"{units[0]}/{units[1]}"


def _to(name: str) -> Callable[[tuple[str, ...]], str]:
    def rule(units: tuple[str, ...]) -> str:
        _same(units)
        return name

    return rule


def _log(x: str) -> Column:
    return F.when(F.col(x) > 0, F.log(F.col(x)))


def _trailing_mean(at: Frame, xs: Sequence[str], params: Mapping[str, float]) -> Column:
    k = int(params["rows"])
    own = [F.col(xs[0]), *[at.lag(xs[0], i) for i in range(1, k)]]
    return reduce(lambda a, b: a + b, own) / k


def _spliced(at: Frame, xs: Sequence[str], params: Mapping[str, float]) -> Column:
    """The first input, before its first row the second one fitted to it on common dates (or by given ``a`` and ``b``)."""
    y, x = F.col(xs[0]), F.col(xs[1])
    both = F.when(y.isNotNull(), x)
    if {"a", "b"} <= set(params):
        a, b, known = F.lit(float(params["a"])), F.lit(float(params["b"])), F.lit(True)
    else:
        pair = F.when(x.isNotNull(), y)
        b = F.try_divide(F.covar_pop(pair, both).over(at.whole), F.var_pop(both).over(at.whole))
        a = F.avg(pair).over(at.whole) - b * F.avg(both).over(at.whole)
        known = F.count(F.when(pair.isNotNull(), both)).over(at.whole) >= 2
    first = F.min(F.when(y.isNotNull(), F.col(at.order))).over(at.whole)
    return F.coalesce(y, F.when(known & (first.isNull() | (F.col(at.order) < first)), a + b * x))


EXPRESSIONS: dict[str, Expression] = {
    "add": Expression(2, _same, lambda at, xs, p: F.col(xs[0]) + F.col(xs[1])),
    "difference": Expression(2, _same, lambda at, xs, p: F.col(xs[0]) - F.col(xs[1])),
    "average": Expression(None, _same, lambda at, xs, p: reduce(lambda a, b: a + b, map(F.col, xs)) / len(xs)),
    "ratio": Expression(2, _quotient, lambda at, xs, p: F.try_divide(F.col(xs[0]), F.col(xs[1]))),
    "change": Expression(1, _same, lambda at, xs, p: F.when(F.col(xs[0]).isNotNull(), F.col(xs[0]) - at.lag(xs[0], 1))),
    "growth": Expression(1, _to("pct"), lambda at, xs, p: 100 * (F.try_divide(F.col(xs[0]), at.lag(xs[0], int(p["rows"]))) - 1), params=("rows",)),
    "trailing_mean": Expression(1, _same, _trailing_mean, params=("rows",)),
    "demeaned_log": Expression(1, _to("log"), lambda at, xs, p: _log(xs[0]) - F.avg(_log(xs[0])).over(at.whole)),
    "spliced": Expression(2, _same, _spliced, optional=(0,)),
}


@dataclass(frozen=True)
class Graph:
    """Checked declarations in topological order, with the units of each series."""

    declared: Mapping[str, Declared]
    order: tuple[str, ...]
    units: Mapping[str, str]
    absent: Mapping[str, str]

    def needed(self, names: Sequence[str]) -> list[str]:
        """The names and all they are derived from, in order; absent ones left out."""
        open_, seen = [n for n in names], set()
        while open_:
            name = open_.pop()
            if name not in self.declared:
                raise DeclarationError(f"{name} isn't declared")
            if name not in seen:
                seen.add(name)
                open_ += self.declared[name].inputs
        return [n for n in self.order if n in seen and n not in self.absent]

    def depth(self, name: str) -> int:
        return 1 + max((self.depth(i) for i in self.declared[name].inputs), default=-1)


def _declared(name: str, entry: object) -> Declared:
    if not isinstance(entry, Mapping):
        raise DeclarationError(f"{name} must be a mapping")
    kind = entry.get("kind")
    if kind not in SHAPES:
        raise DeclarationError(f"{name}: kind must be one of {', '.join(sorted(SHAPES))}, not {kind!r}")
    must, may = SHAPES[kind]
    if missing := sorted(k for k in must if not entry.get(k)):
        raise DeclarationError(f"{name} ({kind}) needs {', '.join(missing)}")
    if stray := sorted(k for k in entry if k not in must | may | FLAGS):
        raise DeclarationError(f"{name} ({kind}) must not state {', '.join(stray)}")
    texts = {k: entry[k] for k in ("series", "units", "expr", "reason", "proxy_for") if entry.get(k) is not None}
    if bad := sorted(k for k, v in texts.items() if not isinstance(v, str) or not v):
        raise DeclarationError(f"{name}: {', '.join(bad)} must be a text that isn't empty")
    inputs = entry.get("inputs", ())
    if isinstance(inputs, str) or not all(isinstance(i, str) and i for i in inputs):
        raise DeclarationError(f"{name}: inputs must be a list of names")
    proxy = entry.get("proxy", False)
    if not isinstance(proxy, bool) or proxy != ("proxy_for" in texts):
        raise DeclarationError(f"{name}: a proxy must be flagged and name what it stands for")
    if entry.get("numeraire") is not None and entry["numeraire"] not in NUMERAIRES:
        raise DeclarationError(f"{name}: numeraire must be one of {', '.join(NUMERAIRES)}")
    return Declared(kind, inputs=tuple(inputs), params=dict(entry.get("params") or {}), proxy=proxy, numeraire=entry.get("numeraire"), **texts)


def _sorted(declared: Mapping[str, Declared]) -> list[str]:
    """Inputs before what is derived from them, else as declared; a cycle is refused by its path. No recursion: chains may be long."""
    out, done = [], set()
    for root in declared:
        path, stack = [], [(root, iter(declared[root].inputs))] if root not in done else []
        path += [root] if stack else []
        while stack:
            name, rest = stack[-1]
            nxt = next((i for i in rest if i not in done), None)
            if nxt is None:
                stack.pop()
                path.pop()
                done.add(name)
                out.append(name)
            elif nxt in path:
                raise DeclarationError(f"a cycle: {' <- '.join([*path[path.index(nxt):], nxt])}")
            elif nxt not in declared:
                raise DeclarationError(f"{name}: unknown input {nxt}")
            else:
                path.append(nxt)
                stack.append((nxt, iter(declared[nxt].inputs)))
    return out


def expected_units(expr: str, inputs: Sequence[str], params: Mapping[str, float] = {}) -> str:  # noqa: B006
    """Units of an expression over inputs of these units; unknown expressions, wrong numbers and clashing units are refused."""
    if expr not in EXPRESSIONS:
        raise DeclarationError(f"unknown expression {expr}; known: {', '.join(sorted(EXPRESSIONS))}")
    of = EXPRESSIONS[expr]
    if not inputs or of.arity is not None and len(inputs) != of.arity:
        raise DeclarationError(f"{expr} takes {of.arity or 'some'} input(s), not {len(inputs)}")
    if missing := [p for p in of.params if p not in params]:
        raise DeclarationError(f"{expr} needs {', '.join(missing)}")
    return of.units(tuple(inputs))


def graph(declarations: Mapping[str, object], blocks: Mapping[str, Sequence[str]] | None = None) -> Graph:
    """Checks ``{name: declaration}`` and, where ``blocks`` are given, that each name is in exactly one of them.

    Units of derived series follow from their inputs; stated ones must agree. A derived series of which a required input is
    unavailable is absent too, with the reason; that is no fault.
    """
    if not declarations:
        raise DeclarationError("nothing is declared")
    declared = {name: _declared(name, entry) for name, entry in declarations.items()}
    if blocks is not None:
        listed = [n for names in blocks.values() for n in names]
        if twice := sorted({n for n in listed if listed.count(n) > 1}):
            raise DeclarationError(f"in several blocks: {', '.join(twice)}")
        if odd := sorted(set(listed) ^ set(declared)):
            raise DeclarationError(f"declared without a block, or in a block without a declaration: {', '.join(odd)}")
    order, units, absent = _sorted(declared), {}, {}
    for name in order:
        d = declared[name]
        if d.kind == "unavailable":
            absent[name] = d.reason
        elif d.kind == "series":
            units[name] = d.units
        else:
            optional = EXPRESSIONS[d.expr].optional if d.expr in EXPRESSIONS else ()
            gone = [i for k, i in enumerate(d.inputs) if i in absent and k not in optional]
            if gone:
                absent[name] = f"needs {', '.join(gone)}"
                continue
            known = [units[i] for i in d.inputs if i in units]
            try:
                units[name] = expected_units(d.expr, [units.get(i, known[0] if known else "") for i in d.inputs], d.params)
            except DeclarationError as e:
                raise DeclarationError(f"{name}: {e}") from None
            if d.units and d.units != units[name]:
                raise DeclarationError(f"{name}: stated in {d.units}, but {d.expr} gives {units[name]}")
    return Graph(declared, tuple(order), units, absent)


def panel(long: DataFrame, of: Graph, names: Sequence[str] | None = None, by: Sequence[str] = (), series: str = "sid", order: str = "dt", value: str = "v") -> DataFrame:
    """``(by, dt, a column for each name)``: the asked series (all by default), derived where all inputs that they require have a value.

    ``long`` has one row for each series, date and key; of several the largest value counts. Rows without a date are left out. A
    series without rows is null throughout, as is what requires it. Two shuffles at most, one by key and date and one by key, whatever
    the depth; windows hold the dates of one key. Only series that the asked names need are read: the scan gets their ids as a filter.
    """
    names = list(names if names is not None else of.order)
    needed = of.needed(names)
    reads = {n: of.declared[n].series for n in needed if of.declared[n].kind == "series"}
    at = Frame(tuple(by), order)
    known = long.where(F.col(series).isin(*sorted(set(reads.values()))) & F.col(order).isNotNull())
    wide = known.groupBy(*by, order).agg(*[F.max(F.when(F.col(series) == s, F.col(value))).alias(n) for n, s in reads.items()]) if reads else known.select(*by, order).distinct()
    for name in needed:
        d = of.declared[name]
        if d.kind == "derived":
            gone = [i for i in d.inputs if i in of.absent]
            wide = wide.withColumns({i: F.lit(None).cast("double") for i in gone if i not in wide.columns})
            wide = wide.withColumn(name, EXPRESSIONS[d.expr].value(at, d.inputs, d.params))
    return wide.select(*by, order, *[F.col(n) if n in needed else F.lit(None).cast("double").alias(n) for n in names])


def stacked(wide: DataFrame, names: Sequence[str], by: Sequence[str] = (), order: str = "dt") -> DataFrame:
    """``(name, by, dt, v)`` of a panel's values that aren't null."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias("e")
    return wide.select(*by, order, each).select("e.name", *by, order, "e.v").where("v IS NOT NULL")


def coverage(wide: DataFrame, of: Graph, names: Sequence[str] | None = None, order: str = "dt") -> DataFrame:
    """``(name, depth, units, rows, first, last, missing)`` for each name: ``missing`` says why there are no rows, else it is null."""
    names = list(names if names is not None else of.order)
    told = wide.sparkSession.createDataFrame([(n, of.depth(n), of.units.get(n), of.absent.get(n)) for n in names], "name string, depth int, units string, why string")
    found = stacked(wide, names, order=order).groupBy("name").agg(F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))
    return told.join(found, "name", "left").select("name", "depth", "units", F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last", F.when(F.col("rows").isNull(), F.coalesce("why", F.lit("no rows"))).alias("missing"))
