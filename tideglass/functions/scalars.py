"""Scalar functions on columns: dates and labels as text, JSON, money, links and bounded responses. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_FENCE = "```"


def java_date_quarter(text: Column) -> Column:
    """``2023Q1`` of ``Fri Mar 31 00:00:00 UTC 2023``; null for any other build of text."""
    part = F.split(F.trim(text), "\\s+")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part[1])
    whole = (F.size(part) == 6) & (month > 0) & part[5].rlike("^[0-9]+$")
    return F.when(whole, F.concat(part[5], F.lit("Q"), (F.floor((month - 1) / 3) + 1).cast("string")))


def year_month(value: Column) -> Column:
    """The first seven characters of a date or its text."""
    return F.substring(value.cast("string"), 1, 7)


def slug(text: Column) -> Column:
    """Small letters and digits with single hyphens for all else, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def without_fences(text: Column) -> Column:
    """A text without the code fence around it and the fence's language."""
    inner = F.regexp_replace(F.trim(text), f"^{_FENCE}(?:[ \\t]*[A-Za-z]+[ \\t]*\\n)?", "")
    fenced = F.trim(text).startswith(_FENCE)
    body = F.when(fenced, F.regexp_replace(inner, f"\\s*{_FENCE}\\s*$", "")).otherwise(text)
    return F.regexp_replace(body, "^\\s+|\\s+$", "")


def outer_json(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is no such span or it is no JSON."""
    span = F.regexp_extract(without_fences(text), "(?s)(\\{.*\\})", 1)
    return F.when((span != "") & F.get_json_object(span, "$").isNotNull(), span)


def canonical_json(fields: Sequence[str]) -> Column:
    """An object of columns with sorted keys and no blanks."""
    return F.to_json(F.struct(*sorted(fields)))


def linked(source: Column, code: Column, templates: Mapping[str, str]) -> Column:
    """The template of a source with ``{code}`` filled in; null for an unknown source or a code that is needed and missing."""
    known = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    template = F.element_at(known, source)
    return F.when(template.contains("{code}"), F.replace(template, F.lit("{code}"), code)).otherwise(template)


def money(amount: Column, scale: int = 2) -> Column:
    """With thousands apart and one decimal, halves away from zero as decimals of ``scale`` places have them."""
    return F.format_number(F.round(amount.cast(f"decimal(18,{scale})"), 1), 1)


def signed_percent(hundredths: Column, scale: int = 2) -> Column:
    """A number of hundredths with its sign and one decimal, halves away from zero."""
    tenths = F.round(F.abs(hundredths).cast(f"decimal(18,{scale})"), -1).cast("double") / 100
    return F.concat(F.when(hundredths < 0, "-").otherwise("+"), F.format_string("%.1f%%", tenths))


def softplus(x: Column) -> Column:
    """``ln(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def distribution_response(drawdown: Column, spread_ratio: Column, a: float, b: float, low: float, high: float) -> Column:
    """Falls with drawdown depth and the spread over its anchor, within bounds; null for impossible inputs."""
    raw = F.exp(-a * drawdown - b * F.log(spread_ratio))
    return F.when((drawdown >= 0) & (spread_ratio > 0), F.least(F.lit(high), F.greatest(F.lit(low), raw)))


def call_response(drawdown: Column, c: float, low: float = 0.5, high: float = 1.2) -> Column:
    return F.when(drawdown >= 0, F.least(F.lit(high), F.greatest(F.lit(low), 1 - c * drawdown)))


def halved(base: Column | float, shift: Column, least: float = 5.0) -> Column:
    """``base`` halved ``shift`` times, but no less than ``least``."""
    return F.greatest(F.lit(least), F.lit(base) * F.pow(F.lit(0.5), shift))
