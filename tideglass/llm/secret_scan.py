"""Secret scans by patterns and by sliding-window entropy (operator 12).

Built-in functions only. A kind's matches and the texts between them give its places. Long runs of one
character class are candidates: a fold slides a window over each and keeps the window's character
counts, twelve to a word, and the sum of count * log2(count), both changed by the character that enters and the one
that leaves. Sums are whole numbers, so a window's entropy is the same however it was reached.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds with a pattern in order, the group that is measured and its least length.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # a run that is too short has no longer match inside
HEX = "[0-9a-f]{24,}"
KINDS = {"assign": ("(?i)" + ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``letters`` (a regular expression's class) at least as long as the window, hot from ``bits`` of entropy."""

    letters: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"{self.letters}{{{self.window},}}"

    @property
    def most(self) -> int:
        """Largest sum of count * log2(count), in millionths, of a hot window."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * 1e6)

    @property
    def weights(self) -> list[int]:
        """count * log2(count) in millionths by count."""
        return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(self.window + 1)]


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Twenty random hexadecimal digits have about 3.4 bits a character, 24 random ones of base 64 about 4.3; names and paths have less.
CLASSES = {
    "entropy-hex": CharacterClass("[0-9A-Fa-f]", _DIGITS + "ABCDEFabcdef", 20, 3.0),
    "entropy-base64": CharacterClass("[A-Za-z0-9+/_-]", _UPPER + _LOWER + _DIGITS + "+/_-", 24, 4.0),
}
#: Candidates that are no secrets, by what they hold or what stands before them (there A-Z lower-cased).
ALLOWED = "|".join(
    (
        r"\A[A-Za-z+/_-]+\z",
        r"\A[0-9+/_-]+\z",
        r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z",
        "(?:[Ee]xample|EXAMPLE|[Ss]ample|SAMPLE|[Dd]ummy|DUMMY|[Pp]laceholder|PLACEHOLDER|[Cc]hange[Mm]e|CHANGEME|[Rr]edacted|REDACTED|xxxx|XXXX)",
        "0123456789",
        "(?:abcdefghij|ABCDEFGHIJ)",
    )
)
ALLOWED_BEFORE = "|".join(
    (
        r"(?:sha-?[0-9]{1,3}|md5|commit|revision|checksum|digest|integrity|etag)[\x22']?\x20*[-:=(/\x20]\x20*[\x22']?\z",
        r"data:[a-z0-9.+/-]*;base64,\z",
        r"://[^\x09-\x0D\x20\x22'<>]*\z",
    )
)
CONTEXT = 64
#: Counts to a word and bits to a count; blocks of a running sum.
PER_WORD, COUNT_BITS, BLOCK = 12, 5, 128


def running(numbers: Column) -> Column:
    """Running sums of an array in blocks, so that no step copies more than a block or one entry a block."""

    def appended(values: Column) -> Column:
        add = lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v))
        return F.aggregate(values, F.array().cast("array<int>"), add)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda b: F.slice(numbers, b * BLOCK + 1, BLOCK))
    inner = F.transform(blocks, appended)
    ends = appended(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)))
    moved = F.zip_with(inner, F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))), lambda x, o: F.transform(x, lambda v: v + o))
    return F.when(F.size(numbers) > 0, F.flatten(moved)).otherwise(F.array().cast("array<int>"))


def _matches(df: DataFrame, name: str, pattern: str, group: int, context: int) -> DataFrame:
    """Adds ``name``: an array of (start, end, said, before) of all leftmost matches, ``said`` being the group, ``before`` the last characters of the text before."""
    p, text = F.lit(pattern), F.col("text")
    some = text.rlike(pattern)
    df = df.withColumn("_said", F.when(some, F.regexp_extract_all(text, p, F.lit(0)))).withColumn("_rest", F.when(some, F.split(text, pattern, -1)))
    df = df.withColumn("_group", F.when(some, F.regexp_extract_all(text, p, F.lit(group))) if group else F.col("_said"))
    df = df.withColumn("_size", F.transform("_said", lambda x: F.length(x)))
    # from the end of the last match but one to the end of this match
    df = df.withColumn("_step", F.zip_with(F.slice("_rest", 1, F.size("_said")), "_size", lambda r, n: F.length(r) + n))
    df = df.withColumn("_end", running(F.col("_step")))
    place = lambda k: F.struct((F.get("_end", k) - F.get("_size", k)).alias("start"), F.get("_end", k).alias("end"), F.get("_group", k).alias("said"), F.right(F.get("_rest", k), F.lit(context)).alias("before"))
    found = F.when(F.size("_said") > 0, F.transform(F.sequence(F.lit(0), F.size("_said") - 1), place)).otherwise(_none("start int, end int, said string, before string"))
    return df.withColumn(name, found).drop("_said", "_rest", "_group", "_size", "_step", "_end")


def _none(fields: str) -> Column:
    return F.array().cast(f"array<struct<{fields.replace(' ', ':')}>>".replace(",:", ","))


def hot_stretch(said: Column, of: CharacterClass) -> Column:
    """(first, last): from the start of the first hot window of a candidate to the end of the last; nulls without one."""
    words, weights = -(-len(of.alphabet) // PER_WORD), F.array(*[F.lit(w).cast("long") for w in of.weights])
    code = lambda c: F.instr(F.lit(of.alphabet), c) - 1
    units = F.array(*[F.lit(1 << COUNT_BITS * k).cast("long") for k in range(PER_WORD)])
    codes = F.transform(F.split(said, ""), lambda c: F.struct(F.floor(code(c) / PER_WORD).cast("int").alias("word"), F.get(units, code(c) % PER_WORD).alias("unit")))

    def slide(steps: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            enters, leaves = F.get(steps, t), F.get(steps, t - of.window)
            number = lambda x: F.call_function("div", F.get(acc.counts, x.word), x.unit).bitwiseAND(F.lit(2**COUNT_BITS - 1).cast("long")).cast("int")
            one = lambda x, k: F.when(x.word == k, x.unit).otherwise(F.lit(0).cast("long"))
            weight = lambda n: F.get(weights, n)
            gains = weight(number(enters) + 1) - weight(number(enters))
            loses = F.coalesce(weight(number(leaves)) - weight(number(leaves) - 1), F.lit(0).cast("long"))
            same = F.coalesce(enters == leaves, F.lit(False))
            total = F.when(same, acc.total).otherwise(acc.total + gains - loses)
            hot = (t >= of.window - 1) & (total <= of.most)
            return F.struct(
                F.when(same, acc.counts).otherwise(F.transform(acc.counts, lambda v, k: v + one(enters, k) - one(leaves, k))).alias("counts"),
                total.alias("total"),
                F.coalesce(acc.first, F.when(hot, t - of.window + 1)).alias("first"),
                F.when(hot, t + 1).otherwise(acc.last).alias("last"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), start, step, lambda acc: F.struct(acc.first.alias("first"), acc.last.alias("last")))

    # the array of codes is bound once, as an element of an array of one
    return F.get(F.transform(F.array(codes), slide), 0)


def secret_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, spans)``: one row for each row; ``spans`` is an array of (start, rank, kind, end), code points from 0, end exclusive, in order.

    Kinds ``assign``, ``access`` and ``hex`` are the leftmost matches of their patterns that are long enough. ``entropy-hex`` and
    ``entropy-base64`` are stretches of long runs of those characters from the first to the last window of high entropy, unless the run or
    what stands before it is on the allow-list; they may lie inside other spans. Null and empty texts have none. Repeated rows and ids
    stay apart, other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    df = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    spans = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        df = _matches(df, kind, pattern, group, 0)
        spans.append(_by_pattern(kind, rank, least))
    for rank, (kind, of) in enumerate(CLASSES.items(), len(KINDS)):
        df = _matches(df, kind, of.pattern, 0, CONTEXT)
        spans.append(_by_entropy(kind, rank, of))
    return df.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def _by_pattern(kind: str, rank: int, least: int) -> Column:
    kept = F.filter(F.col(kind), lambda x: F.length(x.said) >= least)
    return F.transform(kept, lambda x: _span(x.start, rank, kind, x.end))


def _by_entropy(kind: str, rank: int, of: CharacterClass) -> Column:
    open_ = F.filter(F.col(f"`{kind}`"), lambda x: ~x.said.rlike(ALLOWED) & ~F.translate(x.before, _UPPER, _LOWER).rlike(ALLOWED_BEFORE))
    hot = F.transform(open_, lambda x: F.struct(x.start.alias("start"), hot_stretch(x.said, of).alias("hot")))
    return F.transform(F.filter(hot, lambda x: x.hot.first.isNotNull()), lambda x: _span(x.start + x.hot.first, rank, kind, x.start + x.hot.last))


def _span(start: Column, rank: int, kind: str, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))


def digests(found: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of what ``secret_spans`` returns."""
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < len(KINDS))
    return found.select("doc_id", *map(count, KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
