"""Text gates and counts over documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of terms by hash, those that are counted term by term at once, and those counted first for each term wanted.
BUCKETS, TURN, FIRST = 1 << 16, 1 << 12, 4


def words(c: str) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +", " "))


def without_suffixes(c: Column, suffixes: Sequence[str]) -> Column:
    """A normalised name without trailing legal forms, however many."""
    return F.regexp_replace(c, "( (" + "|".join(suffixes) + "))+$", "")


def top_terms(df: DataFrame, text: str, k: int, n: int = 1) -> DataFrame:
    """The ``k`` most frequent n-grams of words, ties by term; exact, and made for a small ``k``, as the driver sees the result and the buckets' counts.

    A bucket of hashes holds as many rows as any term in it, or more. So the fullest buckets are counted term by term, and
    after them, in turns, all others that reach the last count among the ``k`` found. The texts are read twice, and once more for
    each turn, of which there are ``BUCKETS / TURN`` at most: that is where terms are all about as frequent.
    """
    found = df.select(words(text).alias("_w")).where(F.size("_w") >= n)
    parts = [f"_{j}" for j in range(n)]
    # Words are found once a pass; the parts of a term stay apart until only the top ones are left.
    runs = F.arrays_zip(*[F.slice("_w", 1 + j, F.size("_w") - n + 1).alias(p) for j, p in enumerate(parts)])
    rows = found.select(F.explode(runs).alias("_e")).select("_e.*").withColumn("_h", F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)))

    def top(buckets: Sequence[int]) -> DataFrame:
        counts = rows.where(f"_h IN ({', '.join(map(str, buckets))})").groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))
        return ordered(counts.select(F.concat_ws(" ", *parts).alias("term"), "n"))

    def ordered(terms: DataFrame) -> DataFrame:
        return terms.orderBy(F.desc("n"), "term").limit(k)

    sizes = dict(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).collect())
    fullest = sorted(sizes, key=sizes.get, reverse=True)
    best = top(fullest[: FIRST * k] or [-1]).toArrow()
    least = best["n"][-1].as_py() if len(best) == k else 0
    rest = [h for h in fullest[FIRST * k :] if sizes[h] >= least]
    out = df.sparkSession.createDataFrame(best)
    for i in range(0, len(rest), TURN):
        out = out.unionByName(top(rest[i : i + TURN]))
    return ordered(out)


def mutual_information(df: DataFrame, present: Column, label: Column) -> DataFrame:
    """Bits between a flag and a label: joint counts, whose margins are windows over those few rows."""
    joint = df.groupBy(present.alias("_p"), label.alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    margin = lambda *c: F.sum("_n").over(Window.partitionBy(*c))
    rows = joint.withColumn("_x", margin("_p")).withColumn("_y", margin("_l")).withColumn("_t", margin(F.lit(1)))
    return rows.agg(F.sum(F.col("_n") / F.col("_t") * F.log2(F.col("_n") * F.col("_t") / (F.col("_x") * F.col("_y")))).alias("bits"))


def unsupported_numbers(df: DataFrame, text: str, claims: str) -> Column:
    """Numbers of a text that aren't among the values of an array column."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]+)"), 1)), F.col(claims))


def gate(df: DataFrame, text: str, rules: dict[str, str]) -> DataFrame:
    """For each row, the names of the patterns found in its text, as rows."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(text).rlike(p).alias("hit")) for k, p in rules.items()])).alias("e")
    return df.select("*", each).select(*df.columns, "e.rule", "e.hit")
