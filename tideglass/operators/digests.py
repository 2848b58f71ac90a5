"""Digests of tables as trees: the same for any order and partitioning of the rows, and a difference is found by its block."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: numbers count to so many decimals.
DECIMALS = 12
#: Digests that are joined into one on each level of the tree.
FANOUT = 1024
PREFIX = "sha256:"


def _text(df: DataFrame, column: str) -> Column:
    """A value as text: numbers that aren't whole with all decimals, null apart from any text."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind in ("double", "float"):
        # what a decimal can't hold keeps its own name or its shortest digits
        fits = F.abs(c) < 1e25
        told = F.when(fits, F.round(c.cast("double"), DECIMALS).cast(f"decimal(38,{DECIMALS})").cast("string")).otherwise(c.cast("double").cast("string"))
        told = F.when(told == f"-0.{'0' * DECIMALS}", f"0.{'0' * DECIMALS}").otherwise(told)
    else:
        told = c.cast("string")
    return F.coalesce(F.concat(F.lit("="), told), F.lit("-"))


def block_digests(df: DataFrame, block: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``(block columns, rows, digest)``: a digest of each block's rows, all columns by default.

    A row's digest is of its values in the columns' given order, each with its length; a block's is of its rows' sorted digests, so repeated rows count
    and order doesn't. A block is brought together as one array of digests: choose keys that bound its size.
    """
    columns = list(columns or df.columns)
    parts = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in (_text(df, c) for c in columns)]
    rows = df.select(*block, F.sha2(F.concat(*parts), 256).alias("_row"))
    joined = F.array_join(F.array_sort(F.collect_list("_row")), "")
    return rows.groupBy(*block).agg(F.count(F.lit(1)).alias("rows"), F.sha2(joined, 256).alias("digest"))


def root_digest(blocks: DataFrame, block: Sequence[str]) -> DataFrame:
    """One row ``(blocks, rows, digest)``: the tree over block digests. Levels join up to about 1,024 digests by their first characters until few are left.

    An empty table has the digest of nothing.
    """
    name = [F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in (_text(blocks, c) for c in block)]
    leaves = blocks.select(F.sha2(F.concat(*name, F.col("digest")), 256).alias("d"), "rows")
    # two levels by the digest's own first hexadecimal digits: digests are even, so a group holds its share of them
    one = leaves.groupBy(F.substring("d", 1, 5).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"), F.count(F.lit(1)).alias("blocks"), F.sum("rows").alias("rows"))
    two = one.groupBy(F.substring("p", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), ""), 256).alias("d"), F.sum("blocks").alias("blocks"), F.sum("rows").alias("rows"))
    top = two.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), ""), 256).alias("d"))
    return top.select("blocks", "rows", F.concat(F.lit(PREFIX), "d").alias("digest"))


def verify(recorded: DataFrame, recomputed: DataFrame, block: Sequence[str]) -> DataFrame:
    """``(block columns, fault)`` of the blocks that differ between two results of ``block_digests``: ``changed``, ``missing`` now, or ``unexpected``."""
    old = recorded.select(*[F.col(b).alias(f"_o{i}") for i, b in enumerate(block)], F.col("digest").alias("_od"))
    new = recomputed.select(*[F.col(b).alias(f"_n{i}") for i, b in enumerate(block)], F.col("digest").alias("_nd"))
    same = F.lit(True)
    for i in range(len(block)):
        same = same & F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}"))
    both = old.join(new, same, "full")
    fault = F.when(F.col("_nd").isNull(), "missing").when(F.col("_od").isNull(), "unexpected").when(F.col("_od") != F.col("_nd"), "changed")
    pick = [F.when(F.col("_od").isNotNull(), F.col(f"_o{i}")).otherwise(F.col(f"_n{i}")).alias(b) for i, b in enumerate(block)]
    return both.withColumn("fault", fault).where("fault IS NOT NULL").select(*pick, "fault")


def record(df: DataFrame, block: Sequence[str], inputs: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Block digests to keep, and the inputs with the root digest for a run's record; ``verify_run`` holds a table against both."""
    blocks = block_digests(df, block)
    return blocks, {**inputs, "digest": root_digest(blocks, block).first()["digest"]}


def verify_run(df: DataFrame, block: Sequence[str], kept: Mapping[str, str]) -> bool:
    """Whether the table's digest, computed again, is the recorded one."""
    return root_digest(block_digests(df, block), block).first()["digest"] == kept["digest"]
