"""Embedding near-duplicates (operator 3): random-hyperplane signs in several tables, exact cosines, components.

Equal vectors collapse first. A bucket is a table and a code; its members meet in blocks, as matrix
products in double precision. A pair counts in the first table in which it meets, so nothing but
link counts and a spanning forest of each block pair leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: Members of a bucket aimed at; members compared at once; chance that a pair just at the threshold meets in no table; seed.
BUCKET, BLOCK, MISSED, SEED = 64, 512, 1e-3, 20_250_101

#: Ids from here on stand for classes of rows without an id.
_NO_ID = 1 << 62


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a code and number of tables for ``n`` vectors: both follow from n and ``MISSED`` alone."""
    bits = min(30, max(4, round(math.log2(max(1, n / BUCKET)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log1p(-agree)))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The code of each vector in each table."""
    signs = (vectors @ planes(vectors.shape[1], bits, tables) >= 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits))


def embedding_near_dups(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Vectors of equal length link at a cosine of ``threshold`` or more, in double precision. A vector that is
    null, empty, all zero or holds a null or non-finite component links with nothing. A pair just at the threshold is
    found with a chance of 99.9 %, a closer one more surely; no pair below it is ever linked. Vectors are told apart by
    128 bits of hashes. Rows that hold the same vector are all linked with each other, repeated ids too. A null id is kept as a row and
    counts for its partners. Columns other than the two named are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    # Single precision travels as it is; every cosine is formed in double precision.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("usable", F.coalesce(whole, F.lit(False))).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(7), "v"))
    classes = base.where("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.any_value("v").alias("v"))
    classes = scratch.save(classes.withColumn("rep", F.coalesce("rep", F.lit(_NO_ID) + F.shiftrightunsigned("k1", 2))).withColumn("dim", F.size("v")), "classes")
    n = classes.count()
    bits, tables = tables_for(n, threshold)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, k1, k2 = (np.array(batch.column(c)) for c in ("dim", "k1", "k2"))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                v = np.array(batch.column("v").take(pa.array(own)).flatten(), dtype=np.float64).reshape(len(own), dim)
                c = codes(v, bits, tables)
                columns = [np.full(c.size, dim), np.tile(np.arange(tables), len(own)), c.ravel(), np.repeat(k1[own], tables), np.repeat(k2[own], tables)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["dim", "tab", "code", "k1", "k2"])

    entries = scratch.save(classes.select("dim", "k1", "k2", "v").mapInArrow(coded, "dim long, tab long, code long, k1 long, k2 long"), "entries")
    key = ["dim", "tab", "code"]
    blocks = entries.groupBy(*key).count().where("count > 1").select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(blocks, key).withColumn("own", F.pmod(F.xxhash64("k1"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k1", "k2").join(classes.select("k1", "k2", "rep", "mult", "v"), ["k1", "k2"])
    key += ["i", "j"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "rep")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            change = np.flatnonzero((batch[key].to_numpy()[1:] != batch[key].to_numpy()[:-1]).any(axis=1)) + 1
            edges = [0, *change.tolist(), len(batch)]
            yield _results([_links(batch.iloc[a:b], threshold, bits, tables) for a, b in zip(edges[:-2], edges[1:-1], strict=True)])
            held = batch.iloc[edges[-2] :]
        if held is not None and len(held):
            yield _results([_links(held, threshold, bits, tables)])

    found = scratch.save(dealt.drop("k1", "k2").mapInPandas(compared, "a long, b long, links long"), "found")
    components = connected_components(found.where("b is not null").select("a", "b"), scratch, "stars")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    per_class = classes.select("k1", "k2", "rep", "mult").join(links.withColumnRenamed("a", "rep"), "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = per_class.select("k1", "k2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = base.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = base.where("usable").select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id").union(alone)
    out = out.withColumn("component_id", F.when(F.col("component_id") < _NO_ID, F.col("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _results(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Link counts (``b`` null) and spanning edges of several block pairs."""
    none = np.zeros(0, np.int64)
    ids, links, edges = (np.concatenate([none if i < 2 else none.reshape(0, 2), *(p[i] for p in parts)]) for i in range(3))
    return pd.DataFrame(
        {
            "a": np.concatenate([ids, edges[:, 0]]),
            "b": pd.array(np.concatenate([ids, edges[:, 1]]), dtype="Int64").copy(),
            "links": np.concatenate([links, np.zeros(len(edges), np.int64)]),
        }
    ).assign(b=lambda d: d["b"].mask(np.arange(len(d)) < len(ids)))


def _links(group: pd.DataFrame, threshold: float, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rep, links)`` of members with links that first meet here, and a spanning forest of those links."""
    v = np.stack(group["v"].to_numpy()).astype(np.float64)
    table, rep, mult, own = int(group["tab"].iloc[0]), group["rep"].to_numpy(), group["mult"].to_numpy(), group["own"].to_numpy()
    unit = v / np.abs(v).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = np.triu(unit @ unit.T >= threshold, 1)
    if group["i"].iloc[0] != group["j"].iloc[0]:
        near &= own[:, None] != own[None, :]
    x, y = np.nonzero(near)
    if len(x) and table:
        c = codes(v, bits, tables)[:, :table]
        first = ~(c[x] == c[y]).any(axis=1)
        x, y = x[first], y[first]
    links = np.bincount(x, weights=mult[y], minlength=len(v)) + np.bincount(y, weights=mult[x], minlength=len(v))
    some = links > 0
    return rep[some], links[some].astype(np.int64), rep[forest(len(v), x, y)]


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edges ``(k, 2)`` that join the same of ``n`` nodes as the links ``x[i], y[i]`` do, at most n - 1."""
    near = np.zeros((n, n), dtype=bool)
    near[x, y] = near[y, x] = True
    fresh, out = np.zeros(n, dtype=bool), []
    fresh[x] = fresh[y] = True
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root], todo = False, [root]
        while todo:
            at = todo.pop()
            more = np.flatnonzero(near[at] & fresh)
            fresh[more] = False
            out += [(at, m) for m in more.tolist()]
            todo += more.tolist()
    return np.array(out, dtype=np.int64).reshape(len(out), 2)
