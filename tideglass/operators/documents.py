"""Nested documents as paths and values, and what differs between two versions of them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _paths(text: str) -> Iterator[tuple[str, str, str]]:
    """(path, kind, value) of every leaf; empty objects and arrays are leaves. No recursion: documents may be deep."""
    open_ = [("$", json.loads(text))]
    while open_:
        path, value = open_.pop()
        if isinstance(value, dict) and value:
            open_ += [(f"{path}.{k}" if k.isidentifier() else f"{path}[{json.dumps(k, ensure_ascii=False)}]", v) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            open_ += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else "object" if isinstance(value, dict) else "array"
            yield path, kind, value if isinstance(value, str) else json.dumps(value)


def flattened(df: DataFrame, ids: Sequence[str], text: str = "document") -> DataFrame:
    """``(ids, path, kind, value)``: a row for each leaf of each JSON document; arrays by position.

    Paths are ``$.key``, ``$["other key"]`` and ``$[0]``; kinds tell the string "1" from the number 1 and an empty object from an empty array. Of a
    key that an object holds twice the last counts. A null document has no rows; text that is no JSON has one row of kind ``unreadable``.
    """
    rows = df.where(F.col(text).isNotNull()).select(*ids, F.col(text).alias("_t"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, doc in enumerate(batch.column(len(ids)).to_pylist()):
                try:
                    own = list(_paths(doc))
                except ValueError:
                    own = [("$", "unreadable", doc)]
                at += [i] * len(own)
                found += own
            index = pa.array(at, pa.int64())
            columns = zip(*found, strict=True) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(index) for k in range(len(ids))], *[pa.array(c, pa.string()) for c in columns]], [*ids, "path", "kind", "value"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*ids).schema)
    return rows.mapInArrow(leaves, f"{schema}path string, kind string, value string")


def difference(old: DataFrame, new: DataFrame, ids: Sequence[str], text: str = "document") -> DataFrame:
    """``(ids, path, change, old_kind, old_value, new_kind, new_value)`` of all paths that are ``added``, ``removed`` or ``changed``.

    A path that becomes an object or array is removed, and those below it added. One document for each id on either side; ids match where both are null.
    """
    sides = []
    for name, df in (("old", old), ("new", new)):
        flat = flattened(df, ids, text)
        sides.append(flat.select(*[F.col(i).alias(f"_{name}_{i}") for i in ids], F.col("path").alias(f"_{name}_path"), F.col("kind").alias(f"{name}_kind"), F.col("value").alias(f"{name}_value")))
    same = F.col("_old_path") == F.col("_new_path")
    for i in ids:
        same = same & F.col(f"_old_{i}").eqNullSafe(F.col(f"_new_{i}"))
    both = sides[0].join(sides[1], same, "full")
    change = F.when(F.col("_old_path").isNull(), "added").when(F.col("_new_path").isNull(), "removed").otherwise("changed")
    differs = F.col("_old_path").isNull() | F.col("_new_path").isNull() | (F.col("old_kind") != F.col("new_kind")) | (F.col("old_value") != F.col("new_value"))
    pick = lambda c: F.when(F.col("_old_path").isNotNull(), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c)
    return both.where(differs).select(*[pick(i) for i in ids], pick("path"), change.alias("change"), "old_kind", "old_value", "new_kind", "new_value")
