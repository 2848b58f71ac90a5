"""Recurrences over sorted rows: a partition streams by, and of each series only the state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed(df: DataFrame, by: Sequence[str], order: str, inputs: Sequence[str], begin: Callable[[], object], step: Callable, out: Sequence[str]) -> DataFrame:
    """``(by, order, out)``: ``step(state, *inputs) -> (state, outputs)`` over each group's rows in order, from a new ``begin()``.

    Inputs are doubles, nulls count as zero; rows of one place go by their inputs. One shuffle by group; a series of any length passes once
    through one task, which holds its state and a batch of rows. An output may be None.
    """
    rows = df.select(*by, order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(inputs)])
    rows = rows.repartition(*by).sortWithinPartitions(*by, order, *[f"_x{i}" for i in range(len(inputs))])
    width = len(by)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True)
            values = zip(*(batch.column(width + 1 + i).to_pylist() for i in range(len(inputs))), strict=True)
            told = []
            for own, x in zip(keys, values, strict=True):
                if own != key:
                    key, state = own, begin()
                state, outputs = step(state, *x)
                told.append(outputs)
            columns = zip(*told, strict=True) if told else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width + 1)], *[pa.array(c, pa.float64()) for c in columns]], [*by, order, *out])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in [*by, order]] + [f"`{c}` double" for c in out])
    return rows.mapInArrow(fold, schema)
