"""Streams of events: windows with watermarks, sessions, and a detector that keeps state. Extensions for live use."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """With a watermark; test tables' times carry no zone, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(events: DataFrame, width: str, by: str, value: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), by, "n", "mean", "high")


def sessions(events: DataFrame, gap: str, by: str, ts: str = "ts") -> DataFrame:
    out = events.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def deduplicated(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return events.dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def crossings(events: DataFrame, level: float, by: str, value: str, ts: str = "ts", tie: str | None = None, quiet: str = "1 day") -> DataFrame:
    """Each key's moves over a level, told from the last value seen: one number of state a key.

    A key's state goes when the watermark has passed its last event by ``quiet``, so replayed data are judged
    by their own times. Rows of one time go by ``tie`` (else as they come); a null value or time says nothing.
    Within a trigger rows are sorted; one that comes in a later trigger than its successors counts when it comes.
    """
    pause = int(pd.Timedelta(quiet).total_seconds() * 1000)
    order = [ts] if tie is None else [ts, tie]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for at, x in zip(rows[ts], rows[value], strict=True):
            if last is not None and (last < level) != (x < level):
                out.append((key[0], at, "up" if x >= level else "down"))
            last = float(x)
        state.update((last,))
        until = int(rows[ts].max().timestamp() * 1000) + pause
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, ts, "crossing"])

    kind = dict(events.dtypes)[by]
    known = events.where(F.col(ts).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {ts} timestamp, crossing string", "last double", "append", GroupStateTimeout.EventTimeTimeout)
