"""Durations that are only partly seen: spells within observed segments, at-risk counts, and hazards by state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a cell of fewer months at risk takes the rate of all cells together.
LEAST_MONTHS = 24


def _follows(order: str, w) -> Column:
    """Whether a row is the month after the row before it."""
    return F.col(order) == F.add_months(F.lag(order).over(w), 1)


def segmented_spells(df: DataFrame, label: str = "label", by: Sequence[str] = ("sid",), order: str = "dt") -> DataFrame:
    """``(by, segment, spell, state, start, duration, first, last)``: runs of one label within segments of consecutive months.

    Rows without a label, and months that are missing, end a segment. ``order`` is a date at the start of a month, one row a month and key.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(label).isNotNull() & F.col(order).isNotNull()).select(*by, order, F.col(label).alias("state"))
    rows = rows.withColumn("_cut", F.when(F.coalesce(_follows(order, w), F.lit(False)), 0).otherwise(1)).withColumn("_new", F.when((F.col("_cut") == 1) | (F.col("state") != F.lag("state").over(w)), 1).otherwise(0))
    rows = rows.withColumn("segment", F.sum("_cut").over(upto)).withColumn("spell", F.sum("_new").over(upto))
    runs = rows.groupBy(*by, "segment", "spell").agg(F.first("state").alias("state"), F.min(order).alias("start"), F.count(F.lit(1)).alias("duration"))
    own = Window.partitionBy(*by, "segment")
    return runs.withColumn("first", F.col("spell") == F.min("spell").over(own)).withColumn("last", F.col("spell") == F.max("spell").over(own))


def spell_observations(spells: DataFrame) -> DataFrame:
    """Spells that say something about durations: a segment's first one began unseen and is dropped; ``censored`` marks its last one, which may go on unseen."""
    return spells.where("NOT first").withColumn("censored", F.col("last")).drop("first", "last")


def segment_transitions(spells: DataFrame, by: Sequence[str] = ("sid",)) -> DataFrame:
    """``(by, segment, start, from, to)`` of each boundary inside a segment; none leads across a gap."""
    before = F.lag("state").over(Window.partitionBy(*by, "segment").orderBy("spell"))
    return spells.withColumn("from", before).where("NOT first").select(*by, "segment", "start", "from", F.col("state").alias("to"))


def duration_hazards(observations: DataFrame, state: str = "state") -> DataFrame:
    """``(state, duration, at_risk, ended, hazard, survival)`` for each duration at which a spell ends or is lost from sight.

    At risk are the spells that last as long at least; a censored one counts until its last month, and never as ended. ``survival`` is the product of
    what the hazards leave. Spells are counted before they are put in order, so a state has as many rows as it has durations.
    """
    counts = observations.groupBy(state, "duration").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("censored")).alias("ended"))
    w = Window.partitionBy(state)
    out = counts.withColumn("at_risk", F.sum("_n").over(w.orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("hazard", F.col("ended") / F.col("at_risk"))
    return out.withColumn("survival", F.product(1 - F.col("hazard")).over(w.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0))).select(state, "duration", "at_risk", "ended", "hazard", "survival")


def onset_hazard(df: DataFrame, cell: str, event: Column, cells: Sequence, by: Sequence[str] = ("sid",), order: str = "dt", least: int = LEAST_MONTHS) -> DataFrame:
    """``(cell, months, onsets, rate, fell_back)`` for each of ``cells``: how likely ``event`` begins in the month after one of the cell.

    At risk are months with a cell, not within an event, whose next month is known; the onset counts for the month before it. Cells of fewer than ``least``
    months at risk take the rate of all of them together (0 if there are none).
    """
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.select(*by, order, F.col(cell).alias("_cell"), F.coalesce(event, F.lit(False)).alias("_on"))
    rows = rows.withColumn("_next", F.when(F.lead(order).over(w) == F.add_months(order, 1), F.lead("_on").over(w)))
    risk = rows.where("_cell IS NOT NULL AND NOT _on AND _next IS NOT NULL")
    found = risk.groupBy("_cell").agg(F.count(F.lit(1)).alias("months"), F.count_if("_next").alias("onsets"))
    whole = found.agg(F.coalesce(F.try_divide(F.sum("onsets"), F.sum("months")), F.lit(0.0)).alias("_all"))
    asked = df.sparkSession.createDataFrame([(c,) for c in cells], df.select(F.col(cell).alias("cell")).schema)
    out = asked.join(found, F.col("cell") == F.col("_cell"), "left").crossJoin(F.broadcast(whole))
    months, onsets = F.coalesce("months", F.lit(0)), F.coalesce("onsets", F.lit(0))
    rate = F.when(months >= least, onsets / F.nullif(months, F.lit(0))).otherwise(F.col("_all"))
    return out.select("cell", months.alias("months"), onsets.alias("onsets"), rate.alias("rate"), (months < least).alias("fell_back"))
