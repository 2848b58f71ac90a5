"""How near generated sequences come to those they were made from: nearest windows by an index that prunes pairs.

Windows are rows with their values as an array. Segment means give a lower bound of the distance of two windows, and the
mean of all values one that is a distance on a line. Candidates are dealt to cells of that line; each query
takes one exact distance near its own cell, and then looks only into cells, and at candidates, that can still beat it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles
from .statistics import rank_auc

#: Cells of a key: one for so many candidates, so many at most.
PER_CELL, CELLS = 16, 1024
#: Keeps what rounding could put just beyond a bound.
SLACK = 1 + 1e-9


def standardized(df: DataFrame, reference: DataFrame, by: Sequence[str] = ("sid",), value: str = "r") -> DataFrame:
    """``value`` less the reference's mean of the key, over its population deviation (1 where that is zero); keys that the reference lacks go."""
    fit = reference.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).where("_m IS NOT NULL")
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return df.join(fit, list(by)).withColumn(value, (F.col(value) - F.col("_m")) / scale).drop("_m", "_s")


def windows(df: DataFrame, length: int, stride: int = 1, by: Sequence[str] = ("sid",), order: str = "dt", value: str = "r") -> DataFrame:
    """``(by, start, xs)``: each full window of ``length`` rows that starts at a multiple of ``stride``, from 0; rows without a value don't count."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.where(F.col(value).isNotNull()).select(*by, order, value).withColumn("start", F.row_number().over(w) - 1)
    rows = rows.withColumn("xs", F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(0, length - 1)))
    return rows.where((F.size("xs") == length) & (F.col("start") % stride == 0)).select(*by, "start", "xs")


def _means(xs: Column, length: int, segments: int) -> Column:
    cuts = [length * k // segments for k in range(segments + 1)]
    parts = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return F.array(*[F.aggregate(F.slice(xs, a + 1, b - a), F.lit(0.0), lambda s, v: s + v) / (b - a) for a, b in parts])


def _least(a: Column, b: Column, length: int, segments: int) -> Column:
    cuts = [length * k // segments for k in range(segments + 1)]
    sizes = F.array(*[F.lit(float(y - x)) for x, y in zip(cuts, cuts[1:], strict=False) if y > x])
    gaps = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), sizes, lambda d, n: d * n)
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v))


def _exact(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def nearest_windows(queries: DataFrame, candidates: DataFrame, length: int, exclude: int = 0, by: Sequence[str] = ("sid",), ids: Sequence[str] = ("start",), segments: int = 4) -> DataFrame:
    """``(by, ids, distance, tried)``: each query's Euclidean distance to the nearest candidate of its key; ``tried`` counts exact distances.

    ``exclude``: candidates that start less than so many rows from the query don't count. Equal candidates of a key are held once, with
    their first and last start, so copies cost nothing. Queries without a candidate have no row; queries of one key and id are taken
    as one. A key's candidates lie in up to 1,024 cells, so a large key spreads over tasks.
    """
    by, ids, size = list(by), list(ids), float(length)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v) / size
    c = candidates.groupBy(*by, F.col("xs").alias("c")).agg(F.min("start").alias("lo"), F.max("start").alias("hi")).withColumn("cm", mean(F.col("c"))).withColumn("cs", _means(F.col("c"), length, segments))
    line = c.groupBy(*by).agg(F.min("cm").alias("low"), F.max("cm").alias("high"), F.count(F.lit(1)).alias("k"))
    cells = F.least(F.lit(CELLS), F.greatest(F.lit(1), F.ceil(F.col("k") / PER_CELL))).cast("int")
    line = line.select(*by, "low", cells.alias("cells"), F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / cells).otherwise(1.0).alias("width"))

    def cell(x: Column) -> Column:
        return F.least(F.col("cells") - 1, F.greatest(F.lit(0), F.floor((x - F.col("low")) / F.col("width")).cast("int")))

    c = c.join(line, by).select(*by, cell(F.col("cm")).alias("cell"), "c", "cs", "lo", "hi")
    q = queries.select(*by, *ids, *(["start"] if exclude and "start" not in ids else []), F.col("xs").alias("q")).dropDuplicates(by + ids)
    q = q.withColumn("qm", mean(F.col("q"))).withColumn("qs", _means(F.col("q"), length, segments)).join(line, by)
    apart = (F.abs(F.col("start") - F.col("lo")) >= exclude) | (F.abs(F.col("hi") - F.col("start")) >= exclude) if exclude else F.lit(True)
    least, exact = _least(F.col("qs"), F.col("cs"), length, segments), _exact(F.col("q"), F.col("c"))

    own = cell(F.col("qm"))
    near = q.withColumn("cell", F.explode(F.sequence(F.greatest(F.lit(0), own - 1), F.least(F.col("cells") - 1, own + 1)))).join(c, [*by, "cell"]).where(apart)
    near = near.groupBy(*by, *ids).agg(F.min_by(F.struct("q", "c"), least).alias("e")).select(*by, *ids, _exact(F.col("e.q"), F.col("e.c")).alias("most"))
    q = q.join(near, by + ids, "left")
    reach = F.col("most") * SLACK / F.sqrt(F.lit(size)) + F.col("width") * 1e-9
    first = F.when(F.col("most").isNull(), F.lit(0)).otherwise(cell(F.col("qm") - reach))
    last = F.when(F.col("most").isNull(), F.col("cells") - 1).otherwise(cell(F.col("qm") + reach))
    pairs = q.withColumn("cell", F.explode(F.sequence(first, last))).join(c, [*by, "cell"]).where(apart)
    pairs = pairs.where(F.col("most").isNull() | (least <= F.col("most") * SLACK)).withColumn("d", exact)
    return pairs.groupBy(*by, *ids).agg(F.min("d").alias("distance"), (F.count(F.lit(1)) + F.max(F.when(F.col("most").isNull(), 0).otherwise(1))).alias("tried"))


def leave_one_out_epsilon(train: DataFrame, length: int, percentile: float, by: Sequence[str] = ("sid",), **columns: str) -> DataFrame:
    """``(by, n, epsilon)``: the percentile of distances from each block of the key's series to its nearest sliding window that shares no row with it."""
    found = nearest_windows(windows(train, length, length, by, **columns), windows(train, length, 1, by, **columns), length, exclude=length, by=by)
    return quantiles(found, "distance", {"epsilon": percentile}, by)


def signals(train: DataFrame, held_out: DataFrame, generated: DataFrame, length: int, percentile: float, least_blocks: int = 2, by: Sequence[str] = ("sid",), path: str = "path", order: str = "dt", value: str = "r") -> DataFrame:
    """``(kind, by, place, distance, epsilon)`` of generated, train and held-out blocks, all standardised by the train rows of their key.

    Generated blocks, cut within paths, are measured against all sliding windows of the train rows; train and held-out ones against the
    generated blocks. Keys of fewer than ``least_blocks`` train blocks are left out.
    """
    fit = lambda df: standardized(df, train, by, value)
    real, other, made = fit(train), fit(held_out), fit(generated)
    blocks = windows(real, length, length, by, order, value)
    enough = blocks.groupBy(*by).count().where(F.col("count") >= least_blocks).select(*by)
    keys, key = list(by), [F.col(b) for b in by]
    made_blocks = windows(made, length, length, [*by, path], order, value)
    bars = leave_one_out_epsilon(real, length, percentile, by, order=order, value=value).select(*by, "epsilon")
    to_train = nearest_windows(made_blocks, windows(real, length, 1, by, order, value), length, by=by, ids=[path, "start"])
    parts = [to_train.select(F.lit("generated").alias("kind"), *key, F.concat_ws(":", path, "start").alias("place"), "distance")]
    for kind, rows in (("train", blocks), ("held_out", windows(other, length, length, by, order, value))):
        found = nearest_windows(rows, made_blocks, length, by=by)
        parts.append(found.select(F.lit(kind).alias("kind"), *key, F.col("start").cast("string").alias("place"), "distance"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.join(enough, keys, "left_semi").join(bars, keys, "left").select("kind", *keys, "place", "distance", "epsilon")


def summary(found: DataFrame, least_generated: int = 1) -> DataFrame:
    """One row of the pooled signals: blocks, 5th and 50th percentile of generated distances, share of them below epsilon, and the chance that a
    train block lies nearer to generated ones than a held-out block does. No row under ``least_generated`` generated blocks."""
    made = found.where("kind = 'generated'")
    points = quantiles(made, "distance", {"p05": 0.05, "p50": 0.5})
    share = made.agg(F.avg(F.when(F.col("distance") < F.col("epsilon"), 1.0).otherwise(0.0)).alias("near_duplicates"))
    near = found.where("kind <> 'generated'").withColumn("_near", -F.col("distance"))
    auc = rank_auc(near, F.col("kind") == "train", "_near").select(F.col("auc").alias("membership_auc"))
    return points.where(F.col("n") >= least_generated).crossJoin(F.broadcast(share)).crossJoin(F.broadcast(auc)).withColumnRenamed("n", "blocks")
