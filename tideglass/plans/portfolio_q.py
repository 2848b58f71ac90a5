"""Portfolio queries: recurrences over quarters of each path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import portfolio as pf
from . import tables as t
from .registry import query
from .windows_q import r6

_QUARTERS = "qs AS (SELECT path, CAST(m // 3 AS BIGINT) AS q, product(1 + r) - 1 AS r, sum(abs(r)) AS a, sum(g) AS g FROM ensemble GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY q) AS i FROM qs)"


def quarters(spark, d):
    e = t.ensemble(spark, d).withColumn("q", F.floor(F.col("m") / 3))
    return e.groupBy("path", "q").agg((F.product(1 + F.col("r")) - 1).alias("r"), F.sum(F.abs("r")).alias("a"), F.sum("g").alias("g"))


_RC = [0.25, 0.3, 0.5]


@query(
    f"""WITH RECURSIVE {_QUARTERS}, f AS (SELECT path, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS q, CAST(0.0 AS DOUBLE) AS age, CAST(100.0 AS DOUBLE) AS unfunded, CAST(0.0 AS DOUBLE) AS nav, CAST(0.0 AS DOUBLE) AS call, CAST(0.0 AS DOUBLE) AS dist FROM (SELECT DISTINCT path FROM n)
    UNION ALL SELECT path, i, q, age + 0.25, CASE WHEN over_ THEN 0.0 ELSE unfunded - call END, grown + call - paid * grown, call, paid * grown FROM (
        SELECT n.path, n.i, n.q, f.age, f.unfunded, f.age >= 5 AS over_, CASE WHEN f.age >= 5 THEN 0.0 ELSE least(f.unfunded, least(1.0, [0.25, 0.3, 0.5][least(CAST(floor(f.age) AS INT), 2) + 1] * 0.25) * f.unfunded) END AS call,
               greatest(0.0, f.nav * (1 + n.r)) AS grown, CASE WHEN f.age >= 5 THEN 1.0 ELSE least(1.0, 0.4 * pow(least(1.0, f.age / 5), 2.5) * 0.25) END AS paid FROM f JOIN n ON n.path = f.path AND n.i = f.i + 1))
    SELECT path, q, round(call, 6) + 0.0 AS call, round(dist, 6) + 0.0 AS dist, round(nav, 6) + 0.0 AS nav, round(unfunded, 6) + 0.0 AS unfunded FROM f WHERE i > 0"""
)
def closed_end_fund(spark, d):
    return pf.closed_end(quarters(spark, d), ["path"], "q", "r", 100.0, _RC, 5.0, 2.5, 0.4).select("path", "q", *r6("call", "dist", "nav", "unfunded"))


@query(
    f"""WITH RECURSIVE {_QUARTERS}, f AS (SELECT path, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS q, CAST(0.1 AS DOUBLE) AS cash, CAST(0.2 AS DOUBLE) AS liquid, CAST(0.3 AS DOUBLE) AS private, CAST(0.0 AS DOUBLE) AS sold, CAST(0.0 AS DOUBLE) AS forced FROM (SELECT DISTINCT path FROM n)
    UNION ALL SELECT path, i, q, lft + sold + nav * 0.8, liquid - sold, private - nav, sold, nav * 0.8 FROM (SELECT *, least(private, (greatest(0.0, -lft) - sold) / 0.8) AS nav FROM (SELECT *, least(greatest(0.0, -lft), liquid) AS sold FROM (
        SELECT n.path, n.i, n.q, f.liquid, f.private, f.cash + n.a - 0.03 - greatest(n.g, 0.0) AS lft FROM f JOIN n ON n.path = f.path AND n.i = f.i + 1))))
    SELECT path, q, round(cash, 10) + 0.0 AS cash, round(liquid, 10) + 0.0 AS liquid, round(private, 10) + 0.0 AS private, round(sold, 10) + 0.0 AS sold, round(forced, 10) + 0.0 AS forced FROM f WHERE i > 0"""
)
def cash_waterfall(spark, d):
    q = quarters(spark, d).select("path", "q", F.col("a").alias("income"), F.lit(0.03).alias("calls"), F.greatest(F.col("g"), F.lit(0.0)).alias("spending"))
    return pf.waterfall(q, ["path"], "q", ("income", "calls", "spending"), 0.1, 0.2, 0.3, 0.2).select("path", "q", *(F.round(c, 10).alias(c) for c in ("cash", "liquid", "private", "sold", "forced")))


@query(
    f"""WITH RECURSIVE {_QUARTERS}, f AS (SELECT path, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS q, CAST(0.0 AS DOUBLE) AS pending, CAST(1.0 AS DOUBLE) AS nav, CAST(0.0 AS DOUBLE) AS paid FROM (SELECT DISTINCT path FROM n)
    UNION ALL SELECT path, i, q, w - least(w, 0.05 * nav), nav - least(w, 0.05 * nav), least(w, 0.05 * nav) FROM (SELECT n.path, n.i, n.q, f.nav, f.pending + n.a AS w FROM f JOIN n ON n.path = f.path AND n.i = f.i + 1))
    SELECT path, q, round(paid, 6) + 0.0 AS paid, round(pending, 6) + 0.0 AS pending, round(nav, 6) + 0.0 AS nav FROM f WHERE i > 0"""
)
def gated_redemptions(spark, d):
    return pf.gated_redemptions(quarters(spark, d), ["path"], "q", "a", 1.0, 0.05).select("path", "q", *r6("paid", "pending", "nav"))


@query(
    """WITH RECURSIVE n AS (SELECT path, m, r, row_number() OVER (PARTITION BY path ORDER BY m) AS i FROM ensemble), f AS (SELECT path, m, i, r * r AS var FROM n WHERE i = 1
    UNION ALL SELECT n.path, n.m, n.i, 0.9 * f.var + (1 - 0.9) * n.r * n.r FROM f JOIN n ON n.path = f.path AND n.i = f.i + 1) SELECT path, m, round(var, 9) + 0.0 AS var FROM f"""
)
def ewma_variance(spark, d):
    return pf.ewma_variance(t.ensemble(spark, d), ["path"], "m", "r", 0.9).select("path", "m", F.round("var", 9).alias("var"))


@query(
    """SELECT s_suppkey, round(list_sum(list_transform(range(1, 31), lambda i: 1000 / pow(1 + rate, i))), 4) AS pv, round(list_sum(list_transform(range(1, 31), lambda i: i / pow(1 + rate, i))) / list_sum(list_transform(range(1, 31), lambda i: 1 / pow(1 + rate, i))), 6) AS duration
    FROM (SELECT s_suppkey, 0.01 + abs(s_acctbal) / 200000 AS rate FROM supplier)"""
)
def liability_value(spark, d):
    rate = 0.01 + F.abs("s_acctbal") / 200000
    return t.read(spark, d, "supplier").select("s_suppkey", F.round(pf.present_value(F.lit(1000.0), rate, 30), 4).alias("pv"), F.round(pf.duration(rate, 30), 6).alias("duration"))


@query("SELECT path, m, round(coalesce(p / 12 + 7 * (p - y), y / 12), 6) + 0.0 AS ret FROM (SELECT path, m, g + 0.05 AS y, lag(g + 0.05) OVER (PARTITION BY path ORDER BY m) AS p FROM ensemble)")
def bond_total_return(spark, d):
    e = t.ensemble(spark, d).withColumn("y", F.col("g") + 0.05)
    return e.select("path", "m", F.round(pf.bond_return(F.col("y"), "path", "m", 7.0), 6).alias("ret"))


@query("SELECT l_suppkey AS k, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS coverage, sum(l_extendedprice * l_discount) / sum(l_extendedprice) > 0.05 AS breach FROM lineitem GROUP BY 1")
def coverage_ratio(spark, d):
    ratio = F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")
    return t.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(ratio, 6).alias("coverage"), (ratio > 0.05).alias("breach"))
