"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as ck
from . import tables as t
from .registry import query


@query(
    """WITH k AS (SELECT sid, dt, v FROM series_m WHERE month(dt) <> 3 UNION ALL SELECT sid, dt, v FROM series_m WHERE sid = '2-HIGH' AND dt = DATE '1996-05-01'),
    s AS (SELECT *, (year(dt) * 12 + month(dt)) - lag(year(dt) * 12 + month(dt)) OVER (PARTITION BY sid ORDER BY dt) AS step, v - lag(v) OVER (PARTITION BY sid ORDER BY dt) AS ch FROM k),
    o AS (SELECT *, CASE WHEN count(ch) OVER f >= 3 THEN stddev_samp(ch) OVER f END AS own FROM s WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS 11 PRECEDING)),
    g AS (SELECT *, lag(own) OVER (PARTITION BY sid ORDER BY dt) AS sigma FROM o),
    c AS (SELECT sid, count(*) FILTER (step = 0) AS no_duplicates, count(*) FILTER (step > 1) AS frequency, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (abs(ch) > 2 * sigma) AS jump,
          count(*) FILTER (v < 2000000) AS bounds_low, count(*) FILTER (v > 20000000) AS bounds_high, count(*) FILTER (v <= 0) AS positive FROM g GROUP BY sid)
    SELECT sid, rule, n, n = 0 AS passed FROM (UNPIVOT c ON no_duplicates, frequency, missing, jump, bounds_low, bounds_high, positive INTO NAME rule VALUE n)"""
)
def series_findings(spark, d):
    s = t.series_m(spark, d)
    twice = s.where("sid = '2-HIGH' AND dt = DATE '1996-05-01'")
    return ck.series_findings(s.where("month(dt) <> 3").unionByName(twice), low=2e6, high=2e7, positive=True, jump_k=2.0)


@query("SELECT sid, max(dt) AS last, CAST(DATE '2001-12-15' - last_day(max(dt)) AS INTEGER) AS age, CAST(DATE '2001-12-15' - max(dt) AS INTEGER) AS label_age, DATE '2001-12-15' - last_day(max(dt)) <= 120 AS fresh FROM series_m GROUP BY sid")
def staleness(spark, d):
    return ck.staleness(t.series_m(spark, d), "2001-12-15", 120)


@query("SELECT dt, a, b FROM wide_m WHERE a < b - 1e-9")
def ordering_identity(spark, d):
    s = t.series_m(spark, d)
    return ck.cross_identity(s.where("sid = '1-URGENT'"), s.where("sid = '2-HIGH'")).select("dt", "a", "b")


@query(
    """WITH f AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS ret, CAST(user_id AS VARCHAR) AS who FROM events)
    SELECT 'non_numeric' AS kind, 'ret' AS "column", count(*) AS n FROM f WHERE ret IS NOT NULL AND TRY_CAST(ret AS DOUBLE) IS NULL HAVING count(*) > 0
    UNION ALL SELECT 'out_of_bounds', 'ret', count(*) FROM f WHERE TRY_CAST(ret AS DOUBLE) < 1 OR TRY_CAST(ret AS DOUBLE) > 100 HAVING count(*) > 0
    UNION ALL SELECT 'out_of_bounds', 'who', count(*) FROM f WHERE TRY_CAST(who AS DOUBLE) < 1 OR TRY_CAST(who AS DOUBLE) > 100 HAVING count(*) > 0"""
)
def intake_violations(spark, d):
    e = t.read(spark, d, "events")
    text = e.select(F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("ret"), F.col("user_id").cast("string").alias("who"))
    return ck.intake_violations(text, [("ret", 1.0, 100.0), ("who", 1.0, 100.0)])


@query(
    """WITH k AS (SELECT user_id, day(ts) AS o, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2), s AS (SELECT *, o - lag(o) OVER (PARTITION BY user_id ORDER BY o) AS st FROM k)
    SELECT user_id, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (st > 1) AS gaps FROM s GROUP BY user_id"""
)
def period_violations(spark, d):
    return ck.period_violations(t.read(spark, d, "events").where("event_type = 'click'"), "user_id", F.dayofmonth("ts"))


@query(
    """WITH s AS (SELECT o_custkey AS k, CAST(month(o_orderdate) * 4 AS BIGINT) AS lo, CAST(month(o_orderdate) * 4 + 3 AS BIGINT) AS hi FROM orders GROUP BY ALL),
    b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 3) + 1 <> lo AS bad FROM s)
    SELECT k, count(*) FILTER (coalesce(bad, false)) AS breaks, max(hi) AS last FROM (SELECT k, lo - 4 AS lo, hi - 4 AS hi, bad FROM b) GROUP BY k HAVING count(*) FILTER (bad) > 0 OR max(hi) <> 47"""
)
def tiling_faults(spark, d):
    month = F.month("o_orderdate").cast("long") * 4
    s = t.read(spark, d, "orders").select(F.col("o_custkey").alias("k"), (month - 4).alias("lo"), (month - 1).alias("hi")).distinct()
    return ck.tiling_faults(s, "k", "lo", "hi", 48)


@query("SELECT l_orderkey, l_linenumber, greatest(0.0, least(l_discount, 0.08)) AS clamped, l_discount > 0.08 AS was_clamped FROM lineitem")
def clamped_values(spark, d):
    """Values held to declared bounds, with the audit flag."""
    disc = F.col("l_discount")
    return t.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.lit(0.0), F.least(disc, F.lit(0.08))).alias("clamped"), (disc > 0.08).alias("was_clamped"))
