"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regimes, windows as w
from ..operators.ranges import quantiles
from . import tables as t
from .registry import query


def r6(*names: str):
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


_DD = """dd AS (SELECT sid, dt, r, wealth, wealth / max(wealth) OVER p - 1 AS dd, wealth / greatest(1.0, max(wealth) OVER p) - 1 AS dd1
    FROM (SELECT *, product(1 + r) OVER (PARTITION BY sid ORDER BY dt) AS wealth FROM ret_m) WINDOW p AS (PARTITION BY sid ORDER BY dt))"""
_YOY = "yoy AS (SELECT * FROM (SELECT sid, dt, v, 100 * (v / lag(v, 12) OVER (PARTITION BY sid ORDER BY dt) - 1) AS yoy FROM series_m) WHERE yoy IS NOT NULL)"


@query(f"WITH {_YOY} SELECT sid, dt, round(yoy, 6) + 0.0 AS yoy FROM yoy")
def yoy_change(spark, d):
    return w.yoy(t.series_m(spark, d)).select("sid", "dt", *r6("yoy"))


@query(
    """SELECT sid, dt, round(vol, 6) + 0.0 AS vol FROM (SELECT *, CASE WHEN count(*) OVER f >= 6 THEN stddev_samp(r) OVER f * sqrt(12) END AS vol FROM ret_m
    WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS 11 PRECEDING)) WHERE vol IS NOT NULL"""
)
def realized_vol(spark, d):
    return w.realized_vol(t.ret_m(spark, d)).select("sid", "dt", *r6("vol"))


@query(f"WITH {_DD} SELECT sid, dt, round(wealth, 6) AS wealth, round(dd, 6) + 0.0 AS dd FROM dd")
def drawdown_state(spark, d):
    return w.drawdown_state(t.ret_m(spark, d)).select("sid", "dt", *r6("wealth", "dd"))


@query(f"WITH {_DD} SELECT sid, round(-min(dd), 6) + 0.0 AS from_first, round(-min(dd1), 6) + 0.0 AS from_one FROM dd GROUP BY sid")
def max_drawdowns(spark, d):
    r = t.ret_m(spark, d)
    both = w.max_drawdown(r).withColumnRenamed("max_drawdown", "from_first").join(w.max_drawdown(r, from_one=True).withColumnRenamed("max_drawdown", "from_one"), "sid")
    return both.select("sid", *r6("from_first", "from_one"))


@query(
    f"""WITH {_DD}, i AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY dt) AS island FROM dd)
    SELECT sid, min(dt) AS start, round(-min(dd), 6) AS depth, count(*) AS duration FROM i WHERE dd < 0 GROUP BY sid, island"""
)
def drawdown_episodes(spark, d):
    return w.drawdown_episodes(t.ret_m(spark, d)).select("sid", "start", *r6("depth"), "duration")


@query(
    """WITH c AS (SELECT sid, dt, v - lag(v) OVER (PARTITION BY sid ORDER BY dt) AS change FROM series_d),
    s AS (SELECT *, CASE WHEN count(change) OVER f >= 3 THEN stddev_samp(change) OVER f END AS own FROM c WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS 11 PRECEDING)),
    g AS (SELECT *, lag(own) OVER (PARTITION BY sid ORDER BY dt) AS sigma FROM s)
    SELECT sid, dt, round(change, 6) + 0.0 AS change, round(sigma, 6) AS sigma, coalesce(abs(change) > 2 * sigma, false) AS jump FROM g"""
)
def jump_rule(spark, d):
    return w.jumps(t.series_d(spark, d), k=2.0).select("sid", "dt", *r6("change", "sigma"), "jump")


@query(
    """WITH p AS (SELECT sid, dt, ln(last_v / lag(last_v) OVER (PARTITION BY sid ORDER BY dt)) AS ret, ln(high / low) AS sp, ln(last_v / first_v) AS mv FROM series_d WHERE low > 0),
    q AS (SELECT *, sp * sp / (4 * ln(2)) AS pk, 0.5 * sp * sp - (2 * ln(2) - 1) * mv * mv AS gk FROM p)
    SELECT sid, dt, round(CASE WHEN count(ret) OVER f >= 5 THEN stddev_samp(ret) OVER f END, 6) AS vol_close,
           round(CASE WHEN count(ret) OVER f >= 5 THEN sqrt(avg(pk) OVER f) END, 6) AS vol_parkinson,
           round(CASE WHEN count(ret) OVER f >= 5 THEN sqrt(greatest(0.0, avg(gk) OVER f)) END, 6) AS vol_garman_klass
    FROM q WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS 9 PRECEDING)"""
)
def range_volatility(spark, d):
    px = t.series_d(spark, d).where("low > 0").select("sid", "dt", F.col("first_v").alias("open"), "high", "low", F.col("last_v").alias("close"))
    return w.range_vols(px, 10, 5).select("sid", "dt", *r6("vol_close", "vol_parkinson", "vol_garman_klass"))


@query("SELECT sid, dt, round(avg(v) OVER (PARTITION BY sid ORDER BY dt ROWS 23 PRECEDING) - 1000, 4) AS excess FROM series_m")
def trailing_mean_excess(spark, d):
    return w.trailing_excess(t.series_m(spark, d), 24, 1000.0).select("sid", "dt", F.round("excess", 4).alias("excess"))


@query(
    """WITH n AS (SELECT *, (row_number() OVER (PARTITION BY sid ORDER BY dt) - 1) // 12 AS block FROM ret_m)
    SELECT sid, CAST(block AS BIGINT) AS block, round(sum(r), 6) + 0.0 AS s FROM n GROUP BY sid, block HAVING count(*) = 12"""
)
def block_sums(spark, d):
    return w.block_sums(t.ret_m(spark, d), 12).select("sid", F.col("block").cast("long").alias("block"), *r6("s"))


@query(
    """SELECT sid, dt, round(s, 6) + 0.0 AS s FROM (SELECT sid, dt, sum(r) OVER f AS s, count(*) OVER f AS n FROM ret_m
    WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)) WHERE n = 12"""
)
def rolling_origin_sums(spark, d):
    return w.rolling_sums(t.ret_m(spark, d), 12).select("sid", "dt", *r6("s"))


@query(
    """SELECT sid, round(avg(CASE WHEN g <= 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS lost_share FROM (SELECT sid, product(1 + r) OVER f AS g, count(*) OVER f AS n FROM ret_m
    WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS 23 PRECEDING)) WHERE n = 24 GROUP BY sid"""
)
def lost_period_share(spark, d):
    return w.lost_share(t.ret_m(spark, d), 24).select("sid", *r6("lost_share"))


@query(
    f"""WITH {_YOY}, h AS (SELECT *, CASE WHEN yoy >= 0 THEN 1 ELSE 0 END AS hot FROM yoy),
    a AS (SELECT *, CASE WHEN count(*) OVER f = 3 THEN min(hot) OVER f ELSE 0 END AS run FROM h WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    b AS (SELECT *, max(run) OVER (PARTITION BY sid ORDER BY dt ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS era,
          count(*) OVER (PARTITION BY sid ORDER BY dt ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM a)
    SELECT sid, round(avg(CAST(era AS DOUBLE)), 6) + 0.0 AS era_share FROM b WHERE n = 12 GROUP BY sid"""
)
def long_era_share(spark, d):
    return w.era_share(w.yoy(t.series_m(spark, d)), 0.0, 3, 12).select("sid", *r6("era_share"))


@query(
    """SELECT sid, dt, rank() OVER (PARTITION BY sid ORDER BY low) + (count(*) OVER (PARTITION BY sid, low) - 1) / 2.0 AS rank,
    round((rank() OVER (PARTITION BY sid ORDER BY low) + (count(*) OVER (PARTITION BY sid, low) - 1) / 2.0) / (count(*) OVER (PARTITION BY sid) + 1), 6) AS u
    FROM (SELECT sid, dt, round(low, 0) AS low FROM series_d)"""
)
def average_ranks(spark, d):
    rounded = t.series_d(spark, d).select("sid", "dt", F.round("low", 0).alias("low"))
    return w.pseudo_observations(w.average_rank(rounded, "low", ["sid"]), "low", ["sid"]).select("sid", "dt", "rank", *r6("u"))


_LABELS = f"""{_DD}, {_YOY}, lab AS (SELECT d.sid, d.dt, CASE WHEN dd <= -0.25 AND yoy < 0 THEN 'CRI' WHEN yoy < -15 THEN 'REC' WHEN yoy > 15 THEN 'REF' WHEN yoy < 0 THEN 'SLOW' ELSE 'EXP' END AS label
    FROM dd d JOIN yoy y ON d.sid = y.sid AND d.dt = y.dt)"""


def labels(spark, d):
    both = w.drawdown_state(t.ret_m(spark, d)).select("sid", "dt", "dd").join(w.yoy(t.series_m(spark, d)).select("sid", "dt", "yoy"), ["sid", "dt"])
    return both.withColumn("label", regimes.label(dd=F.col("dd"), change=F.col("yoy"), crisis=-0.25, deep=-15.0, hot=15.0))


@query(f"WITH {_LABELS} SELECT sid, label, count(*) AS months, round(min(dt_dd), 6) + 0.0 AS worst FROM (SELECT l.*, d.dd AS dt_dd FROM lab l JOIN dd d ON l.sid = d.sid AND l.dt = d.dt) GROUP BY 1, 2")
def regime_months(spark, d):
    """Monthly series, change on the year, drawdown and label, counted: the flagship."""
    return labels(spark, d).groupBy("sid", "label").agg(F.count(F.lit(1)).alias("months"), F.min("dd").alias("worst")).select("sid", "label", "months", *r6("worst"))


_SPELLS = f"""WITH {_LABELS}, n AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY sid ORDER BY dt) THEN 0 ELSE 1 END AS new FROM lab),
    s AS (SELECT *, sum(new) OVER (PARTITION BY sid ORDER BY dt) AS spell FROM n),
    sp AS (SELECT sid, spell, min(label) AS state, min(dt) AS start, count(*) AS duration, spell = max(spell) OVER (PARTITION BY sid) AS open FROM s GROUP BY sid, spell)"""


@query(f"{_SPELLS} SELECT sid, state, start, duration, open FROM sp")
def regime_spells(spark, d):
    return w.spells(labels(spark, d)).select("sid", "state", "start", "duration", "open")


@query(f"{_SPELLS} SELECT state, count(*) AS spells, round(quantile_cont(duration, 0.5), 6) AS median, round(quantile_cont(duration, 0.9), 6) AS p90 FROM sp WHERE NOT open GROUP BY state")
def regime_durations(spark, d):
    """Durations of complete spells."""
    whole = w.spells(labels(spark, d)).where("NOT open")
    return quantiles(whole, "duration", {"median": 0.5, "p90": 0.9}, ["state"]).select("state", F.col("n").alias("spells"), *r6("median", "p90"))


@query(f"WITH {_LABELS} SELECT previous, label AS next, count(*) AS n FROM (SELECT *, lag(label) OVER (PARTITION BY sid ORDER BY dt) AS previous FROM lab) WHERE previous IS NOT NULL GROUP BY 1, 2")
def regime_transitions(spark, d):
    return w.transitions(labels(spark, d))


@query(
    """WITH m AS (SELECT sid, avg(v) AS mu FROM series_m GROUP BY sid), x AS (SELECT s.sid, dt, v / mu AS q, lag(v / mu) OVER (PARTITION BY s.sid ORDER BY dt) AS p FROM series_m s JOIN m ON s.sid = m.sid)
    SELECT sid, dt, CASE WHEN p < 1 AND q >= 1 THEN 'up' WHEN p >= 1 AND q < 1 THEN 'down' END AS crossing FROM x WHERE (p < 1 AND q >= 1) OR (p >= 1 AND q < 1)"""
)
def level_crossings(spark, d):
    s = t.series_m(spark, d)
    scaled = s.join(s.groupBy("sid").agg(F.avg("v").alias("mu")), "sid").withColumn("v", F.col("v") / F.col("mu"))
    return w.crossings(scaled, 1.0).select("sid", "dt", "crossing")


@query(
    """SELECT sid, dt, round(CASE WHEN n = 12 AND sd > 0 THEN mu END, 6) + 0.0 AS mu, round(CASE WHEN n = 12 AND sd > 0 THEN sd END, 6) AS sigma FROM (
    SELECT sid, dt, avg(r) OVER f AS mu, stddev_pop(r) OVER f AS sd, count(r) OVER f AS n FROM ret_m WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""
)
def preceding_window_stats(spark, d):
    return w.preceding_stats(t.ret_m(spark, d), 12, value="r").select("sid", "dt", *r6("mu", "sigma"))


@query(
    """WITH k AS (SELECT sid, dt FROM series_m WHERE month(dt) % 5 <> 0), n AS (SELECT *, lead(dt) OVER (PARTITION BY sid ORDER BY dt) AS nxt FROM k)
    SELECT sid, CAST(dt + INTERVAL 1 MONTH AS DATE) AS gap_from, CAST(nxt - INTERVAL 1 MONTH AS DATE) AS gap_to, datediff('month', dt, nxt) - 1 AS months FROM n WHERE datediff('month', dt, nxt) > 1"""
)
def gap_ranges(spark, d):
    return w.gap_ranges(t.series_m(spark, d).where(F.month("dt") % 5 != 0))


_Q = "q AS (SELECT sid, CAST(date_trunc('quarter', dt) AS DATE) AS dt, product(1 + r) - 1 AS r FROM ret_m GROUP BY 1, 2)"


def quarters(spark, d):
    return t.ret_m(spark, d).groupBy("sid", F.trunc("dt", "quarter").alias("dt")).agg((F.product(1 + F.col("r")) - 1).alias("r"))


@query(f"WITH {_Q} SELECT sid, dt, round(r, 6) + 0.0 AS r FROM q")
def quarterly_compounding(spark, d):
    return quarters(spark, d).select("sid", "dt", *r6("r"))


@query(
    f"""WITH {_Q} SELECT sid, dt, round(r, 6) + 0.0 AS q1, round(CASE WHEN count(*) OVER f4 = 4 THEN product(1 + r) OVER f4 - 1 END, 6) + 0.0 AS y1,
    round(CASE WHEN count(*) OVER f12 = 12 THEN pow(product(1 + r) OVER f12, 4.0 / 12) - 1 END, 6) + 0.0 AS y3 FROM q
    WINDOW f4 AS (PARTITION BY sid ORDER BY dt ROWS 3 PRECEDING), f12 AS (PARTITION BY sid ORDER BY dt ROWS 11 PRECEDING)"""
)
def trailing_period_returns(spark, d):
    return w.trailing_returns(quarters(spark, d), {"q1": 1, "y1": 4, "y3": 12}, 4).select("sid", "dt", *r6("q1", "y1", "y3"))


@query(
    """SELECT sid, dt, round(CASE WHEN s > 0 THEN v / s END, 6) AS rate FROM (SELECT sid, dt, sum(v) OVER (PARTITION BY sid ORDER BY dt ROWS 3 PRECEDING) AS v,
    sum(v) OVER (PARTITION BY sid ORDER BY dt) AS s FROM series_m)"""
)
def trailing_distribution_rate(spark, d):
    o = w.over()
    s = t.series_m(spark, d)
    rate = F.try_divide(F.sum("v").over(w.rows(o, -3)), F.sum("v").over(o))
    return s.select("sid", "dt", F.round(rate, 6).alias("rate"))


@query(
    """WITH s AS (SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY dt) AS BIGINT) AS m, v FROM series_m), a AS (SELECT sid, m, CASE WHEN m % 12 = 1 THEN v END AS v FROM s),
    k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN m END IGNORE NULLS) OVER b AS x0, first_value(CASE WHEN v IS NOT NULL THEN m END IGNORE NULLS) OVER f AS x1,
          last_value(v IGNORE NULLS) OVER b AS y0, first_value(v IGNORE NULLS) OVER f AS y1 FROM a
          WINDOW b AS (PARTITION BY sid ORDER BY m ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY sid ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT sid, m, round(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (m - x0) / (x1 - x0) END, 4) AS filled FROM k"""
)
def annual_anchor_interpolation(spark, d):
    s = t.series_m(spark, d).select("sid", F.row_number().over(w.over()).cast("long").alias("m"), "v")
    anchors = s.withColumn("v", F.when(F.col("m") % 12 == 1, F.col("v")))
    return w.interpolate(anchors).select("sid", "m", F.round("filled", 4).alias("filled"))
