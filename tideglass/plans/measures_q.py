"""Queries of scalar functions and of measures of ensembles, panels and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import checks as ck, joins as jn, measures as ms, regimes, windows as w
from ..operators.ranges import quantiles
from . import tables as t
from .registry import query
from .windows_q import r6


@query("SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def java_quarters(spark, d):
    """Quarters read from dates as Java prints them."""
    text = F.date_format("o_orderdate", "EEE MMM dd HH:mm:ss 'UTC' yyyy")
    return t.read(spark, d, "orders").groupBy(sc.java_date_quarter(text).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def year_months(spark, d):
    return t.read(spark, d, "orders").groupBy(sc.year_month(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slugs(spark, d):
    return t.read(spark, d, "part").select("p_partkey", sc.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@query(
    """SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN NULL ELSE '{"t": ' || turn || ', "u": {"v": 1}}' END AS body FROM conversations"""
)
def fenced_json(spark, d):
    """Objects taken from answers with and without a code fence, and none from text that has no object."""
    body = F.concat(F.lit('{"t": '), F.col("turn").cast("string"), F.lit(', "u": {"v": 1}}'))
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" ```json\n"), body, F.lit("\n```\n"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" so."))).otherwise("no } object {")
    return t.read(spark, d, "conversations").select("conv_id", "turn", sc.outer_json(said).alias("body"))


@query("""SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events""")
def canonical_digests(spark, d):
    return t.read(spark, d, "events").select("event_id", F.sha2(sc.canonical_json(["user_id", "event_type", "event_id"]), 256).alias("digest"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'https://u.example/' || o_orderkey WHEN '2-HIGH' THEN 'https://h.example/all' END AS link FROM orders""")
def source_links(spark, d):
    templates = {"1-URGENT": "https://u.example/{code}", "2-HIGH": "https://h.example/all"}
    return t.read(spark, d, "orders").select("o_orderkey", sc.linked(F.col("o_orderpriority"), F.col("o_orderkey").cast("string"), templates).alias("link"))


@query("SELECT c_custkey, format('{:,.1f}', CAST(round(CAST(c_acctbal AS DECIMAL(18, 2)), 1) AS DOUBLE)) AS money FROM customer")
def money_values(spark, d):
    return t.read(spark, d, "customer").select("c_custkey", sc.money(F.col("c_acctbal")).alias("money"))


@query(
    """SELECT sid, dt, round(ln(1 + r), 6) + 0.0 AS log_growth, round(greatest(10 * r, 0) + ln(1 + exp(-abs(10 * r))), 6) + 0.0 AS soft,
    round(least(1.3, greatest(0.3, exp(-1.5 * abs(r) - 0.4 * ln(1.0 + r)))), 6) + 0.0 AS dist, round(least(1.2, greatest(0.5, 1 - 0.8 * abs(r))), 6) + 0.0 AS call FROM ret_m"""
)
def factor_transforms(spark, d):
    """Unconstrained coordinates and bounded responses of returns."""
    r = F.col("r")
    cols = [F.log1p(r).alias("log_growth"), sc.softplus(10 * r).alias("soft"), sc.distribution_response(F.abs(r), 1 + r, 1.5, 0.4, 0.3, 1.3).alias("dist"), sc.call_response(F.abs(r), 0.8).alias("call")]
    return t.ret_m(spark, d).select("sid", "dt", *cols).select("sid", "dt", *r6("log_growth", "soft", "dist", "call"))


@query("SELECT sid, dt, shift, greatest(5.0, 25.0 * pow(0.5, shift)) AS percentile FROM (SELECT sid, dt, count(*) FILTER (r < -0.1) OVER (PARTITION BY sid ORDER BY dt) AS shift FROM ret_m)")
def halved_percentiles(spark, d):
    """Where a month's entry percentile stands after the falls of its series so far."""
    shift = F.count_if(F.col("r") < -0.1).over(w.rows(w.over(), Window.unboundedPreceding))
    return t.ret_m(spark, d).withColumn("shift", shift).select("sid", "dt", "shift", sc.halved(25.0, F.col("shift")).alias("percentile"))


_PROXY = "p AS (SELECT sid, CASE WHEN month(dt) IN (1, 2) THEN 'winter' WHEN year(dt) < 1996 THEN 'early' END AS rule, count(*) OVER (PARTITION BY sid) AS n FROM series_m)"


@query(
    f"""WITH {_PROXY} SELECT sid, rule, count(*) AS n, round(count(*) / max(n), 6) AS share FROM p WHERE rule IS NOT NULL GROUP BY sid, rule
    UNION ALL SELECT sid, 'all', count(rule), round(count(rule) / max(n), 6) FROM p GROUP BY sid"""
)
def proxy_shares(spark, d):
    rule = F.when(F.month("dt").isin(1, 2), "winter").when(F.year("dt") < 1996, "early")
    return ms.proxy_share(t.series_m(spark, d), "sid", rule.isNotNull(), rule).select("sid", "rule", "n", F.round("share", 6).alias("share"))


@query(
    """WITH f AS (SELECT CASE WHEN month(dt) = 3 THEN 'error' ELSE 'warning' END AS severity, v < 5000000 AS passed FROM series_m)
    SELECT severity, passed, count(*) AS n FROM f GROUP BY 1, 2"""
)
def finding_counts(spark, d):
    """Findings by severity and outcome."""
    f = t.series_m(spark, d).select(F.when(F.month("dt") == 3, "error").otherwise("warning").alias("severity"), (F.col("v") < 5e6).alias("passed"))
    return f.groupBy("severity", "passed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1")
def action_rates(spark, d):
    """Share of records that act, by arm."""
    return t.read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("rate"))


@query(
    """WITH g AS (SELECT sid, dt, product(1 + r) OVER (PARTITION BY sid ORDER BY dt) AS wl FROM ret_m), s AS (SELECT sid, dt, wl / max(wl) OVER (PARTITION BY sid ORDER BY dt) - 1 AS dd FROM g)
    SELECT sid, dt, round(greatest(0.0, least(1.0, dd / -0.5)), 6) + 0.0 AS state FROM s"""
)
def floored_drawdowns(spark, d):
    return ms.floored_drawdown(t.ret_m(spark, d), -0.5, "sid", "dt", "r").select("sid", "dt", *r6("state"))


@query(
    """WITH q AS (SELECT path, m // 3 AS q, sum(r) AS s FROM ensemble GROUP BY 1, 2 HAVING count(*) = 3), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s, q) AS i FROM q)
    SELECT path, CAST(q AS BIGINT) AS worst, CAST(abs(q - 10) AS BIGINT) AS error FROM k WHERE i = 1"""
)
def worst_quarters(spark, d):
    """Each path's worst quarter, and its distance from the one asked for."""
    return ms.worst_period(t.ensemble(spark, d), "path", "m", "r", 3, 10).select("path", F.col("worst").cast("long").alias("worst"), F.col("error").cast("long").alias("error"))


@query("SELECT path, round((abs(min_by(g, m) - 0.001) + abs(max_by(g, m) + 0.002)) / 2, 6) + 0.0 AS error FROM ensemble GROUP BY path")
def endpoint_errors(spark, d):
    return ms.endpoint_error(t.ensemble(spark, d), "path", "m", "g", 0.001, -0.002).select("path", *r6("error"))


@query("SELECT path, round(abs(avg(g) * 1200 - 2.0), 6) + 0.0 AS error FROM ensemble GROUP BY path")
def inflation_errors(spark, d):
    """Distance of each path's mean from a target."""
    return t.ensemble(spark, d).groupBy("path").agg(F.abs(F.avg("g") * 1200 - 2.0).alias("error")).select("path", *r6("error"))


@query("SELECT count(*) AS n, CASE WHEN count(*) >= 60 AND count(*) FILTER (a IS NULL OR b IS NULL) = 0 THEN round(avg(a - b), 2) END AS mean FROM wide_m")
def term_premium(spark, d):
    """Mean spread of two series, given enough finite months."""
    return ms.mean_if_enough(t.wide_m(spark, d), F.col("a") - F.col("b"), 60).select("n", F.round("mean", 2).alias("mean"))


@query("SELECT 'r' AS factor, count(*) FILTER (r < -0.002) AS n FROM ensemble UNION ALL SELECT 'g', count(*) FILTER (g < 0) FROM ensemble")
def floor_violations(spark, d):
    return ms.floor_violations(t.ensemble(spark, d), {"r": -0.002, "g": 0.0})


@query(
    """WITH y AS (SELECT sid, dt, v, 100 * (v / lag(v, 12) OVER (PARTITION BY sid ORDER BY dt) - 1) AS yoy FROM series_m)
    SELECT sid, count(yoy) AS n, round(sqrt(avg(pow(v / 1e6 - (0.75 + 2.0 + 0.5 * (yoy - 2.0)), 2))), 6) AS rmse FROM y WHERE yoy IS NOT NULL GROUP BY sid"""
)
def anchor_deviations(spark, d):
    return ms.anchor_deviation(w.yoy(t.series_m(spark, d)), "sid", F.col("v") / 1e6, F.col("yoy")).select("sid", "n", *r6("rmse"))


@query(
    """SELECT l_suppkey, count(*) AS sales, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * l_discount ELSE 0 END) / 1000, 6) AS cost FROM lineitem GROUP BY 1"""
)
def forced_sale_costs(spark, d):
    """Sales and the haircut cost of forced ones over a reference value."""
    cost = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * F.col("l_discount")).otherwise(0)) / 1000
    return t.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("sales"), F.round(cost, 6).alias("cost"))


@query(
    """WITH p AS (SELECT path, max(r) AS top, count(*) FILTER (r > 0.0004) AS breaches, max_by(g, m) AS last FROM ensemble GROUP BY path)
    SELECT count(*) AS paths, round(avg(CASE WHEN top >= 0.001 THEN 1.0 ELSE 0.0 END), 6) AS shortfall, max(breaches) AS longest, round(quantile_cont(last, 0.01), 8) + 0.0 AS tail FROM p"""
)
def liquidity_measures(spark, d):
    """Share of paths that ever reach a threshold, the most periods above a limit, and the tail of terminal values."""
    p = t.ensemble(spark, d).groupBy("path").agg(F.max("r").alias("top"), F.count_if(F.col("r") > 0.0004).alias("breaches"), F.max_by("g", "m").alias("last"))
    share = F.avg(F.when(F.col("top") >= 0.001, 1.0).otherwise(0.0))
    one = p.agg(F.count(F.lit(1)).alias("paths"), F.round(share, 6).alias("shortfall"), F.max("breaches").alias("longest"))
    return one.crossJoin(F.broadcast(quantiles(p, "last", {"tail": 0.01}))).select("paths", "shortfall", "longest", (F.round("tail", 8) + F.lit(0.0)).alias("tail"))


@query("SELECT path, m // 12 AS year, min(m) AS first, max(m) AS last, count(*) AS months, count(*) FILTER (m % 12 = 11) AS yearly, count(*) FILTER (m % 3 = 2) AS quarterly FROM ensemble GROUP BY 1, 2")
def decision_calendar(spark, d):
    """Years of each path, the last of them maybe short, and the months in which yearly and quarterly decisions fall."""
    m = F.col("m")
    e = t.ensemble(spark, d).groupBy("path", F.floor(m / 12).alias("year"))
    return e.agg(F.min(m).alias("first"), F.max(m).alias("last"), F.count(F.lit(1)).alias("months"), F.count_if(m % 12 == 11).alias("yearly"), F.count_if(m % 3 == 2).alias("quarterly"))


@query(
    """WITH k AS (SELECT sid, dt FROM series_m WHERE month(dt) % 5 <> 0), c AS (SELECT sid, count(DISTINCT dt) AS months, date_diff('month', min(dt), max(dt)) + 1 AS spanned FROM k GROUP BY sid)
    SELECT sid, months, spanned, round(months / spanned, 6) AS share FROM c"""
)
def month_coverage(spark, d):
    return ms.coverage(t.series_m(spark, d).where("month(dt) % 5 <> 0"), "sid", "dt").select("sid", "months", "spanned", *r6("share"))


_REQUIRED = "(VALUES ('1-URGENT', 'x', 'auto', 30), ('2-HIGH', 'x', 'auto', 400), ('3-MEDIUM', 'y', 'auto', 30), ('4-NONE', 'x', 'auto', 30), ('5-LOW', 'x', 'manual', 30)) AS q(sid, source, intake, sla)"


def _required(spark):
    rows = [("1-URGENT", "x", "auto", 30), ("2-HIGH", "x", "auto", 400), ("3-MEDIUM", "y", "auto", 30), ("4-NONE", "x", "auto", 30), ("5-LOW", "x", "manual", 30)]
    return spark.createDataFrame(rows, "sid string, source string, intake string, sla_days int")


@query(
    f"""WITH h AS (SELECT sid, max(dt) AS last FROM series_m GROUP BY sid), j AS (SELECT q.sid, source, CASE WHEN last IS NULL THEN 'missing' WHEN DATE '2001-12-15' - last_day(last) > sla THEN 'stale' END AS reason
    FROM {_REQUIRED} LEFT JOIN h ON q.sid = h.sid WHERE intake = 'auto' AND source = 'x') SELECT * FROM j WHERE reason IS NOT NULL"""
)
def refresh_plan(spark, d):
    """Required series that are missing or too old."""
    held = t.series_m(spark, d).groupBy("sid").agg(F.max("dt").alias("last"))
    return ms.refresh_plan(_required(spark), held, "2001-12-15", ["x"])


@query(
    f"""WITH n AS (SELECT sid, count(*) AS rows, max(dt) AS last, count(*) FILTER (v > 20000000 OR v <= 0) AS bad FROM series_m GROUP BY sid)
    SELECT q.sid, coalesce(rows, 0) AS rows, CASE WHEN rows IS NULL THEN 'absent' WHEN bad > 0 THEN 'quarantined' ELSE 'written' END AS outcome FROM {_REQUIRED} LEFT JOIN n ON q.sid = n.sid"""
)
def quarantine_gate(spark, d):
    """A fetched series is written only if no rule fails; required ones that didn't come are absent."""
    s = t.series_m(spark, d)
    bad = ck.series_findings(s, high=2e7, positive=True).where("NOT passed AND rule IN ('bounds_high', 'positive')").select("sid").distinct().withColumn("bad", F.lit(True))
    n = s.groupBy("sid").agg(F.count(F.lit(1)).alias("rows"))
    out = _required(spark).join(n, "sid", "left").join(bad, "sid", "left")
    return out.select("sid", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows").isNull(), "absent").when(F.col("bad"), "quarantined").otherwise("written").alias("outcome"))


@query(
    f"""WITH s AS (SELECT sid, dt FROM series_m WHERE NOT (sid = '2-HIGH' AND month(dt) IN (5, 6))), n AS (SELECT *, lead(dt) OVER (PARTITION BY sid ORDER BY dt) AS nx FROM s),
    g AS (SELECT sid, count(*) FILTER (date_diff('month', dt, nx) > 1) AS gaps, min(dt) AS first, max(dt) AS last FROM n GROUP BY sid)
    SELECT q.sid, first, last, coalesce(gaps, 0) AS gaps, CASE WHEN last IS NULL THEN 'absent' WHEN gaps > 0 THEN 'gaps' ELSE 'whole' END AS status FROM {_REQUIRED} LEFT JOIN g ON q.sid = g.sid"""
)
def gap_register(spark, d):
    """Every required series with its span and the number of its gaps."""
    s = t.series_m(spark, d).where("NOT (sid = '2-HIGH' AND month(dt) IN (5, 6))")
    gaps = w.gap_ranges(s).groupBy("sid").agg(F.count(F.lit(1)).alias("gaps"))
    span = s.groupBy("sid").agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    out = _required(spark).join(span, "sid", "left").join(gaps, "sid", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    return out.select("sid", "first", "last", "gaps", F.when(F.col("last").isNull(), "absent").when(F.col("gaps") > 0, "gaps").otherwise("whole").alias("status"))


_SEVEN = """s AS (SELECT sid, dt, v, 100 * (v / lag(v, 12) OVER (PARTITION BY sid ORDER BY dt) - 1) AS growth, 100 * (v / lag(v, 3) OVER (PARTITION BY sid ORDER BY dt) - 1) AS cpi FROM series_m),
    x AS (SELECT r.sid, r.dt, product(1 + r) OVER (PARTITION BY r.sid ORDER BY r.dt) AS wl FROM ret_m r), y AS (SELECT sid, dt, wl / max(wl) OVER (PARTITION BY sid ORDER BY dt) - 1 AS dd FROM x),
    f AS (SELECT s.sid, s.dt, growth, cpi, dd, CASE WHEN month(s.dt) IN (2, 9) THEN 1 ELSE 0 END AS rec FROM s JOIN y ON s.sid = y.sid AND s.dt = y.dt WHERE growth IS NOT NULL),
    lab AS (SELECT *, CASE WHEN rec >= 0.5 AND dd <= -0.2 THEN 'CRI' WHEN rec >= 0.5 THEN 'REC' WHEN cpi >= 4.0 AND growth <= 0.0 THEN 'STAG' WHEN cpi >= 4.0 AND growth > 1.5 THEN 'REF'
                          WHEN growth <= 0.0 THEN 'REC' WHEN growth < 1.5 THEN 'SLOW' ELSE 'EXP' END AS label FROM f)"""


def seven_labels(spark, d):
    s = t.series_m(spark, d)
    both = w.yoy(s).withColumnRenamed("yoy", "growth").join(w.yoy(s, 3).select("sid", "dt", F.col("yoy").alias("cpi")), ["sid", "dt"])
    both = both.join(w.drawdown_state(t.ret_m(spark, d)).select("sid", "dt", "dd"), ["sid", "dt"])
    rec = F.when(F.month("dt").isin(2, 9), 1).otherwise(0)
    return both.withColumn("label", regimes.seven(rec, F.col("cpi"), F.col("growth"), F.col("dd"), F.lit(None).cast("double")))


@query(f"WITH {_SEVEN} SELECT sid, label, count(*) AS months FROM lab GROUP BY 1, 2")
def seven_regimes(spark, d):
    """Months by regime, from recession flags, inflation, growth and drawdown; spreads are missing."""
    return seven_labels(spark, d).groupBy("sid", "label").agg(F.count(F.lit(1)).alias("months"))


@query(f"WITH {_SEVEN} SELECT sid, CASE WHEN label IN ('REC', 'CRI') THEN 0 ELSE 2 END + CASE WHEN cpi > 4.0 THEN 1 ELSE 0 END AS quadrant, count(*) AS months FROM lab GROUP BY 1, 2")
def panel_quadrants(spark, d):
    return seven_labels(spark, d).groupBy("sid", ms.quadrant(F.col("label"), F.col("cpi"), 4.0).alias("quadrant")).agg(F.count(F.lit(1)).alias("months"))


@query(
    """WITH m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM ret_w)
    SELECT dt, round((a - ma) / sa - (b - mb) / sb - (c - mc) / sc, 6) + 0.0 AS score FROM ret_w, m"""
)
def severity_scores(spark, d):
    """Lower is more severe: falls of one series and rises of two others."""
    return ms.z_scores(t.ret_w(spark, d), {"a": 1, "b": -1, "c": -1}).select("dt", *r6("score"))


@query(
    """WITH w AS (SELECT path, sum(r) FILTER (m < 40) - sum(r) FILTER (m >= 40) AS d FROM ensemble GROUP BY path), k AS (SELECT count(d) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM w)
    SELECT n, round(mean, 8) + 0.0 AS mean, round(sd, 8) AS sd, coalesce(mean < 0 AND abs(mean) > sd, false) AS beaten FROM k"""
)
def pooled_differences(spark, d):
    part = lambda c: F.sum(F.when(c, F.col("r")))
    diffs = t.ensemble(spark, d).groupBy("path").agg((part(F.col("m") < 40) - part(F.col("m") >= 40)).alias("d"))
    return ms.pooled_difference(diffs, "d").select("n", (F.round("mean", 8) + F.lit(0.0)).alias("mean"), F.round("sd", 8).alias("sd"), "beaten")


@query(
    """WITH b AS (SELECT dt, v FROM series_m WHERE sid = '1-URGENT' AND dt >= DATE '1997-01-01'), o AS (SELECT dt, v FROM series_m WHERE sid = '2-HIGH'),
    k AS (SELECT avg(b.v - o.v) AS s, stddev_pop(b.v - o.v) AS e FROM b JOIN o ON b.dt = o.dt)
    SELECT dt, round(v, 2) AS v, 'base' AS part, CAST(NULL AS DOUBLE) AS rmse FROM b UNION ALL SELECT dt, round(v + s, 2), 'older', round(e, 2) FROM o, k WHERE dt < (SELECT min(dt) FROM b)"""
)
def chained_series(spark, d):
    """A series put in front of another at its level."""
    s = t.series_m(spark, d)
    out = ms.chained(s.where("sid = '1-URGENT' AND dt >= DATE '1997-01-01'").select("dt", "v"), s.where("sid = '2-HIGH'").select("dt", "v"))
    return out.select("dt", F.round("v", 2).alias("v"), "part", F.round("rmse", 2).alias("rmse"))


@query(
    """WITH x AS (SELECT dt, a AS spot, ln(1 + b) AS idx, a + c AS total FROM ret_w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)
    SELECT count(*) AS n, round(corr(spot, idx), 6) + 0.0 AS correlation, round(avg(total), 6) + 0.0 AS mean_total FROM x"""
)
def return_cross_check(spark, d):
    """Excess plus risk-free returns, and the correlation of one return with an index's log change."""
    x = t.ret_w(spark, d).dropna(subset=["a", "b", "c"])
    out = x.agg(F.count(F.lit(1)).alias("n"), F.corr(F.col("a"), F.log1p("b")).alias("correlation"), F.avg(F.col("a") + F.col("c")).alias("mean_total"))
    return out.select("n", *r6("correlation", "mean_total"))


@query("SELECT dt, round(exp(avg(ln(v))), 2) AS index, count(*) AS n FROM series_m GROUP BY dt")
def geometric_index(spark, d):
    return ms.geometric_index(t.series_m(spark, d), "dt", "v").select("dt", F.round("index", 2).alias("index"), "n")


_METRICS = "avg(r) AS mean, stddev_samp(r) AS sd, min(r) AS low, max(r) AS high, CAST(count(*) FILTER (r < 0) AS DOUBLE) / count(*) AS loss_share"


@query(
    f"""WITH m AS (SELECT sid, {_METRICS} FROM ret_m WHERE year(dt) >= 1998 GROUP BY sid), h AS (SELECT year(dt) AS y, {_METRICS} FROM ret_m WHERE year(dt) < 1998 GROUP BY 1),
    hl AS (UNPIVOT h ON mean, sd, low, high, loss_share INTO NAME metric VALUE x), b AS (SELECT metric, min(x) AS lo, max(x) AS hi FROM hl WHERE metric <> 'low' GROUP BY metric),
    l AS (UNPIVOT m ON mean, sd, low, high, loss_share INTO NAME metric VALUE value)
    SELECT l.sid, l.metric, round(value, 6) + 0.0 AS value, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, CASE WHEN lo IS NULL OR lo = hi THEN 'unbanded' WHEN value BETWEEN lo AND hi THEN 'pass' ELSE 'fail' END AS verdict
    FROM l LEFT JOIN b ON l.metric = b.metric"""
)
def battery_report(spark, d):
    """Metrics of each series since 1998 against the bands of the years before, as a report with verdicts."""
    r = t.ret_m(spark, d)
    metrics = {"mean": F.avg("r"), "sd": F.stddev_samp("r"), "low": F.min("r"), "high": F.max("r"), "loss_share": F.count_if(F.col("r") < 0) / F.count(F.lit(1))}
    old = r.where("year(dt) < 1998").groupBy(F.year("dt").alias("y")).agg(*[c.alias(m) for m, c in metrics.items()])
    long = old.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("e")).select("e.*")
    bands = long.where("metric <> 'low'").groupBy("metric").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    out = ms.battery(r.where("year(dt) >= 1998"), "sid", metrics, bands)
    return out.select("sid", "metric", *r6("value", "lo", "hi"), "verdict")


@query(
    """WITH k AS (SELECT l_suppkey, sum(l_extendedprice * l_tax) AS pocketed FROM lineitem GROUP BY 1) SELECT l_suppkey, round(pocketed * 0.6, 2) AS payout, CAST(0 AS DOUBLE) AS pocketed FROM k"""
)
def side_pockets(spark, d):
    """What was set aside is paid out at a recovery rate, and nothing stays."""
    k = t.read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("p"))
    return k.select("l_suppkey", F.round(F.col("p") * 0.6, 2).alias("payout"), F.lit(0.0).alias("pocketed"))


@query(
    """WITH p AS (SELECT c_custkey, abs(c_acctbal) AS amount, 0.02 + (c_custkey % 7) * 0.005 AS y, (c_custkey % 5 - 2) * 0.01 AS dy FROM customer),
    v AS (SELECT *, list_sum(list_transform(range(1, 31), lambda i: amount / pow(1 + y, i))) AS before, list_sum(list_transform(range(1, 31), lambda i: amount / pow(1 + y + dy, i))) AS "after" FROM p)
    SELECT c_custkey, round("after" - before, 2) + 0.0 AS change, round(0.7 * ("after" - before), 2) + 0.0 AS hedge, round(-0.7 * ("after" - before), 2) + 0.0 AS margin FROM v"""
)
def rate_shocks(spark, d):
    """A shift of the discount rate: liabilities, the hedge's gain and the margin it calls."""
    from ..operators.portfolio import present_value

    y, dy = 0.02 + (F.col("c_custkey") % 7) * 0.005, (F.col("c_custkey") % 5 - 2) * 0.01
    amount = F.abs("c_acctbal")
    p = t.read(spark, d, "customer").select("c_custkey", (present_value(amount, y + dy, 30) - present_value(amount, y, 30)).alias("x"))
    two = lambda c, name: (F.round(c, 2) + F.lit(0.0)).alias(name)
    return p.select("c_custkey", two(F.col("x"), "change"), two(0.7 * F.col("x"), "hedge"), two(-0.7 * F.col("x"), "margin"))


@query(
    """SELECT event_id, near_id FROM (SELECT x.event_id, y.event_id AS near_id FROM events x JOIN events y ON x.event_id % 100 = 0 AND x.event_id <> y.event_id AND abs(x.value - y.value) <= 0.05 AND abs(day(x.ts) - day(y.ts)) <= 1)"""
)
def tolerance_join(spark, d):
    """Every hundredth event is asked about; all others are candidates."""
    e = t.read(spark, d, "events").select("event_id", F.col("value").alias("v"), F.dayofmonth("ts").cast("double").alias("g"))
    return jn.within_tolerance(e.where("event_id % 100 = 0"), e, {"v": 0.05, "g": 1.0}, "event_id", "near_id").where("event_id <> near_id")
