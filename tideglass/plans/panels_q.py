"""Queries over panels: derived series, regressions, distances to a reference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derived, extend as ex, hazard as hz, regression as reg, support as sup, windows as w
from . import tables as t
from .registry import query
from .windows_q import r6

#: Three levels over the priorities' months: read, combined, and derived from combinations.
DECLARED = {
    "urgent": {"kind": "series", "series": "1-URGENT", "units": "usd"},
    "high": {"kind": "series", "series": "2-HIGH", "units": "usd"},
    "medium": {"kind": "series", "series": "3-MEDIUM", "units": "usd"},
    "nobody": {"kind": "unavailable", "reason": "no source"},
    "gap": {"kind": "derived", "expr": "difference", "inputs": ["urgent", "high"], "units": "usd"},
    "mean": {"kind": "derived", "expr": "average", "inputs": ["urgent", "high", "medium"]},
    "share": {"kind": "derived", "expr": "ratio", "inputs": ["gap", "mean"], "units": "1"},
    "pace": {"kind": "derived", "expr": "growth", "inputs": ["mean"], "params": {"rows": 12}},
    "own_pace": {"kind": "derived", "expr": "growth", "inputs": ["urgent"], "params": {"rows": 12}},
    "excess": {"kind": "derived", "expr": "difference", "inputs": ["own_pace", "pace"], "units": "pct"},
    "calm": {"kind": "derived", "expr": "trailing_mean", "inputs": ["excess"], "params": {"rows": 3}},
    "level": {"kind": "derived", "expr": "demeaned_log", "inputs": ["mean"], "units": "log"},
    "longest": {"kind": "derived", "expr": "spliced", "inputs": ["nobody", "high"], "params": {"a": 100.0, "b": 0.5}},
    "lost": {"kind": "derived", "expr": "add", "inputs": ["urgent", "nobody"]},
}
_PANEL = """
WITH w AS (SELECT dt, max(v) FILTER (sid = '1-URGENT') AS urgent, max(v) FILTER (sid = '2-HIGH') AS high, max(v) FILTER (sid = '3-MEDIUM') AS medium FROM series_m WHERE sid <= '3-MEDIUM' GROUP BY dt),
one AS (SELECT *, urgent - high AS gap, (urgent + high + medium) / 3 AS mean FROM w),
two AS (SELECT *, gap / mean AS share, 100 * (mean / lag(mean, 12 IGNORE NULLS) OVER (ORDER BY dt) - 1) AS pace, 100 * (urgent / lag(urgent, 12 IGNORE NULLS) OVER (ORDER BY dt) - 1) AS own_pace,
               ln(mean) - avg(ln(mean)) OVER () AS level, 100 + 0.5 * high AS longest FROM one),
three AS (SELECT *, own_pace - pace AS excess FROM two),
four AS (SELECT *, (excess + lag(excess, 1 IGNORE NULLS) OVER (ORDER BY dt) + lag(excess, 2 IGNORE NULLS) OVER (ORDER BY dt)) / 3 AS calm FROM three),
long AS (UNPIVOT four ON COLUMNS(* EXCLUDE (dt)) INTO NAME name VALUE v)
"""


def _wide(spark, d):
    of = derived.graph(DECLARED)
    return of, derived.panel(t.series_m(spark, d), of)


@query(_PANEL + "SELECT name, dt, round(v, 6) + 0.0 AS v FROM long")
def derived_panel(spark, d):
    of, wide = _wide(spark, d)
    return derived.stacked(wide, of.order).select("name", "dt", (F.round("v", 6) + 0.0).alias("v"))


_TOLD = [(n, derived.graph(DECLARED).depth(n), derived.graph(DECLARED).units.get(n), derived.graph(DECLARED).absent.get(n)) for n in DECLARED]
_TOLD_SQL = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in _TOLD)


@query(
    _PANEL
    + f""", told(name, depth, units, why) AS (VALUES {_TOLD_SQL})
SELECT told.name, CAST(depth AS INTEGER) AS depth, units, count(v) AS rows, min(dt) AS first, max(dt) AS last, CASE WHEN count(v) = 0 THEN coalesce(why, 'no rows') END AS missing
FROM told LEFT JOIN long ON long.name = told.name GROUP BY ALL ORDER BY 1""".replace("GROUP BY ALL", "GROUP BY told.name, depth, units, why")
)
def derived_coverage(spark, d):
    of, wide = _wide(spark, d)
    return derived.coverage(wide, of)


#: Daily closes are a priority's orders of the day; features of 5, 15 and 40 rows.
WINDOWS, DRAWDOWN, LEAST_DAYS, LAGS = (5, 15, 40), 20, 3, 6
_RV = ", ".join(
    f"CASE WHEN count(r) OVER (PARTITION BY sid ORDER BY dt ROWS {k - 1} PRECEDING) >= {max(5, k // 2)} THEN stddev_samp(r) OVER (PARTITION BY sid ORDER BY dt ROWS {k - 1} PRECEDING) * sqrt(252) * 100 END AS rv{k}" for k in WINDOWS
)
_HAR = f"""
WITH c AS (SELECT o_orderpriority AS sid, CAST(o_orderdate AS DATE) AS dt, round(sum(o_totalprice), 2) AS c FROM orders GROUP BY 1, 2),
q AS (SELECT *, ln(c) - ln(lag(c) OVER (PARTITION BY sid ORDER BY dt)) AS r FROM c),
x AS (SELECT *, {_RV}, CASE WHEN count(c) OVER w >= {DRAWDOWN // 2} THEN greatest(0, 1 - c / max(c) OVER w) END AS dd FROM q WINDOW w AS (PARTITION BY sid ORDER BY dt ROWS {DRAWDOWN - 1} PRECEDING)),
har AS (SELECT * FROM (SELECT sid, CAST(date_trunc('month', dt) AS DATE) AS month, {", ".join(f"CASE WHEN count(rv{k}) > 0 THEN ln(greatest(max_by(rv{k}, dt) FILTER (rv{k} IS NOT NULL), 1e-6)) END AS log_rv{k}" for k in WINDOWS)},
        ln(1 + max_by(dd, dt) FILTER (dd IS NOT NULL)) AS log_maxdd, count(r) AS days FROM x GROUP BY 1, 2) WHERE days >= {LEAST_DAYS} AND log_maxdd IS NOT NULL AND {" AND ".join(f"log_rv{k} IS NOT NULL" for k in WINDOWS)}),
tgt AS (SELECT sid, dt AS month, ln(v) AS y FROM series_m),
j AS (SELECT sid, month, log_rv15 AS a, log_maxdd AS b, y FROM har JOIN tgt USING (sid, month)),
"""
_FIT = """m AS (SELECT sid, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM {0} GROUP BY sid),
f AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b2, bb / (aa * bb - ab * ab) AS paa, aa / (aa * bb - ab * ab) AS pbb, -ab / (aa * bb - ab * ab) AS pab
      FROM m WHERE n >= {1} AND aa * bb - ab * ab > 1e-10 * aa * bb)"""
XS = ["log_rv15", "log_maxdd"]


def _har(spark, d):
    orders = t.read(spark, d, "orders")
    days = orders.groupBy(F.col("o_orderpriority").alias("sid"), F.col("o_orderdate").cast("date").alias("dt")).agg(F.round(F.sum("o_totalprice"), 2).alias("close"))
    return reg.realized_features(days, WINDOWS, DRAWDOWN, LEAST_DAYS)


def _har_with_target(spark, d):
    target = t.series_m(spark, d).select("sid", F.col("dt").alias("month"), F.log("v").alias("y"))
    return _har(spark, d).join(target, ["sid", "month"])


@query(_HAR.rstrip().rstrip(",") + f" SELECT sid, month, {', '.join(f'round({c}, 6) AS {c}' for c in [*[f'log_rv{k}' for k in WINDOWS], 'log_maxdd'])} FROM har")
def realized_features(spark, d):
    return _har(spark, d).select("sid", "month", *r6(*[f"log_rv{k}" for k in WINDOWS], "log_maxdd"))


@query(
    _HAR
    + _FIT.format("j", 12)
    + f""", e AS (SELECT sid, month, row_number() OVER (PARTITION BY sid ORDER BY month) AS i, n, y - (my + ba * (a - ma) + b2 * (b - mb)) AS e, a - ma AS da, b - mb AS db, ma, mb, paa, pbb, pab, ba, b2, my FROM j JOIN f USING (sid)),
p AS (SELECT *, e * (paa * da + pab * db) / n AS pa, e * (pab * da + pbb * db) / n AS pb, e * (1 - ma * (paa * da + pab * db) - mb * (pab * da + pbb * db)) / n AS pc FROM e),
h AS (SELECT x.sid, sum(k * x.pa * z.pa) AS ha, sum(k * x.pb * z.pb) AS hb, sum(k * x.pc * z.pc) AS hc FROM (SELECT *, unnest(range(-{LAGS}, {LAGS + 1})) AS l FROM p) x JOIN p z ON z.sid = x.sid AND z.i = x.i + x.l,
      LATERAL (SELECT 1 - abs(x.l) / {LAGS + 1}.0 AS k) GROUP BY x.sid),
s AS (SELECT sid, sqrt(sum(e * e) / (max(n) - 3)) AS sigma, sum(e * e) AS rss FROM e GROUP BY sid),
o AS (SELECT sid, n, sigma, 1 - rss / (n * yy) AS r2, unnest([{{'term': 'const', 'coef': my - ba * ma - b2 * mb, 'o': sigma * sqrt((1 + ma * ma * paa + mb * mb * pbb + 2 * ma * mb * pab) / n), 'h': hc}},
      {{'term': 'log_rv15', 'coef': ba, 'o': sigma * sqrt(paa / n), 'h': ha}}, {{'term': 'log_maxdd', 'coef': b2, 'o': sigma * sqrt(pbb / n), 'h': hb}}]) AS u FROM f JOIN s USING (sid) JOIN h USING (sid))
SELECT sid, u.term AS term, round(u.coef, 6) + 0.0 AS coef, round(u.o, 6) AS se_ols, round(sqrt(greatest(0, u.h) * n / (n - 3)), 6) AS se_hac, n, round(r2, 6) + 0.0 AS r2, round(sigma, 6) AS sigma FROM o"""
)
def har_errors(spark, d):
    """The log of a priority's month on two of its realised features, with errors that allow for correlated residuals."""
    fit = reg.newey_west(_har_with_target(spark, d), "y", XS, "month", LAGS, ["sid"], 12)
    return fit.where("fault IS NULL").select("sid", "term", "n", *r6("coef", "se_ols", "se_hac", "r2", "sigma"))


@query(
    _HAR
    + "k AS (SELECT * FROM j WHERE year(month) >= 1998), "
    + _FIT.format("k", 24)
    + """, g AS (SELECT sid, min(dt) AS g FROM series_m WHERE year(dt) >= 1998 GROUP BY sid)
SELECT sid, month, round(exp(my + ba * (log_rv15 - ma) + b2 * (log_maxdd - mb)), 4) AS v, true AS is_proxy FROM har JOIN f USING (sid) JOIN g USING (sid) WHERE month < g
UNION ALL SELECT sid, dt, round(v, 4), false FROM series_m WHERE year(dt) >= 1998"""
)
def volatility_backcast(spark, d):
    """Months before 1998 from realised features; later ones as they are."""
    observed = t.series_m(spark, d).where("year(dt) >= 1998").select("sid", F.col("dt").alias("month"), "v")
    return reg.backcast(_har(spark, d), observed, XS).select("sid", "month", F.round("v", 4).alias("v"), "is_proxy")


@query(
    _HAR
    + "k AS (SELECT * FROM j WHERE month <= DATE '1998-12-31'), "
    + _FIT.format("k", 24)
    + """, e AS (SELECT j.*, my + ba * (a - ma) + b2 * (b - mb) AS hat FROM j JOIN f USING (sid) WHERE month > DATE '1998-12-31'),
bars AS (SELECT sid, quantile_cont(a, 0.5) AS calm, quantile_cont(a, 0.9) AS stress FROM e GROUP BY sid)
SELECT sid, count(*) AS n, round(sqrt(avg(pow(y - hat, 2))), 6) AS rmse, round(avg(y - hat), 6) + 0.0 AS bias, round(avg(y - hat) FILTER (a <= calm), 6) + 0.0 AS calm_bias,
       round(avg(y - hat) FILTER (a >= stress), 6) + 0.0 AS stress_bias, round(exp(avg(hat) FILTER (a >= stress) - avg(y) FILTER (a >= stress)), 6) AS stress_ratio FROM e JOIN bars USING (sid) GROUP BY sid"""
)
def backcast_out_of_sample(spark, d):
    return reg.out_of_sample(_har_with_target(spark, d), "y", XS, "log_rv15", "1998-12-31").select("sid", "n", *r6("rmse", "bias", "calm_bias", "stress_bias", "stress_ratio"))


_CLOUD = f"""
WITH ref AS (SELECT a, b FROM ret_w WHERE year(dt) < 1999 AND a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) + {sup.RIDGE} * (var_samp(a) + var_samp(b)) / 2 AS aa, var_samp(b) + {sup.RIDGE} * (var_samp(a) + var_samp(b)) / 2 AS bb, covar_samp(a, b) AS ab FROM ref),
dist AS (SELECT dt, sqrt((pow(a - ma, 2) * bb + pow(b - mb, 2) * aa - 2 * (a - ma) * (b - mb) * ab) / (aa * bb - ab * ab)) AS d FROM ret_w, m WHERE a IS NOT NULL AND b IS NOT NULL),
bar AS (SELECT quantile_cont(d, 0.9) AS bar FROM dist WHERE year(dt) < 1999)
"""


def _cloud(spark, d):
    rows = t.ret_w(spark, d)
    return rows, sup.support_reference(rows.where(F.year("dt") < 1999), ["a", "b"], 0.9)


@query(_CLOUD + "SELECT dt, round(d, 6) AS distance, d > bar AS beyond FROM dist, bar")
def support_distances(spark, d):
    """Mahalanobis distance of each month's two returns to the months before 1999."""
    rows, ref = _cloud(spark, d)
    return rows.withColumn("d", ref.distance()).where("d IS NOT NULL").select("dt", F.round("d", 6).alias("distance"), (F.col("d") > ref.threshold).alias("beyond"))


@query(
    _CLOUD
    + f"""SELECT year(dt) AS year, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS largest, round(avg(CASE WHEN d > bar THEN 1.0 ELSE 0.0 END), 6) AS beyond,
       avg(CASE WHEN d > bar THEN 1.0 ELSE 0.0 END) > {sup.FLAGGED} AS off_support FROM dist, bar GROUP BY 1"""
)
def support_by_year(spark, d):
    rows, ref = _cloud(spark, d)
    return sup.support(rows.withColumn("year", F.year("dt").cast("long")), ref, ["year"]).select("year", "n", *r6("mean", "p95", "largest", "beyond"), "off_support")


#: A month's label by its return; every seventeenth month isn't known.
_LABELS = """lab AS (SELECT sid, dt, r, CASE WHEN r >= 0.1 THEN 'up' WHEN r <= -0.1 THEN 'down' ELSE 'flat' END AS label FROM ret_m WHERE (year(dt) * 12 + month(dt)) % 17 <> 5),
cuts AS (SELECT *, CASE WHEN dt = lag(dt) OVER w + INTERVAL 1 MONTH THEN 0 ELSE 1 END AS cut, lag(label) OVER w AS prior FROM lab WINDOW w AS (PARTITION BY sid ORDER BY dt)),
runs AS (SELECT *, sum(cut) OVER w AS segment, sum(CASE WHEN cut = 1 OR label <> prior THEN 1 ELSE 0 END) OVER w AS spell FROM cuts WINDOW w AS (PARTITION BY sid ORDER BY dt)),
spl AS (SELECT *, spell = min(spell) OVER s AS first, spell = max(spell) OVER s AS last, lag(state) OVER (PARTITION BY sid, segment ORDER BY spell) AS prior
        FROM (SELECT sid, CAST(segment AS BIGINT) AS segment, spell, min(label) AS state, min(dt) AS start, count(*) AS duration FROM runs GROUP BY ALL) WINDOW s AS (PARTITION BY sid, segment))"""


def _labelled(spark, d):
    r = F.col("r")
    known = t.ret_m(spark, d).where((F.year("dt") * 12 + F.month("dt")) % 17 != 5)
    return known.withColumn("label", F.when(r >= 0.1, "up").when(r <= -0.1, "down").otherwise("flat"))


@query(f"WITH {_LABELS} SELECT sid, segment, state, start, duration, last AS censored FROM spl WHERE NOT first")
def censored_spells(spark, d):
    """Spells whose beginning was seen, with those that were still on when sight was lost."""
    return hz.spell_observations(hz.segmented_spells(_labelled(spark, d))).select("sid", "segment", "state", "start", "duration", "censored")


@query(f"""WITH {_LABELS} SELECT sid, segment, start, prior AS "from", state AS "to" FROM spl WHERE NOT first""")
def segment_transitions(spark, d):
    return hz.segment_transitions(hz.segmented_spells(_labelled(spark, d)))


@query(
    f"""WITH {_LABELS}, o AS (SELECT state, duration, last AS censored FROM spl WHERE NOT first), k AS (SELECT DISTINCT state, duration FROM o),
h AS (SELECT k.state, k.duration, count(*) AS at_risk, count(*) FILTER (o.duration = k.duration AND NOT censored) AS ended FROM k JOIN o ON o.state = k.state AND o.duration >= k.duration GROUP BY 1, 2)
SELECT state, duration, at_risk, ended, round(ended / at_risk, 6) AS hazard, round(product(1 - ended / at_risk) OVER (PARTITION BY state ORDER BY duration), 6) + 0.0 AS survival FROM h"""
)
def duration_hazards(spark, d):
    out = hz.duration_hazards(hz.spell_observations(hz.segmented_spells(_labelled(spark, d))))
    return out.select("state", "duration", "at_risk", "ended", *r6("hazard", "survival"))


@query(
    f"""WITH {_LABELS}, c AS (SELECT sid, label = 'down' AS hit, CASE WHEN abs(r) >= 0.01 THEN CASE WHEN r >= 0 THEN 1 ELSE 0 END + CASE WHEN month(dt) > 6 THEN 2 ELSE 0 END END AS cell,
       CASE WHEN lead(dt) OVER w = dt + INTERVAL 1 MONTH THEN lead(label) OVER w = 'down' END AS nxt FROM lab WINDOW w AS (PARTITION BY sid ORDER BY dt)),
a AS (SELECT cell, nxt FROM c WHERE cell IS NOT NULL AND NOT hit AND nxt IS NOT NULL), f AS (SELECT coalesce(avg(CASE WHEN nxt THEN 1.0 ELSE 0.0 END), 0) AS every FROM a),
n AS (SELECT x.cell, count(nxt) AS months, count(*) FILTER (nxt) AS onsets FROM (SELECT unnest([0, 1, 2, 3]) AS cell) x LEFT JOIN a USING (cell) GROUP BY 1)
SELECT CAST(cell AS INTEGER) AS cell, months, onsets, round(CASE WHEN months >= {hz.LEAST_MONTHS} THEN onsets / months ELSE every END, 6) AS rate, months < {hz.LEAST_MONTHS} AS fell_back FROM n, f"""
)
def onset_hazards(spark, d):
    """How likely a fall begins in the month after one of each kind."""
    kind = F.when(F.abs("r") >= 0.01, (F.col("r") >= 0).cast("int") + F.when(F.month("dt") > 6, 2).otherwise(0))
    rows = _labelled(spark, d).withColumn("kind", kind)
    return hz.onset_hazard(rows, "kind", F.col("label") == "down", [0, 1, 2, 3]).select("cell", "months", "onsets", *r6("rate"), "fell_back")


#: Each status of an order is a market; its priorities are the series that stand in for one another.
_MARKETS = """mk AS (SELECT o_orderstatus AS sid, o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, round(sum(o_totalprice), 2) / 1000 AS v FROM orders GROUP BY 1, 2, 3),
cp_new AS (SELECT sid, dt, v FROM mk WHERE p = '2-HIGH' AND year(dt) >= 1997), cp_old AS (SELECT sid, dt, v FROM mk WHERE p = '3-MEDIUM' AND year(dt) <= 1999), bill AS (SELECT sid, dt, v FROM mk WHERE p = '5-LOW'),
tgt AS (SELECT sid, dt, v FROM mk WHERE p = '1-URGENT' AND year(dt) BETWEEN 1996 AND 1999 AND month(dt) <> 6),
off AS (SELECT sid, avg(n.v - o.v) AS o, stddev_pop(n.v - o.v) AS e, count(*) AS n FROM cp_new n JOIN cp_old o USING (sid, dt) GROUP BY sid),
fst AS (SELECT sid, min(dt) AS f FROM cp_new GROUP BY sid),
cp AS (SELECT * FROM cp_new UNION ALL SELECT sid, dt, v + o FROM cp_old JOIN off USING (sid) JOIN fst USING (sid) WHERE dt < f AND n >= 12),
sp AS (SELECT sid, dt, cp.v - bill.v AS v FROM cp JOIN bill USING (sid, dt) WHERE dt >= DATE '1995-03-01'),
ft AS (SELECT sid, covar_pop(sp.v, tgt.v) / var_pop(sp.v) AS b, avg(tgt.v) - covar_pop(sp.v, tgt.v) / var_pop(sp.v) * avg(sp.v) AS a, count(*) AS n FROM sp JOIN tgt USING (sid, dt) WHERE year(dt) >= 1997 GROUP BY sid HAVING count(*) >= 12)"""


def _markets(spark, d):
    orders = t.read(spark, d, "orders")
    mk = orders.groupBy(F.col("o_orderstatus").alias("sid"), F.col("o_orderpriority").alias("p"), t.month("o_orderdate").alias("dt")).agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("v"))
    one = lambda p, keep: mk.where((F.col("p") == p) & keep).select("sid", "dt", "v")
    y = F.year("dt")
    target = one("1-URGENT", y.between(1996, 1999) & (F.month("dt") != 6))
    return target, one("2-HIGH", y >= 1997), one("3-MEDIUM", y <= 1999), one("5-LOW", F.lit(True))


def _funding(spark, d):
    target, new, old, bill = _markets(spark, d)
    leg, told = ex.joined_segments([new, old], 12)
    return target, ex.spread(leg, bill, "1995-03-01").withColumnRenamed("v", "x"), told


@query(f"WITH {_MARKETS} SELECT sid, 1 AS join, round(o, 6) + 0.0 AS offset, round(e, 6) AS rmse, n AS overlap, CASE WHEN n < 12 THEN 'too few common months' END AS fault FROM off")
def segment_joins(spark, d):
    return _funding(spark, d)[2].select("sid", "join", *r6("offset", "rmse"), "overlap", "fault")


@query(
    f"""WITH {_MARKETS} SELECT sid, dt, round(a + b * v, 5) + 0.0 AS v, true AS is_proxy, 'spread on both ends' AS rule FROM sp JOIN ft USING (sid) WHERE (sid, dt) NOT IN (SELECT (sid, dt) FROM tgt)
    UNION ALL SELECT sid, dt, round(v, 5) + 0.0, false, 'spread on both ends' FROM tgt"""
)
def funding_extension(spark, d):
    """A target filled before, after and within its months from a fitted spread of chained legs."""
    target, x, _ = _funding(spark, d)
    return ex.extended(target, x, ["x"], "spread on both ends", "1997-01-01", least=12).select("sid", "dt", (F.round("v", 5) + 0.0).alias("v"), "is_proxy", "rule")


@query(
    f"""WITH {_MARKETS} SELECT sid, ft.n, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(sqrt(avg(pow(tgt.v - a - b * sp.v, 2))), 5) AS rmse, round(corr(tgt.v, a + b * sp.v), 5) + 0.0 AS corr
    FROM sp JOIN tgt USING (sid, dt) JOIN ft USING (sid) WHERE year(dt) >= 1997 GROUP BY sid, ft.n, a, b"""
)
def extension_overlaps(spark, d):
    target, x, _ = _funding(spark, d)
    out = ex.overlap_report(target, x, ["x"], "1997-01-01", least=12).where("fault IS NULL")
    return out.select("sid", "n", *[(F.round(F.get("coefficients", F.lit(i)), 5) + 0.0).alias(c) for i, c in enumerate("ab")], F.round("rmse", 5).alias("rmse"), (F.round("corr", 5) + 0.0).alias("corr"))


@query(
    f"""WITH {_MARKETS}, x AS (SELECT sid, dt, ln(o.v) AS a, ln(bill.v) AS b FROM (SELECT sid, dt, v FROM mk WHERE p = '2-HIGH') o JOIN bill USING (sid, dt)), j AS (SELECT sid, dt AS month, a, b, ln(tgt.v) AS y FROM x JOIN tgt USING (sid, dt)),
    {_FIT.format("j", 12)}
    SELECT sid, dt, round(exp(my + ba * (a - ma) + b2 * (b - mb)), 5) AS v, true AS is_proxy, 'curve' AS rule FROM x JOIN f USING (sid) WHERE (sid, dt) NOT IN (SELECT (sid, dt) FROM tgt) UNION ALL SELECT sid, dt, round(v, 5), false, 'curve' FROM tgt"""
)
def curve_extension(spark, d):
    """The logarithm of a target from those of two donors, on every month that it lacks."""
    orders = t.read(spark, d, "orders")
    target, _, _, bill = _markets(spark, d)
    high = orders.where("o_orderpriority = '2-HIGH'").groupBy(F.col("o_orderstatus").alias("sid"), t.month("o_orderdate").alias("dt")).agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("a"))
    donors = high.join(bill.withColumnRenamed("v", "b"), ["sid", "dt"])
    return ex.extended(target, donors, ["a", "b"], "curve", least=12, log=True).select("sid", "dt", F.round("v", 5).alias("v"), "is_proxy", "rule")


#: Excess returns of each market's urgent orders, and the change of its high ones as the rate, known from 1996 on.
_EXCESS = f"""{_MARKETS}, e AS (SELECT * FROM (SELECT sid, dt, v / lag(v) OVER (PARTITION BY sid ORDER BY dt) - 1 AS v FROM mk WHERE p = '1-URGENT') WHERE v IS NOT NULL),
rt AS (SELECT sid, dt, v / 1e6 AS v FROM mk WHERE p = '2-HIGH' AND year(dt) >= 1996), lv AS (SELECT sid, dt, v FROM mk WHERE p = '3-MEDIUM'),
tot AS (SELECT sid, dt, e.v + rt.v AS v, count(*) OVER (PARTITION BY sid) AS n, min(dt) OVER (PARTITION BY sid) AS f FROM e JOIN rt USING (sid, dt))"""


def _excess(spark, d):
    orders = t.read(spark, d, "orders")
    mk = orders.groupBy(F.col("o_orderstatus").alias("sid"), F.col("o_orderpriority").alias("p"), t.month("o_orderdate").alias("dt")).agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("v"))
    one = lambda p: mk.where(F.col("p") == p).select("sid", "dt", "v")
    return w.simple_return(one("1-URGENT"), out="v"), one("2-HIGH").where(F.year("dt") >= 1996).withColumn("v", F.col("v") / 1e6), one("3-MEDIUM")


@query(f"WITH {_EXCESS} SELECT sid, dt, round(v, 6) + 0.0 AS v FROM tot WHERE n >= {ex.LEAST_SUM}")
def collateral_returns(spark, d):
    excess, rate, _ = _excess(spark, d)
    return ex.collateral_return(excess, rate)[0].select("sid", "dt", *r6("v"))


@query(
    f"""WITH {_EXCESS}, c AS (SELECT DISTINCT sid, n, f FROM tot) SELECT k.sid, coalesce(any_value(n), 0) AS common, min(dt) FILTER (dt < f) AS excess_from, max(dt) FILTER (dt < f) AS excess_to,
    CASE WHEN coalesce(any_value(n), 0) < {ex.LEAST_SUM} THEN 'too few common months' END AS fault FROM e k LEFT JOIN c USING (sid) GROUP BY k.sid"""
)
def excess_only_eras(spark, d):
    excess, rate, _ = _excess(spark, d)
    return ex.collateral_return(excess, rate)[1]


@query(
    f"""WITH {_EXCESS}, m AS (SELECT * FROM (SELECT sid, dt, ln(v) - lag(ln(v)) OVER (PARTITION BY sid ORDER BY dt) AS m FROM lv) WHERE m IS NOT NULL), j AS (SELECT sid, count(*) AS n, corr(v, m) AS c FROM e JOIN m USING (sid, dt) GROUP BY sid)
    SELECT s.sid, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= {ex.LEAST_CHECK} THEN round(c, 6) + 0.0 END AS correlation, CASE WHEN coalesce(n, 0) < {ex.LEAST_CHECK} THEN 'too few common months' END AS fault FROM (SELECT DISTINCT sid FROM e) s LEFT JOIN j USING (sid)"""
)
def index_checks(spark, d):
    excess, _, level = _excess(spark, d)
    return ex.return_check(excess, level).select("sid", "n", *r6("correlation"), "fault")


_PARITY = """st AS (SELECT sid, dt, v AS rate FROM series_m WHERE month(dt) IN (1, 7)), mo AS (SELECT DISTINCT dt FROM series_m), fs AS (SELECT sid, arg_min(rate, dt) AS r0 FROM st GROUP BY sid), ask AS (SELECT sid, mo.dt FROM mo, fs),
par AS (SELECT dt, 100 * exp(avg(ln(rate / r0))) AS v, count(*) AS members FROM (SELECT ask.sid, ask.dt, st.rate FROM ask ASOF JOIN st ON ask.sid = st.sid AND ask.dt >= st.dt) JOIN fs USING (sid) GROUP BY dt HAVING count(*) = (SELECT count(*) FROM fs))"""


def _parity(spark, d):
    s = t.series_m(spark, d)
    return s, ex.stepped_index(s.where(F.month("dt").isin(1, 7)).withColumnRenamed("v", "rate"), s)


@query(f"WITH {_PARITY} SELECT dt, round(v, 5) AS index, members FROM par")
def parity_index(spark, d):
    """A geometric index of rates that change twice a year."""
    return _parity(spark, d)[1].select("dt", F.round("index", 5).alias("index"), "members")


@query(
    f"""WITH {_PARITY}, ob AS (SELECT dt, v FROM series_m WHERE sid = '1-URGENT' AND year(dt) >= 1998), s AS (SELECT (SELECT arg_min(v, dt) FROM ob) / (SELECT arg_max(v, dt) FROM par WHERE dt < (SELECT min(dt) FROM ob)) AS k)
    SELECT dt, round(v * k, 4) AS v, true AS is_proxy, 'parity' AS rule FROM par, s WHERE dt < (SELECT min(dt) FROM ob) UNION ALL SELECT dt, round(v, 4), false, 'parity' FROM ob"""
)
def parity_extension(spark, d):
    s, index = _parity(spark, d)
    out = ex.pinned_front(s.where("sid = '1-URGENT' AND year(dt) >= 1998"), index.withColumnRenamed("index", "v"), "parity")
    return out.select("dt", F.round("v", 4).alias("v"), "is_proxy", "rule")


@query(
    f"""WITH {_MARKETS}, pm AS (SELECT sid, dt, v FROM mk WHERE p = '1-URGENT' AND year(dt) >= 1998), f AS (SELECT sid, min(dt) AS f FROM pm GROUP BY sid),
    ra AS (SELECT a.sid, a.dt, 100 * a.v / b.v AS v FROM mk a JOIN mk b ON a.sid = b.sid AND a.dt = b.dt AND a.p = '2-HIGH' AND b.p = '3-MEDIUM')
    SELECT sid, dt, round(v, 5) AS v, 'ratio' AS source FROM ra LEFT JOIN f USING (sid) WHERE f IS NULL OR dt < f UNION ALL SELECT sid, dt, round(v, 5), 'primary' FROM pm"""
)
def ratio_extension(spark, d):
    """A series put after the ratio of two others."""
    orders = t.read(spark, d, "orders")
    mk = orders.groupBy(F.col("o_orderstatus").alias("sid"), F.col("o_orderpriority").alias("p"), t.month("o_orderdate").alias("dt")).agg((F.round(F.sum("o_totalprice"), 2) / 1000).alias("v"))
    one = lambda p: mk.where(F.col("p") == p).select("sid", "dt", "v")
    return ex.ratio_front(one("1-URGENT").where("year(dt) >= 1998"), one("2-HIGH"), one("3-MEDIUM")).select("sid", "dt", F.round("v", 5).alias("v"), "source")
