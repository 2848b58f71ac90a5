"""Queries that hold generated series against those they were made from, and policies against years to come."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decay as dc, memorization as mem, reference as rf, statistics as st, utility as ut, walkforward as wf, windows as w
from . import tables as t
from .registry import ORACLE_SQL, query
from .windows_q import r6

LENGTH, PERCENTILE = 6, 0.05
#: A priority's months before 1999 are its train rows, later ones held out; its orders of one status are a generated path.
_GENERATED = """gen AS (SELECT sid, path, dt, v / prev - 1 AS r FROM (SELECT *, lag(v) OVER (PARTITION BY sid, path ORDER BY dt) AS prev FROM
    (SELECT o_orderpriority AS sid, o_orderstatus AS path, CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2, 3)) WHERE prev IS NOT NULL)"""
_SIGNALS = f"""
WITH {_GENERATED},
s AS (SELECT sid, avg(r) AS m, CASE WHEN stddev_pop(r) > 0 THEN stddev_pop(r) ELSE 1 END AS d FROM ret_m WHERE year(dt) < 1999 GROUP BY sid),
rows_ AS (SELECT 'train' AS kind, sid, '' AS path, dt, r FROM ret_m WHERE year(dt) < 1999 UNION ALL SELECT 'held_out', sid, '', dt, r FROM ret_m WHERE year(dt) >= 1999
          UNION ALL SELECT 'generated', sid, path, dt, r FROM gen),
z AS (SELECT kind, sid, path, row_number() OVER p - 1 AS start, list((r - m) / d) OVER (PARTITION BY kind, sid, path ORDER BY dt ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING) AS xs
      FROM rows_ JOIN s USING (sid) WINDOW p AS (PARTITION BY kind, sid, path ORDER BY dt)),
win AS (SELECT * FROM z WHERE len(xs) = {LENGTH}), blocks AS (SELECT * FROM win WHERE start % {LENGTH} = 0),
loo AS (SELECT b.sid, b.start, min(list_distance(b.xs, c.xs)) AS d FROM blocks b JOIN win c ON b.kind = 'train' AND c.kind = 'train' AND b.sid = c.sid AND abs(b.start - c.start) >= {LENGTH} GROUP BY 1, 2),
eps AS (SELECT sid, quantile_cont(d, {PERCENTILE}) AS epsilon FROM loo GROUP BY sid),
enough AS (SELECT sid FROM blocks WHERE kind = 'train' GROUP BY sid HAVING count(*) >= 2),
found AS (SELECT b.kind, b.sid, CASE WHEN b.kind = 'generated' THEN b.path || ':' || b.start ELSE CAST(b.start AS VARCHAR) END AS place, min(list_distance(b.xs, c.xs)) AS distance
          FROM blocks b JOIN win c ON b.sid = c.sid AND (b.kind = 'generated' AND c.kind = 'train' OR b.kind <> 'generated' AND c.kind = 'generated' AND c.start % {LENGTH} = 0) GROUP BY 1, 2, 3),
sig AS (SELECT found.*, epsilon FROM found LEFT JOIN eps USING (sid) WHERE sid IN (SELECT sid FROM enough))
"""


def generated(spark, d):
    """Each status of a priority's orders as a path of monthly returns."""
    orders = t.read(spark, d, "orders")
    months = orders.groupBy(F.col("o_orderpriority").alias("sid"), F.col("o_orderstatus").alias("path"), t.month("o_orderdate").alias("dt")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    prev = F.lag("v").over(w.over(["sid", "path"]))
    return months.withColumn("prev", prev).where("prev IS NOT NULL").select("sid", "path", "dt", (F.try_divide("v", "prev") - 1).alias("r"))


def _parts(spark, d):
    r = t.ret_m(spark, d)
    return r.where(F.year("dt") < 1999), r.where(F.year("dt") >= 1999), generated(spark, d)


@query(_SIGNALS + "SELECT sid, count(*) AS n, round(max(epsilon), 6) AS epsilon FROM loo JOIN eps USING (sid) GROUP BY sid")
def memorization_epsilon(spark, d):
    train, _, _ = _parts(spark, d)
    return mem.leave_one_out_epsilon(mem.standardized(train, train), LENGTH, PERCENTILE).select("sid", "n", *r6("epsilon"))


@query(_SIGNALS + "SELECT kind, sid, place, round(distance, 6) AS distance, round(epsilon, 6) AS epsilon FROM sig")
def memorization_signals(spark, d):
    return mem.signals(*_parts(spark, d), LENGTH, PERCENTILE).select("kind", "sid", "place", *r6("distance", "epsilon"))


@query(
    _SIGNALS
    + """, near AS (SELECT kind = 'train' AS p, -distance AS v FROM sig WHERE kind <> 'generated')
SELECT count(*) AS blocks, round(quantile_cont(distance, 0.05), 6) AS p05, round(quantile_cont(distance, 0.5), 6) AS p50, round(avg(CASE WHEN distance < epsilon THEN 1.0 ELSE 0.0 END), 6) AS near_duplicates,
       (SELECT round(avg(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END), 6) FROM near a JOIN near b ON a.p AND NOT b.p) AS membership_auc
FROM sig WHERE kind = 'generated' HAVING count(*) > 0"""
)
def memorization_summary(spark, d):
    found = mem.signals(*_parts(spark, d), LENGTH, PERCENTILE)
    return mem.summary(found).select("blocks", *r6("p05", "p50", "near_duplicates", "membership_auc"))


SEED = 20260125
#: Returns in units of the priority's real ones; blocks of six months, and each month with the next.
_UTILITY = f"""
WITH RECURSIVE {_GENERATED},
s AS (SELECT sid, avg(r) AS m, CASE WHEN stddev_pop(r) > 0 THEN stddev_pop(r) ELSE 1 END AS d FROM ret_m GROUP BY sid),
z AS (SELECT sid, 'real' AS path, 1 AS label, dt, (r - m) / d AS r FROM ret_m JOIN s USING (sid) UNION ALL SELECT sid, path, 0, dt, (r - m) / d FROM gen JOIN s USING (sid)),
b AS (SELECT *, (row_number() OVER (PARTITION BY sid, path ORDER BY dt) - 1) // {LENGTH} AS block FROM z),
feat AS (SELECT sid, path, label, block, avg(r) AS mean, stddev_pop(r) AS deviation FROM b GROUP BY ALL HAVING count(*) = {LENGTH}),
pairs AS (SELECT * FROM (SELECT sid, path, label, dt, r AS x, lead(r) OVER (PARTITION BY sid, path ORDER BY dt) AS y FROM z) WHERE y IS NOT NULL)
"""
_DRAW = "CAST('0x' || left(md5({0} || ':' || {1}), 13) AS BIGINT) / pow(2, 52)"


def _scaled(spark, d):
    real = t.ret_m(spark, d)
    return mem.standardized(real, real).withColumn("path", F.lit("real")), mem.standardized(generated(spark, d), real)


def _blocks(spark, d):
    real, made = (ut.window_features(x, LENGTH, ["sid", "path"]) for x in _scaled(spark, d))
    name = F.concat_ws(":", "sid", "path", F.col("block").cast("string")).alias("id")
    return [x.select(name, "mean", "deviation") for x in (real, made)]


def _pairs(spark, d):
    name = F.concat_ws(":", "sid", "path", F.col("dt").cast("string")).alias("id")
    return [ut.one_step_pairs(x, ["sid", "path"]).select(name, "x", "y") for x in _scaled(spark, d)]


@query(_UTILITY + "SELECT sid || ':' || path || ':' || block AS id, round(mean, 6) + 0.0 AS mean, round(deviation, 6) + 0.0 AS deviation FROM feat")
def block_features(spark, d):
    real, made = _blocks(spark, d)
    return real.unionByName(made).select("id", *r6("mean", "deviation"))


@query(
    _UTILITY
    + f""", f AS (SELECT label, mean, deviation, {_DRAW.format(f"CASE label WHEN 1 THEN '{SEED}' ELSE '{SEED + 1}' END", "sid || ':' || path || ':' || block")} AS draw FROM feat),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw) <= least(greatest(1, round_even({ut.TRAIN_SHARE} * count(*) OVER (PARTITION BY label), 0)), count(*) OVER (PARTITION BY label) - 1) AS fitted FROM f),
m AS (SELECT avg(mean) AS m1, stddev_pop(mean) AS d1, avg(deviation) AS m2, stddev_pop(deviation) AS d2, sum(label) AS n1, count(*) - sum(label) AS n0 FROM k WHERE fitted),
x AS (SELECT label, fitted, (mean - m1) / d1 AS a, (deviation - m2) / d2 AS b, 0.5 / CASE label WHEN 1 THEN n1 ELSE n0 END AS w FROM k, m),
g(i, wa, wb, wc) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL SELECT i + 1, wa - 1.3 * (sum(w * e * a) + {ut.RIDGE} * wa), wb - 1.3 * (sum(w * e * b) + {ut.RIDGE} * wb), wc - 1.3 * (sum(w * e) + {ut.RIDGE} * wc)
  FROM (SELECT i, wa, wb, wc, w, a, b, 1 / (1 + exp(-(wa * a + wb * b + wc))) - label AS e FROM g, x WHERE fitted AND i < 800) GROUP BY i, wa, wb, wc),
r AS (SELECT label, avg(CASE WHEN (wa * a + wb * b + wc >= 0) = (label = 1) THEN 1.0 ELSE 0.0 END) AS recall FROM x, (SELECT * FROM g ORDER BY i DESC LIMIT 1) WHERE NOT fitted GROUP BY label)
SELECT (SELECT count(*) FROM feat WHERE label = 1) AS real_rows, (SELECT count(*) FROM feat WHERE label = 0) AS generated_rows, round(max(recall) FILTER (label = 1), 6) AS real_recall,
       round(max(recall) FILTER (label = 0), 6) AS generated_recall, round(abs(sum(recall) / 2 - 0.5), 6) AS score FROM r"""
)
def discriminative_score(spark, d):
    real, made = _blocks(spark, d)
    return ut.discriminative_score(real, made, ["mean", "deviation"], ["id"], SEED).select("real_rows", "generated_rows", *r6("real_recall", "generated_recall", "score"))


@query(
    _UTILITY
    + f""", p AS (SELECT label, x, y, {_DRAW.format(f"'{SEED}'", "sid || ':' || path || ':' || CAST(dt AS VARCHAR)")} AS draw FROM pairs),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw) <= CASE label WHEN 0 THEN least(greatest(2, round_even({ut.PAIR_SHARE} * count(*) OVER (PARTITION BY label), 0)), count(*) OVER (PARTITION BY label))
      ELSE least(greatest(2, round_even({ut.REAL_SHARE} * count(*) OVER (PARTITION BY label), 0)), count(*) OVER (PARTITION BY label) - 2) END AS fitted FROM p),
m AS (SELECT label, avg(x) AS x, avg(y) AS y, avg(x * x) + {ut.RIDGE} AS xx, avg(x * y) AS xy, 1 + {ut.RIDGE} AS o FROM k WHERE fitted GROUP BY label),
c AS (SELECT label, (xx * y - x * xy) / (xx * o - x * x) AS a, (o * xy - x * y) / (xx * o - x * x) AS b FROM m),
e AS (SELECT (SELECT avg(pow(k.y - a - b * k.x, 2)) FROM k, c WHERE k.label = 1 AND c.label = 0) AS tstr, (SELECT avg(pow(k.y - a - b * k.x, 2)) FROM k, c WHERE k.label = 1 AND c.label = 1 AND NOT fitted) AS trtr)
SELECT round(tstr, 6) AS tstr, round(trtr, 6) AS trtr, round(tstr / trtr, 6) AS degradation FROM e"""
)
def tstr_degradation(spark, d):
    real, made = _pairs(spark, d)
    return ut.tstr_degradation(made, real, ["id"], SEED).select(*r6("tstr", "trtr", "degradation"))


def _misfit(x: str) -> str:
    at = "range(1, len(v) + 1)"
    many = f"(list_sum(list_transform({at}, lambda j: v[j] * exp(-({x}) * j))) / list_sum(list_transform({at}, lambda j: exp(-2 * ({x}) * j))))"
    return f"list_sum(list_transform({at}, lambda j: pow(v[j] - {many} * exp(-({x}) * j), 2)))"


_STEP = (dc.HIGH - dc.LOW) / (dc.POINTS - 1)


@query(
    f"""WITH RECURSIVE dev AS (SELECT sid, dt, y - avg(y) OVER (PARTITION BY sid) AS x FROM (SELECT sid, dt, abs(r - avg(r) OVER (PARTITION BY sid)) AS y FROM ret_m)),
lags AS (SELECT sid, x, k, lag(x, CAST(k AS INT)) OVER (PARTITION BY sid, k ORDER BY dt) AS y FROM dev, (SELECT unnest(range(1, 25)) AS k)),
cur AS (SELECT sid, list(acf ORDER BY k) AS v FROM (SELECT sid, k, sum(x * y) / sum(x * x) AS acf FROM lags GROUP BY sid, k) GROUP BY sid),
grid AS (SELECT sid, v, i, {_misfit(f'{dc.LOW} + i * {_STEP}')} AS f FROM cur, (SELECT unnest(range({dc.POINTS})) AS i)),
best AS (SELECT sid, any_value(v) AS v, arg_min(i, (f, i)) AS i FROM grid GROUP BY sid),
ends AS (SELECT sid, v, {dc.LOW} + greatest(i - 1, 0) * {_STEP} AS lo, {dc.LOW} + least(i + 1, {dc.POINTS - 1}) * {_STEP} AS hi FROM best),
two AS (SELECT *, hi - {dc.GOLDEN} * (hi - lo) AS c, lo + {dc.GOLDEN} * (hi - lo) AS d FROM ends),
g AS (SELECT sid, v, 0 AS k, lo::DOUBLE AS lo, hi::DOUBLE AS hi, c::DOUBLE AS c, d::DOUBLE AS d FROM two
      UNION ALL SELECT sid, v, k + 1, CASE WHEN left_ THEN lo ELSE c END, CASE WHEN left_ THEN d ELSE hi END, CASE WHEN left_ THEN d - {dc.GOLDEN} * (d - lo) ELSE d END, CASE WHEN left_ THEN c ELSE c + {dc.GOLDEN} * (hi - c) END
      FROM (SELECT *, {_misfit('c')} < {_misfit('d')} AS left_ FROM g WHERE hi - lo >= {dc.TOLERANCE} AND k < {dc.STEPS}))
SELECT sid, CAST(24 AS INTEGER) AS n, round(arg_max((lo + hi) / 2, k), 4) + 0.0 AS rate FROM g GROUP BY sid"""
)
def volatility_decay(spark, d):
    """How fast a return's absolute autocorrelations fall over two years of lags."""
    curve = st.autocorrelations(t.ret_m(spark, d), range(1, 25), "sid", "dt", "r", absolute=True)
    return dc.decay_rates(curve, ["sid"]).select("sid", "n", (F.round("rate", 4) + 0.0).alias("rate"))


YEARS = (1998, 1999, 2000, 2001)
POLICIES = {"optimised": "clipped", "constrained": "long_only", "static": {"a": 0.6, "b": 0.4}, "banded": ("banded", {"a": 0.6, "b": 0.4})}
#: The optimum of two assets that may not be sold short: both, or one of them alone, or neither.
_WALK = f"""
WITH x AS (SELECT dt, a, b FROM ret_w WHERE a IS NOT NULL AND b IS NOT NULL),
p AS (SELECT *, count(*) OVER k AS n, avg(a) OVER k AS ma, avg(b) OVER k AS mb, var_samp(a) OVER k + {wf.RIDGE} AS aa, var_samp(b) OVER k + {wf.RIDGE} AS bb, covar_samp(a, b) OVER k AS ab,
             exp(sum(ln(1 + a)) OVER t) AS ga, exp(sum(ln(1 + b)) OVER t) AS gb, count(*) OVER t AS nt, row_number() OVER (PARTITION BY year(dt) ORDER BY dt) - 1 AS place
      FROM x WINDOW k AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t AS (ORDER BY dt ROWS BETWEEN {wf.TRAILING} PRECEDING AND 1 PRECEDING)),
f AS (SELECT CAST(year(dt) AS INTEGER) AS fold, place // {wf.EVERY} AS block, * FROM p WHERE year(dt) IN {YEARS}),
s AS (SELECT *, (bb * ma - ab * mb) / (aa * bb - ab * ab) AS ua, (aa * mb - ab * ma) / (aa * bb - ab * ab) AS ub, 0.6 * ga / (0.6 * ga + 0.4 * gb) AS da FROM f WHERE place % {wf.EVERY} = 0),
c AS (SELECT *, CASE WHEN ua > 0 AND ub > 0 THEN ua WHEN ma > 0 AND mb - ab * ma / aa <= 0 THEN ma / aa ELSE 0 END AS ca, CASE WHEN ua > 0 AND ub > 0 THEN ub WHEN mb > 0 AND ma - ab * mb / bb <= 0 THEN mb / bb ELSE 0 END AS cb FROM s),
wts AS (SELECT fold, block, dt, n, 'static' AS policy, 0.6 AS wa, 0.4 AS wb FROM c
      UNION ALL SELECT fold, block, dt, n, 'banded', CASE WHEN nt < 2 OR da IS NULL OR abs(da - 0.6) > {wf.BAND} THEN 0.6 ELSE da END, CASE WHEN nt < 2 OR da IS NULL OR abs(da - 0.6) > {wf.BAND} THEN 0.4 ELSE 1 - da END FROM c
      UNION ALL SELECT fold, block, dt, n, 'optimised', CASE WHEN n < 2 THEN NULL WHEN greatest(ua, 0) + greatest(ub, 0) > 1e-12 THEN greatest(ua, 0) / (greatest(ua, 0) + greatest(ub, 0)) ELSE 0.5 END,
                CASE WHEN n < 2 THEN NULL WHEN greatest(ua, 0) + greatest(ub, 0) > 1e-12 THEN greatest(ub, 0) / (greatest(ua, 0) + greatest(ub, 0)) ELSE 0.5 END FROM c
      UNION ALL SELECT fold, block, dt, n, 'constrained', CASE WHEN n < 2 THEN NULL WHEN ca + cb > 1e-12 THEN ca / (ca + cb) ELSE 0.5 END, CASE WHEN n < 2 THEN NULL WHEN ca + cb > 1e-12 THEN cb / (ca + cb) ELSE 0.5 END FROM c)
"""


@query(_WALK + "SELECT fold, policy, dt, block, n AS known, round(wa, 6) AS a, round(wb, 6) AS b FROM wts")
def walk_forward_weights(spark, d):
    out = wf.weights(t.ret_w(spark, d), ["a", "b"], YEARS, POLICIES)
    return out.withColumns({"a": F.get("w", F.lit(0)), "b": F.get("w", F.lit(1))}).select("fold", "policy", "dt", "block", "known", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(
    _WALK
    + """, r AS (SELECT f.fold, policy, f.dt, wa * f.a + wb * f.b AS r FROM f JOIN wts USING (fold, block)), g AS (SELECT *, exp(sum(ln(1 + r)) OVER w) AS wealth FROM r WINDOW w AS (PARTITION BY fold, policy ORDER BY dt)),
k AS (SELECT *, 1 - wealth / greatest(1.0, max(wealth) OVER (PARTITION BY fold, policy ORDER BY dt)) AS dd FROM g)
SELECT fold, policy, count(*) AS rows, round(CASE WHEN count(r) = count(*) THEN sum(ln(1 + r)) END, 6) + 0.0 AS terminal_log_wealth, round(CASE WHEN count(r) = count(*) THEN greatest(0, max(dd)) END, 6) + 0.0 AS max_drawdown FROM k GROUP BY 1, 2"""
)
def walk_forward(spark, d):
    """Four policies over two priorities' returns, each year from the years before."""
    return wf.walk_forward(t.ret_w(spark, d), ["a", "b"], YEARS, POLICIES).select("fold", "policy", "rows", *r6("terminal_log_wealth", "max_drawdown"))


_DEPTHS = """dep AS (SELECT sid, max(1 - wealth / greatest(1.0, peak)) AS depth FROM (SELECT *, max(wealth) OVER w AS peak FROM (SELECT sid, dt, exp(sum(ln(1 + r)) OVER (PARTITION BY sid ORDER BY dt)) AS wealth FROM ret_m)
  WINDOW w AS (PARTITION BY sid ORDER BY dt)) GROUP BY sid),
one AS (SELECT sid, path, dt, exp(sum(ln(1 + r)) OVER (PARTITION BY sid, path ORDER BY dt)) AS wealth FROM gen WHERE r > -1),
edep AS (SELECT sid, path, greatest(0, max(1 - wealth / greatest(1.0, peak))) AS depth FROM (SELECT *, max(wealth) OVER (PARTITION BY sid, path ORDER BY dt) AS peak FROM one) GROUP BY sid, path)"""


@query(f"WITH {_GENERATED}, {_DEPTHS} SELECT sid, count(*) AS paths, round(quantile_cont(e.depth, 0.95), 6) AS predicted, round(max(dep.depth) - quantile_cont(e.depth, 0.95), 6) + 0.0 AS surprise FROM edep e JOIN dep USING (sid) GROUP BY sid")
def drawdown_surprise(spark, d):
    """A priority's deepest fall less the 95th percentile of those of its generated paths."""
    deepest = lambda x, by: w.drawdown_state(x, by, from_one=True).groupBy(*by).agg(F.greatest(F.lit(0.0), -F.min("dd")).alias("max_drawdown"))
    return wf.drawdown_surprise(deepest(t.ret_m(spark, d), ["sid"]), deepest(generated(spark, d).where("r > -1"), ["sid", "path"]), ["sid"]).select("sid", "paths", *r6("predicted", "surprise"))


@query("WITH k AS (SELECT sid, dt, v, last_v, ln(v / last_v) AS rel FROM series_d WHERE v > 0 AND last_v > 0) SELECT * FROM (SELECT sid, dt, round(rel - lag(rel) OVER (PARTITION BY sid ORDER BY dt), 6) + 0.0 AS alpha FROM k) WHERE alpha IS NOT NULL")
def alpha_by_window(spark, d):
    """A day's mean against its last value, as two wealths."""
    return wf.alpha_by_window(t.series_d(spark, d), "v", "last_v").select("sid", "dt", *r6("alpha"))


RESAMPLES, LENGTH_MADE, RESEED = 200, 60, 9
_UNIT = "CAST(('0x' || substr(md5('{0}:{1}:' || {2}), 1, 8)) AS BIGINT) / 4294967296.0"


def _draws_sql(table: str, key: str, length: str) -> str:
    """Resamples of ``table``'s rows by key, as ``res``: the same draws as the operator's."""
    cell = f"{key} || ':' || path || ':' || m"
    return f"""hist AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY dt) - 1 AS i FROM {table}), cnt AS (SELECT {key}, count(*) AS n FROM hist GROUP BY 1),
gr AS (SELECT {key}, n, path, unnest(range(0, {length})) AS m FROM cnt, (SELECT unnest(range(0, {RESAMPLES})) AS path)),
sn AS (SELECT *, CASE WHEN m = 0 OR {_UNIT.format(RESEED, 'restart', cell)} < 1 / 6.0 THEN m END AS since, CAST(floor({_UNIT.format(RESEED, 'start', cell)} * n) AS BIGINT) AS start FROM gr),
ln_ AS (SELECT {key}, path, m, n, last_value(since IGNORE NULLS) OVER w AS since, last_value(CASE WHEN since IS NOT NULL THEN start END IGNORE NULLS) OVER w AS start FROM sn WINDOW w AS (PARTITION BY {key}, path ORDER BY m)),
res AS (SELECT hist.* EXCLUDE (dt, i), ln_.path, ln_.m FROM ln_ JOIN hist ON hist.{key} = ln_.{key} AND hist.i = (ln_.start + ln_.m - ln_.since) % ln_.n)"""


def _stats_sql(table: str, keys: str, order: str, name: str) -> str:
    """``name (keys, stat, value)`` of a table's ``r`` by keys."""
    p = f"PARTITION BY {keys}"
    lags = ", ".join(f"lag(d, {k}) OVER o AS d{k}, lag(a, {k}) OVER o AS a{k}" for k in rf.LAGS)
    sums = ", ".join(f"CASE WHEN i % {h} = 0 THEN sum(x) OVER ({p} ORDER BY ord ROWS {h - 1} PRECEDING) END AS s{h}" for h in rf.HORIZONS)
    acf = ", ".join(f"CASE WHEN count(*) > {k} AND sum({c} * {c}) > 1e-18 THEN sum({c} * {c}{k}) / sum({c} * {c}) END AS acf_{kind}_lag{k}" for kind, c in (("r", "d"), ("abs", "a")) for k in rf.LAGS)
    kurt = "avg(pow({0} - {1}, 4)) / nullif(pow(avg(pow({0} - {1}, 2)), 2), 0) - 3"
    block = ", ".join(f"CASE WHEN count(s{h}) >= {rf.LEAST_BLOCKS} THEN {kurt.format(f's{h}', f'sm{h}')} END AS agg_gaussianity_{h}, CASE WHEN count(s{h}) >= {rf.LEAST_BLOCKS} AND var_samp(x) > 0 THEN var_samp(s{h}) / ({h} * var_samp(x)) END AS variance_ratio_{h}" for h in rf.HORIZONS)
    stats = rf.names()
    return f"""{name}1 AS (SELECT {keys}, {order} AS ord, r AS x, r - avg(r) OVER ({p}) AS d, count(*) OVER ({p}) AS n, row_number() OVER ({p} ORDER BY {order}) AS i, row_number() OVER ({p} ORDER BY r) AS rank_ FROM {table}),
{name}2 AS (SELECT *, abs(d) - avg(abs(d)) OVER ({p}) AS a, abs(lead(d) OVER ({p} ORDER BY ord)) AS nx, exp(sum(ln(1 + x)) OVER ({p} ORDER BY ord)) AS wl, greatest(1, CAST(round_even(n * {rf.TAIL}, 0) AS BIGINT)) AS k FROM {name}1),
{name}3 AS (SELECT *, {lags}, {sums}, 1 - wl / greatest(1.0, max(wl) OVER ({p} ORDER BY ord)) AS fall, CASE WHEN rank_ <= k + 1 AND x < 0 THEN -x END AS loss FROM {name}2 WINDOW o AS ({p} ORDER BY ord)),
{name}4 AS (SELECT *, {", ".join(f"avg(s{h}) OVER ({p}) AS sm{h}" for h in rf.HORIZONS)} FROM {name}3),
{name}5 AS (SELECT {keys}, avg(x) AS mean, stddev_samp(x) AS std, avg(pow(d, 3)) / nullif(pow(avg(d * d), 1.5), 0) AS skew, avg(pow(d, 4)) / nullif(pow(avg(d * d), 2), 0) - 3 AS excess_kurtosis, {acf},
  CASE WHEN stddev_pop(x) FILTER (nx IS NOT NULL) * stddev_pop(nx) > 0 THEN covar_pop(x, nx) / (stddev_pop(x) FILTER (nx IS NOT NULL) * stddev_pop(nx)) END AS leverage,
  CASE WHEN count(loss) = max(k) + 1 AND sum(ln(loss)) - (max(k) + 1) * ln(min(loss)) > 0 THEN max(k) / (sum(ln(loss)) - (max(k) + 1) * ln(min(loss))) END AS hill, greatest(0, max(fall)) AS max_drawdown, {block} FROM {name}4 GROUP BY {keys}),
{name}6 AS (SELECT *, {" + ".join(f"acf_r_lag{k}" for k in rf.LAGS)} AS acf_r_sum, {" + ".join(f"acf_abs_lag{k}" for k in rf.LAGS)} AS acf_abs_sum FROM {name}5),
{name} AS (SELECT {keys}, unnest({stats}) AS stat, unnest([{", ".join(f"CAST({s} AS DOUBLE)" for s in stats)}]) AS value FROM {name}6)"""


def _bands_sql(key: str) -> str:
    return f"ends AS (SELECT {key}, stat, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, count(value) AS n FROM rst GROUP BY 1, 2)"


_BASE = f"WITH {_draws_sql('ret_m', 'sid', 'n')}, {_stats_sql('res', 'sid, path', 'm', 'rst')}, {_stats_sql('ret_m', 'sid', 'dt', 'obs')}, {_bands_sql('sid')}"


@query(_BASE + " SELECT obs.sid, obs.stat, round(value, 5) + 0.0 AS value, round(lo, 5) + 0.0 AS lo, round(hi, 5) + 0.0 AS hi, coalesce(n, 0) AS n FROM obs LEFT JOIN ends ON obs.sid = ends.sid AND obs.stat = ends.stat")
def reference_bands(spark, d):
    """Every statistic of every priority's returns with its band over resampled histories."""
    out = rf.bands(t.ret_m(spark, d), "sid", "dt", "r", RESAMPLES, 1 / 6, RESEED)
    return out.select("sid", "stat", *[(F.round(c, 5) + 0.0).alias(c) for c in ("value", "lo", "hi")], "n")


_PAIRS = [("1-URGENT", "2-HIGH"), ("1-URGENT", "3-MEDIUM"), ("4-NOT SPECIFIED", "5-LOW")]
_PAIR_STATS = """{2}1 AS (SELECT {1}, x, y, abs(x - avg(x) OVER (PARTITION BY {1})) AS ax, abs(y - avg(y) OVER (PARTITION BY {1})) AS ay FROM {0}),
{2} AS (SELECT {1}, unnest(['correlation', 'abs_correlation']) AS stat, unnest([corr(x, y), corr(ax, ay)]) AS value FROM {2}1 GROUP BY {1})"""


@query(
    f"""WITH pr AS (SELECT a.sid || '~' || b.sid AS pair, a.dt, a.r AS x, b.r AS y FROM ret_m a JOIN ret_m b ON a.dt = b.dt AND (a.sid, b.sid) IN ({", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)})),
{_draws_sql('pr', 'pair', 'n')}, {_PAIR_STATS.format('res', 'pair, path', 'rst')}, {_PAIR_STATS.format('pr', 'pair', 'obs')}, {_bands_sql('pair')}
SELECT obs.pair, obs.stat, round(value, 5) + 0.0 AS value, round(lo, 5) + 0.0 AS lo, round(hi, 5) + 0.0 AS hi, n FROM obs JOIN ends ON obs.pair = ends.pair AND obs.stat = ends.stat"""
)
def pair_reference_bands(spark, d):
    out = rf.pair_bands(t.ret_m(spark, d), _PAIRS, "sid", "dt", "r", RESAMPLES, 1 / 6, RESEED)
    return out.select("pair", "stat", *[(F.round(c, 5) + 0.0).alias(c) for c in ("value", "lo", "hi")], "n")


@query(
    f"""WITH {_GENERATED}, {_draws_sql('ret_m', 'sid', str(LENGTH_MADE))}, {_stats_sql('res', 'sid, path', 'm', 'rst')}, {_bands_sql('sid')}, ok AS (SELECT * FROM gen WHERE r > -1), {_stats_sql('ok', 'sid, path', 'dt', 'mst')},
v AS (SELECT sid, stat, avg(value) AS value FROM mst GROUP BY 1, 2), b AS (SELECT DISTINCT sid, s.stat FROM ret_m, (SELECT unnest({rf.names()}) AS stat) s)
SELECT b.sid, b.stat, round(value, 5) + 0.0 AS value, round(lo, 5) + 0.0 AS lo, round(hi, 5) + 0.0 AS hi,
  CASE WHEN value IS NULL THEN 'missing' WHEN lo IS NULL OR hi IS NULL OR NOT lo < hi THEN 'unbanded' WHEN value BETWEEN lo AND hi THEN 'pass' ELSE 'fail' END AS verdict
FROM b LEFT JOIN ends ON b.sid = ends.sid AND b.stat = ends.stat LEFT JOIN v ON b.sid = v.sid AND b.stat = v.stat"""
)
def reference_battery(spark, d):
    """Generated paths against the bands of histories as long as they are."""
    made = generated(spark, d).where("r > -1")
    found = rf.long(rf.statistics(made, ["sid", "path"], "dt", "r"), ["sid"], rf.names())
    ref = rf.bands(t.ret_m(spark, d), "sid", "dt", "r", RESAMPLES, 1 / 6, RESEED, length=LENGTH_MADE)
    return rf.judged(found, ref, "sid").select("sid", "stat", *[(F.round(c, 5) + 0.0).alias(c) for c in ("value", "lo", "hi")], "verdict")


@query(
    f"""SELECT sid, count(*) AS stats, count(*) FILTER (verdict IN ('pass', 'fail')) AS usable, count(*) FILTER (verdict = 'fail') AS outside, count(*) FILTER (verdict = 'missing') AS missing,
    coalesce(string_agg(stat, ',' ORDER BY stat) FILTER (verdict = 'fail'), '') AS outside_names, count(*) FILTER (verdict IN ('fail', 'missing')) = 0 AS holds FROM ({ORACLE_SQL['reference_battery']}) GROUP BY sid"""
)
def battery_clauses(spark, d):
    """Of each priority's battery, what lies outside its bands and what couldn't be told."""
    return rf.clauses(reference_battery(spark, d), "sid").withColumn("outside_names", F.array_join("outside_names", ","))


@query(
    """WITH q AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY m) - 1) // 3 AS q, r FROM ensemble), s AS (SELECT path, q, sum(r) AS s FROM q GROUP BY 1, 2 HAVING count(*) = 3)
    SELECT path, count(*) AS quarters, round(100 * greatest(0, -min(s)), 6) + 0.0 AS worst, round(abs(100 * greatest(0, -min(s)) - 0.05), 6) AS error FROM s GROUP BY path"""
)
def severity_errors(spark, d):
    return rf.severity_errors(t.ensemble(spark, d), ["path"], "m", "r", 0.05).select("path", "quarters", *r6("worst", "error"))
