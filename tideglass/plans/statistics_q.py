"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as st, windows as w
from ..operators.ranges import quantiles
from . import tables as t
from .registry import query
from .windows_q import r6


@query(
    """WITH d AS (SELECT path, r, r - avg(r) OVER (PARTITION BY path) AS x FROM ensemble)
    SELECT path, count(*) AS n, round(avg(r), 8) + 0.0 AS mean, round(stddev_samp(r), 8) AS std, round(avg(x * x * x) / pow(avg(x * x), 1.5), 6) + 0.0 AS skew,
           round(avg(x * x * x * x) / pow(avg(x * x), 2) - 3, 6) + 0.0 AS kurtosis FROM d GROUP BY path"""
)
def path_moments(spark, d):
    m = st.moments(t.ensemble(spark, d), ["path"], "r")
    return m.select("path", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), *r6("skew", "kurtosis"))


@query("SELECT count(*) AS n, round(avg(m), 8) + 0.0 AS mean_of_means, round(stddev_samp(m), 8) AS spread, round(stddev_samp(m) / sqrt(count(*)), 8) AS error FROM (SELECT path, avg(r) AS m FROM ensemble GROUP BY path)")
def mean_over_paths(spark, d):
    """A statistic by path, then over paths, with its Monte-Carlo error."""
    p = t.ensemble(spark, d).groupBy("path").agg(F.avg("r").alias("m"))
    error = F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 8).alias("mean_of_means"), F.round(F.stddev_samp("m"), 8).alias("spread"), F.round(error, 8).alias("error"))


def _acf_sql(inner: str) -> str:
    return f"""WITH d AS ({inner}), l AS (SELECT sid, dt, x, k, lag(x, CAST(k AS INT)) OVER (PARTITION BY sid, k ORDER BY dt) AS y FROM d, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
    SELECT sid, k AS lag, round(sum(x * y) / sum(x * x), 6) + 0.0 AS acf FROM l GROUP BY sid, k"""


@query(_acf_sql("SELECT sid, dt, r - avg(r) OVER (PARTITION BY sid) AS x FROM ret_m"))
def autocorrelations(spark, d):
    return st.autocorrelations(t.ret_m(spark, d), range(1, 6), "sid", "dt", "r").select("sid", "lag", *r6("acf"))


@query(_acf_sql("SELECT sid, dt, y - avg(y) OVER (PARTITION BY sid) AS x FROM (SELECT sid, dt, abs(r - avg(r) OVER (PARTITION BY sid)) AS y FROM ret_m)"))
def absolute_autocorrelations(spark, d):
    return st.autocorrelations(t.ret_m(spark, d), range(1, 6), "sid", "dt", "r", absolute=True).select("sid", "lag", *r6("acf"))


@query(
    """WITH d AS (SELECT sid, dt, r - avg(r) OVER (PARTITION BY sid) AS x FROM ret_m), l AS (SELECT sid, x, lag(x) OVER (PARTITION BY sid ORDER BY dt) AS y FROM d),
    a AS (SELECT sid, sum(x * y) / sum(x * x) AS phi FROM l GROUP BY sid)
    SELECT sid, round(phi, 6) + 0.0 AS phi, round(CASE WHEN phi = 0 THEN 0.0 WHEN abs(phi) < 1 THEN ln(0.5) / ln(abs(phi)) END, 6) AS half_life FROM a"""
)
def mean_reversion_half_life(spark, d):
    a = st.autocorrelations(t.ret_m(spark, d), [1], "sid", "dt", "r").withColumnRenamed("acf", "phi")
    return a.withColumn("half_life", st.half_life(F.col("phi"))).select("sid", *r6("phi", "half_life"))


@query(
    """WITH x AS (SELECT path, -r AS loss, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY -r DESC) AS i FROM ensemble),
    k AS (SELECT *, greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS k FROM x), t AS (SELECT path, k, min(loss) AS t, count(*) AS c FROM k WHERE i <= k + 1 GROUP BY path, k)
    SELECT t.path, t.k, round(CASE WHEN c = t.k + 1 AND t > 0 THEN 1 / avg(ln(CASE WHEN t > 0 THEN loss / t END)) FILTER (i <= t.k) END, 6) AS alpha
    FROM t JOIN k ON t.path = k.path AND i <= t.k + 1 GROUP BY t.path, t.k, c, t"""
)
def hill_left_tail(spark, d):
    return st.hill_left(t.ensemble(spark, d), ["path"], "r", 0.2).select("path", "k", *r6("alpha"))


@query(
    """WITH x AS (SELECT sid, abs(r) AS x FROM ret_m WHERE r <> 0), i AS (SELECT *, count(*) OVER (PARTITION BY sid) AS n, row_number() OVER (PARTITION BY sid ORDER BY x DESC) AS i FROM x),
    k AS (SELECT *, greatest(1, CAST(ceil(n * 0.1) AS BIGINT)) AS k FROM i)
    SELECT sid, k, round(1 / (avg(ln(x)) - ln(min(x))), 6) AS alpha FROM k WHERE i <= k GROUP BY sid, k"""
)
def hill_two_sided(spark, d):
    return st.hill_two_sided(t.ret_m(spark, d), ["sid"], "r", 0.1).select("sid", "k", *r6("alpha"))


_BLOCKS = "b AS (SELECT path, sum(r) AS s FROM (SELECT path, r, (row_number() OVER (PARTITION BY path ORDER BY m) - 1) // {0} AS b FROM ensemble) GROUP BY path, b HAVING count(*) = {0})"


@query(f"WITH {_BLOCKS.format(3)}, c AS (SELECT s - avg(s) OVER () AS x FROM b) SELECT count(*) AS n, round(avg(x * x * x * x) / pow(avg(x * x), 2) - 3, 6) + 0.0 AS kurtosis FROM c")
def aggregational_kurtosis(spark, d):
    return st.block_kurtosis(t.ensemble(spark, d), 3, [], ["path"], "m", "r", 30).select("n", *r6("kurtosis"))


@query(f"WITH {_BLOCKS.format(12)} SELECT 12 AS k, (SELECT count(*) FROM b) AS n, round((SELECT var_samp(s) FROM b) / (12 * (SELECT var_samp(r) FROM ensemble)), 6) AS ratio")
def variance_ratio(spark, d):
    return st.variance_ratio(t.ensemble(spark, d), 12, "path", "m", "r", 10).select("k", "n", *r6("ratio"))


@query(
    """WITH x AS (SELECT sid, r, abs(lead(r) OVER (PARTITION BY sid ORDER BY dt) - avg(r) OVER (PARTITION BY sid)) AS y FROM ret_m)
    SELECT sid, round(corr(r, y), 6) + 0.0 AS leverage FROM x WHERE y IS NOT NULL GROUP BY sid"""
)
def leverage_correlation(spark, d):
    return st.leverage(t.ret_m(spark, d), "sid", "dt", "r").select("sid", *r6("leverage"))


_RANK = "rank() OVER (PARTITION BY sid ORDER BY {0}) + (count(*) OVER (PARTITION BY sid, {0}) - 1) / 2.0"
_EPISODES = """dd AS (SELECT sid, dt, wealth / max(wealth) OVER (PARTITION BY sid ORDER BY dt) - 1 AS dd FROM (SELECT *, product(1 + r) OVER (PARTITION BY sid ORDER BY dt) AS wealth FROM ret_m)),
    i AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY dt) AS island FROM dd),
    e AS (SELECT sid, -min(dd) AS depth, count(*) AS duration FROM i WHERE dd < 0 GROUP BY sid, island)"""


@query(
    f"""WITH {_EPISODES}, k AS (SELECT *, {_RANK.format('depth')} AS ra, {_RANK.format('duration')} AS rb FROM e)
    SELECT sid, count(*) AS episodes, round(quantile_cont(depth, 0.5), 6) AS depth, round(quantile_cont(CAST(duration AS DOUBLE), 0.5), 6) AS duration,
    round(CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END, 6) + 0.0 AS rho FROM k GROUP BY sid"""
)
def drawdown_summary(spark, d):
    return st.episode_summary(t.ret_m(spark, d)).select("sid", "episodes", *r6("depth", "duration", "rho"))


@query(
    """SELECT x, y, round(c, 6) + 0.0 AS corr FROM (SELECT 'a' AS x, 'b' AS y, corr(a, b) AS c FROM ret_w UNION ALL SELECT 'a', 'c', corr(a, c) FROM ret_w UNION ALL SELECT 'b', 'c', corr(b, c) FROM ret_w)"""
)
def pair_correlations(spark, d):
    return st.pair_correlations(t.ret_w(spark, d), ["a", "b", "c"]).select("x", "y", *r6("corr"))


@query(
    """WITH f AS (SELECT 'x' AS side, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM ret_w WHERE year(dt) < 1998), g AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM ret_w WHERE year(dt) >= 1998)
    SELECT round(sqrt(2 * (pow(f.ab - g.ab, 2) + pow(f.ac - g.ac, 2) + pow(f.bc - g.bc, 2))), 6) AS distance FROM f, g"""
)
def correlation_matrix_distance(spark, d):
    """Frobenius distance of the correlation matrices of two spans."""
    both = t.ret_w(spark, d)
    early, late = (st.pair_correlations(both.where(F.year("dt") < 1998 if first else F.year("dt") >= 1998), ["a", "b", "c"]).withColumnRenamed("corr", f"c{first}") for first in (1, 0))
    gap = F.pow(F.col("c1") - F.col("c0"), 2)
    return early.join(late, ["x", "y"]).agg(F.round(F.sqrt(2 * F.sum(gap)), 6).alias("distance"))


@query(
    """WITH q AS (SELECT quantile_cont(a, 0.1) AS bar FROM ret_w WHERE b IS NOT NULL), x AS (SELECT a, b, a <= bar AS low FROM ret_w, q WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT count(*) FILTER (low) AS n, round(corr(a, b) FILTER (low) - corr(a, b), 6) + 0.0 AS lift FROM x"""
)
def crisis_correlation_lift(spark, d):
    return st.crisis_lift(t.ret_w(spark, d), "a", "b").select("n", *r6("lift"))


@query(
    """WITH x AS (SELECT r, g FROM ensemble), u AS (SELECT (rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0) / (count(*) OVER () + 1) AS ua,
    (rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0) / (count(*) OVER () + 1) AS ub FROM x)
    SELECT count(*) AS n, round(avg(CASE WHEN ua <= 0.05 AND ub <= 0.05 THEN 1.0 ELSE 0.0 END) / 0.05, 6) + 0.0 AS lower, round(avg(CASE WHEN ua > 0.95 AND ub > 0.95 THEN 1.0 ELSE 0.0 END) / 0.05, 6) + 0.0 AS upper FROM u"""
)
def tail_dependence(spark, d):
    return st.tail_dependence(t.ensemble(spark, d), "r", "g", 0.05, 10).select("n", *r6("lower", "upper"))


_VAR = "v AS (SELECT sid, quantile_cont(-r, 0.95) AS var FROM ret_m GROUP BY sid), f AS (SELECT v.sid, v.var, avg(-r) FILTER (-r >= v.var) AS es FROM ret_m r JOIN v ON r.sid = v.sid GROUP BY v.sid, v.var)"


@query(f"WITH {_VAR} SELECT sid, round(var, 6) AS var, round(es, 6) AS es FROM f")
def value_at_risk(spark, d):
    return st.var_es(t.ret_m(spark, d), ["sid"], "r", 0.95).select("sid", *r6("var", "es"))


@query(f"WITH {_VAR} SELECT r.sid, round(avg(greatest(0.0, -r - var) / (0.05 * es) + var / es + ln(es) - 1), 6) + 0.0 AS score FROM ret_m r JOIN f ON r.sid = f.sid WHERE es > 0 GROUP BY r.sid")
def joint_tail_score(spark, d):
    r = t.ret_m(spark, d)
    return st.joint_score(r, ["sid"], "r", st.var_es(r, ["sid"], "r", 0.95), 0.95).select("sid", *r6("score"))


def _ll(n1: str, n0: str, p: str) -> str:
    return f"(CASE WHEN {n1} > 0 THEN {n1} * ln(CASE WHEN {p} > 0 THEN {p} END) ELSE 0.0 END + CASE WHEN {n0} > 0 THEN {n0} * ln(CASE WHEN {p} < 1 THEN 1 - {p} END) ELSE 0.0 END)"


_ERFC = "(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-lr_pof / 2))"


@query(
    f"""WITH v AS (SELECT quantile_cont(-r, 0.9) AS var FROM ensemble WHERE m < 40), h AS (SELECT path, m, -r >= var AS hit FROM ensemble, v),
    s AS (SELECT *, lag(hit) OVER (PARTITION BY path ORDER BY m) AS prev FROM h),
    c AS (SELECT count(*) AS n, count(*) FILTER (hit) AS x, CAST(count(*) FILTER (NOT prev AND NOT hit) AS DOUBLE) AS n00, CAST(count(*) FILTER (NOT prev AND hit) AS DOUBLE) AS n01,
          CAST(count(*) FILTER (prev AND NOT hit) AS DOUBLE) AS n10, CAST(count(*) FILTER (prev AND hit) AS DOUBLE) AS n11 FROM s),
    l AS (SELECT n, x AS exceedances, greatest(0.0, -2 * ({_ll('x', '(n - x)', '0.1')} - {_ll('x', '(n - x)', '(x / n)')})) AS lr_pof,
          greatest(0.0, -2 * ({_ll('(n01 + n11)', '(n00 + n10)', '((n01 + n11) / (n00 + n01 + n10 + n11))')} - {_ll('n01', 'n00', '(n01 / (n00 + n01))')} - {_ll('n11', 'n10', '(n11 / (n10 + n11))')})) AS lr_ind FROM c),
    e AS (SELECT *, 1 / (1 + 0.3275911 * sqrt(lr_pof / 2)) AS t FROM l)
    SELECT n, exceedances, round(lr_pof, 5) AS lr_pof, round(lr_ind, 5) AS lr_ind, round(lr_pof + lr_ind, 5) AS lr_cc, round(exp(-(lr_pof + lr_ind) / 2), 6) AS p_cc, round({_ERFC}, 6) AS p_pof FROM e"""
)
def coverage_backtests(spark, d):
    e = t.ensemble(spark, d)
    bar = quantiles(e.where("m < 40").withColumn("loss", -F.col("r")), "loss", {"var": 0.9}).select("var")
    hits = e.crossJoin(F.broadcast(bar)).select("path", "m", (-F.col("r") >= F.col("var")).alias("hit"))
    out = st.coverage_tests(hits, "path", "m", 0.9)
    return out.select("n", "exceedances", *[F.round(c, 5).alias(c) for c in ("lr_pof", "lr_ind", "lr_cc")], *r6("p_cc", "p_pof"))


_PIT = """g AS (SELECT sid, r AS x FROM ret_m WHERE year(dt) < 1999), h AS (SELECT sid, r AS x FROM ret_m WHERE year(dt) >= 1999),
    p AS (SELECT h.sid, h.x, (count(*) FILTER (g.x < h.x) + 0.5 * count(*) FILTER (g.x = h.x)) / count(*) AS pit FROM h JOIN g ON h.sid = g.sid GROUP BY h.sid, h.x)"""


def _pits(spark, d):
    r = t.ret_m(spark, d)
    return st.midrank_pit(r.where(F.year("dt") >= 1999), r.where(F.year("dt") < 1999), ["sid"], "r")


@query(f"WITH {_PIT} SELECT sid, round(x, 6) + 0.0 AS r, round(pit, 6) + 0.0 AS pit FROM p")
def midrank_pit(spark, d):
    return _pits(spark, d).select("sid", *r6("r", "pit"))


@query(f"WITH {_PIT}, i AS (SELECT sid, pit, row_number() OVER (PARTITION BY sid ORDER BY pit) AS i, count(*) OVER (PARTITION BY sid) AS n FROM p) SELECT sid, round(max(greatest(i / n - pit, pit - (i - 1) / n)), 6) AS ks FROM i GROUP BY sid")
def ks_against_uniform(spark, d):
    return st.ks_uniform(_pits(spark, d), ["sid"], "pit").select("sid", *r6("ks"))


@query(
    """WITH g AS (SELECT sid, quantile_cont(r, 0.25) AS lo, quantile_cont(r, 0.75) AS hi FROM ret_m WHERE year(dt) < 1999 GROUP BY sid)
    SELECT r.sid, count(*) AS n, round(avg(CASE WHEN r BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS coverage FROM ret_m r JOIN g ON r.sid = g.sid WHERE year(dt) >= 1999 GROUP BY r.sid"""
)
def interval_coverage(spark, d):
    r = t.ret_m(spark, d)
    fan = st.percentile_fan(r.where(F.year("dt") < 1999), ["sid"], "r", [0.25, 0.75]).drop("n")
    inside = F.when(F.col("r").between(F.col("p25"), F.col("p75")), 1.0).otherwise(0.0)
    return r.where(F.year("dt") >= 1999).join(F.broadcast(fan), "sid").groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(inside), 6).alias("coverage"))


@query(
    """WITH x AS (SELECT d.doc_id, quality = 1 AS p, CAST(n_chars AS DOUBLE) AS v FROM documents d JOIN labels l ON d.doc_id = l.doc_id), k AS (SELECT p, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x)
    SELECT count(*) FILTER (p) AS positives, count(*) FILTER (NOT p) AS negatives,
    round((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) AS auc FROM k"""
)
def rank_sum_auc(spark, d):
    x = t.read(spark, d, "documents").select("doc_id", "n_chars").join(t.read(spark, d, "labels"), "doc_id")
    return st.rank_auc(x, F.col("quality") == 1, "n_chars").select("positives", "negatives", *r6("auc"))


@query(
    """WITH x AS (SELECT a - b AS d FROM ret_w WHERE a - b <> 0), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM x)
    SELECT count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus, round((sum(r) FILTER (d > 0) - sum(r) FILTER (d < 0)) / sum(r), 6) + 0.0 AS effect FROM k"""
)
def signed_rank_effect(spark, d):
    return st.signed_rank(t.ret_w(spark, d), F.col("a") - F.col("b")).select("n", "w_plus", "w_minus", *r6("effect"))


@query(
    """WITH g AS (SELECT path, m, product(1 + r) OVER (PARTITION BY path ORDER BY m) AS growth FROM ensemble)
    SELECT m, count(*) AS n, round(quantile_cont(growth, 0.05), 6) AS p5, round(quantile_cont(growth, 0.5), 6) AS p50, round(quantile_cont(growth, 0.95), 6) AS p95 FROM g GROUP BY m"""
)
def growth_fan(spark, d):
    """Percentiles of compounded growth over paths, by month."""
    g = w.wealth(t.ensemble(spark, d), "path", "m")
    return st.percentile_fan(g, ["m"], "wealth", [0.05, 0.5, 0.95]).select("m", "n", *r6("p5", "p50", "p95"))


@query(
    """WITH p AS (SELECT path, avg(r) AS mean FROM ensemble GROUP BY path), c AS (SELECT quantile_cont(mean, 0.5) AS c FROM p), o AS (SELECT path, mean, abs(mean - c) AS o FROM p, c), d AS (SELECT quantile_cont(o, 0.5) AS d FROM o)
    SELECT path, round(mean, 8) + 0.0 AS mean, round(CASE WHEN d <> 0 THEN o / d END, 6) + 0.0 AS gap FROM o, d"""
)
def robust_mean_gap(spark, d):
    return st.robust_gap(t.ensemble(spark, d), "path", "r").select("path", F.round("mean", 8).alias("mean"), *r6("gap"))


@query("SELECT round(abs((SELECT avg(r) FROM ensemble WHERE path = 1) - (SELECT avg(r) FROM ensemble)) / (SELECT stddev_samp(r) FROM ensemble), 6) + 0.0 AS gap")
def ergodicity_gap(spark, d):
    """One long path's mean against the pool's, in the pool's deviations."""
    e = t.ensemble(spark, d)
    return e.agg(F.round(F.try_divide(F.abs(F.avg(F.when(F.col("path") == 1, F.col("r"))) - F.avg("r")), F.stddev_samp("r")), 6).alias("gap"))


@query(
    """WITH x AS (SELECT *, lead(r, 1) OVER (PARTITION BY sid ORDER BY dt) AS nxt FROM ret_m)
    SELECT sid, round(regr_slope(nxt, r), 6) + 0.0 AS slope, round(regr_intercept(nxt, r), 6) + 0.0 AS intercept, round(regr_r2(nxt, r), 6) AS r2 FROM x WHERE nxt IS NOT NULL GROUP BY sid"""
)
def forward_return_regression(spark, d):
    x = t.ret_m(spark, d).withColumn("nxt", F.lead("r").over(w.over())).where("nxt IS NOT NULL")
    return x.groupBy("sid").agg(F.regr_slope("nxt", "r").alias("slope"), F.regr_intercept("nxt", "r").alias("intercept"), F.regr_r2("nxt", "r").alias("r2")).select("sid", *r6("slope", "intercept", "r2"))


@query(
    """WITH g AS (SELECT path, product(1 + r) - 1 AS total, min(r) AS worst, max(r) AS best, stddev_samp(r) * sqrt(12) AS vol, count(*) AS n FROM ensemble GROUP BY path)
    SELECT path, n, round(pow(1 + total, 12.0 / n) - 1, 6) + 0.0 AS annual, round(vol, 6) AS vol, round(worst, 6) + 0.0 AS worst, round(best, 6) + 0.0 AS best FROM g"""
)
def path_return_summary(spark, d):
    g = t.ensemble(spark, d).groupBy("path").agg((F.product(1 + F.col("r")) - 1).alias("total"), F.min("r").alias("worst"), F.max("r").alias("best"), (F.stddev_samp("r") * F.sqrt(F.lit(12))).alias("vol"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("annual", F.pow(1 + F.col("total"), F.lit(12.0) / F.col("n")) - 1).select("path", "n", *r6("annual", "vol", "worst", "best"))


@query("SELECT count(*) AS paths, count(*) FILTER (lo >= -0.005 AND hi > 0) AS pumps FROM (SELECT path, min(r) AS lo, max(r) AS hi FROM ensemble GROUP BY path)")
def money_pump_violations(spark, d):
    """Paths on which a costless leg never loses more than a tolerance and gains once."""
    p = t.ensemble(spark, d).groupBy("path").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    return p.agg(F.count(F.lit(1)).alias("paths"), F.count(F.when((F.col("lo") >= -0.005) & (F.col("hi") > 0), 1)).alias("pumps"))


@query(
    """WITH w AS (SELECT path, m, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY m) > 12 AND sum(r) OVER (PARTITION BY path ORDER BY m ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING) > 0 THEN r ELSE 0.0 END AS v FROM ensemble)
    SELECT path, count(*) FILTER (v <> 0) AS months_in, round(sum(v), 6) + 0.0 AS total FROM w GROUP BY path"""
)
def momentum_strategy(spark, d):
    o = w.over("path", "m")
    held = (F.row_number().over(o) > 12) & (F.sum("r").over(w.rows(o, -12, -2)) > 0)
    v = t.ensemble(spark, d).withColumn("v", F.when(held, F.col("r")).otherwise(0.0))
    return v.groupBy("path").agg(F.count(F.when(F.col("v") != 0, 1)).alias("months_in"), F.round(F.sum("v"), 6).alias("total"))


@query("SELECT dt, round(0.6 * a + 0.3 * b + 0.1 * c, 6) + 0.0 AS r FROM ret_w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def static_weights_strategy(spark, d):
    """Weights as rows joined to the long returns; months without every leg go."""
    legs = spark.createDataFrame([("1-URGENT", 0.6), ("2-HIGH", 0.3), ("3-MEDIUM", 0.1)], "sid string, weight double")
    both = t.ret_m(spark, d).join(F.broadcast(legs), "sid").groupBy("dt").agg(F.sum(F.col("r") * F.col("weight")).alias("r"), F.count(F.lit(1)).alias("n"))
    return both.where("n = 3").select("dt", *r6("r"))


@query(
    """WITH x AS (SELECT path, m, r AS level, r - lag(r) OVER (PARTITION BY path ORDER BY m) AS change, lag(r) OVER (PARTITION BY path ORDER BY m) AS prev FROM ensemble)
    SELECT path, m, round(coalesce(prev / 12 - 5 * change, 0.0), 6) + 0.0 AS ret FROM x"""
)
def carry_minus_duration(spark, d):
    o = w.over("path", "m")
    ret = F.lag("r").over(o) / 12 - 5 * (F.col("r") - F.lag("r").over(o))
    return t.ensemble(spark, d).select("path", "m", F.round(F.coalesce(ret, F.lit(0.0)), 6).alias("ret"))
