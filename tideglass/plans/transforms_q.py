"""Transform queries: one priority's series stands for the target, another for its donor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as st, transforms as tr, windows as w
from . import tables as t
from .registry import query
from .windows_q import r6

_PAIR = "tg AS (SELECT dt, v FROM series_m WHERE sid = '1-URGENT' AND year(dt) >= 1998), dn AS (SELECT dt, v FROM series_m WHERE sid = '2-HIGH'), o AS (SELECT tg.v AS y, dn.v AS x FROM tg JOIN dn ON tg.dt = dn.dt)"
_FITS = {
    "regression": "SELECT covar_pop(x, y) / var_pop(x) AS b, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS a, count(*) AS n FROM o",
    "level_map": "SELECT 1.0 AS b, avg(y - x) AS a, count(*) AS n FROM o",
    "ratio": "SELECT avg(y / x) AS b, 0.0 AS a, count(*) AS n FROM o",
    "loglog": "SELECT covar_pop(ln(x), ln(y)) / var_pop(ln(x)) AS b, avg(ln(y)) - covar_pop(ln(x), ln(y)) / var_pop(ln(x)) * avg(ln(x)) AS a, count(*) AS n FROM o",
}


def pair(spark, d):
    s = t.series_m(spark, d)
    return s.where("sid = '1-URGENT' AND year(dt) >= 1998").select("dt", "v"), s.where("sid = '2-HIGH'").select("dt", "v")


@query(f"WITH {_PAIR} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, round(a, 4) + 0.0 AS a, round(CAST(b AS DOUBLE), 6) + 0.0 AS b, n FROM ({sql})" for k, sql in _FITS.items()))
def overlap_fits(spark, d):
    target, donor = pair(spark, d)
    out = None
    for kind in _FITS:
        one = tr.overlap_fit(target, donor, kind).select(F.lit(kind).alias("kind"), F.round("a", 4).alias("a"), F.round("b", 6).alias("b"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _splice_sql(kind: str, fitted: str = "a + b * v") -> str:
    return f"WITH {_PAIR}, f AS ({_FITS[kind]}) SELECT dt, round({fitted}, 4) AS v, true AS is_proxy FROM dn, f WHERE dt < (SELECT min(dt) FROM tg) UNION ALL SELECT dt, round(v, 4), false FROM tg"


def _spliced(spark, d, kind):
    target, donor = pair(spark, d)
    return tr.splice(target, donor, tr.overlap_fit(target, donor, kind), loglog=kind == "loglog").select("dt", F.round("v", 4).alias("v"), "is_proxy")


@query(_splice_sql("regression"))
def splice_regression(spark, d):
    return _spliced(spark, d, "regression")


@query(_splice_sql("ratio"))
def splice_ratio(spark, d):
    return _spliced(spark, d, "ratio")


@query(_splice_sql("level_map"))
def splice_level(spark, d):
    return _spliced(spark, d, "level_map")


@query(_splice_sql("loglog", "exp(a + b * ln(v))"))
def splice_loglog(spark, d):
    return _spliced(spark, d, "loglog")


@query(f"WITH {_PAIR} SELECT dt, round(1.5 + 0.9 * v, 4) AS v, true AS is_proxy FROM dn WHERE dt < (SELECT min(dt) FROM tg) UNION ALL SELECT dt, round(v, 4), false FROM tg")
def splice_pinned(spark, d):
    target, donor = pair(spark, d)
    return tr.splice(target, donor, tr.fixed_fit(donor, 1.5, 0.9)).select("dt", F.round("v", 4).alias("v"), "is_proxy")


@query(f"WITH {_PAIR}, f AS ({_FITS['regression']}) SELECT round(sqrt(avg(pow(y - a - b * x, 2))), 4) AS rmse, count(*) AS overlap FROM o, f")
def splice_overlap_error(spark, d):
    target, donor = pair(spark, d)
    return tr.overlap_error(target, donor, tr.overlap_fit(target, donor, "regression")).select(F.round("rmse", 4).alias("rmse"), "overlap")


@query(
    """WITH s AS (SELECT covar_pop(b, b) AS c11, covar_pop(c, c) AS c22, covar_pop(b, c) AS c12, covar_pop(b, a) AS c1, covar_pop(c, a) AS c2, avg(a) AS my, avg(b) AS m1, avg(c) AS m2, count(*) AS n FROM wide_m
               WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL), q AS (SELECT *, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) AS b1, (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM s)
    SELECT round(my - b1 * m1 - b2 * m2, 2) AS a, round(b1, 6) AS b1, round(b2, 6) AS b2, n FROM q"""
)
def two_donor_regression(spark, d):
    return tr.two_donor_fit(t.wide_m(spark, d), "a", "b", "c").select(F.round("a", 2).alias("a"), *r6("b1", "b2"), "n")


_DECLARED = [("1-URGENT", "1996-03-01"), ("1-URGENT", "1997-03-01"), ("2-HIGH", "1996-04-01"), ("2-HIGH", "1990-01-01"), ("3-MEDIUM", "1996-05-01")]


@query(
    f"""WITH k AS (SELECT * FROM series_m WHERE NOT (sid = '1-URGENT' AND dt IN (DATE '1996-03-01', DATE '1997-03-01', DATE '1997-04-01')) AND NOT (sid = '2-HIGH' AND dt = DATE '1996-04-01')),
    g AS (SELECT * FROM (VALUES {', '.join(f"('{s}', DATE '{m}')" for s, m in _DECLARED)}) g(sid, gap_at)),
    f AS (SELECT g.sid, g.gap_at AS dt, avg(k.v) AS v FROM g JOIN k ON k.sid = g.sid AND k.dt IN (CAST(g.gap_at - INTERVAL 1 MONTH AS DATE), CAST(g.gap_at + INTERVAL 1 MONTH AS DATE))
          WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.sid = g.sid AND x.dt = g.gap_at) GROUP BY 1, 2 HAVING count(*) = 2)
    SELECT sid, dt, round(v, 4) AS v, false AS is_proxy FROM k UNION ALL SELECT sid, dt, round(v, 4), true FROM f"""
)
def declared_gap_fill(spark, d):
    s = t.series_m(spark, d)
    gone = (F.col("sid") == "1-URGENT") & F.col("dt").isin("1996-03-01", "1997-03-01", "1997-04-01") | (F.col("sid") == "2-HIGH") & (F.col("dt") == "1996-04-01")
    declared = spark.createDataFrame(_DECLARED, "sid string, dt string").withColumn("dt", F.to_date("dt"))
    return tr.fill_declared_gaps(s.where(~gone), declared).select("sid", "dt", F.round("v", 4).alias("v"), "is_proxy")


_GELTNER = """c AS (SELECT sid, dt, r, r - avg(r) OVER (PARTITION BY sid) AS x FROM ret_m), p AS (SELECT *, x * lag(x) OVER (PARTITION BY sid ORDER BY dt) AS xp FROM c),
    h AS (SELECT sid, dt, r, least(0.95, greatest(0.0, sum(xp) OVER (PARTITION BY sid) / sum(x * x) OVER (PARTITION BY sid))) AS phi FROM p),
    tr AS (SELECT sid, dt, r, phi, coalesce((r - phi * lag(r) OVER (PARTITION BY sid ORDER BY dt)) / (1 - phi), r) AS truth FROM h)"""


@query(f"WITH {_GELTNER} SELECT sid, dt, round(phi, 6) + 0.0 AS phi, round(truth, 6) + 0.0 AS truth FROM tr")
def geltner_desmoothing(spark, d):
    return tr.geltner(t.ret_m(spark, d)).select("sid", "dt", *r6("phi", "truth"))


@query(f"WITH {_GELTNER} SELECT sid, round(stddev_pop(truth) / stddev_pop(r), 6) AS sigma_ratio, round(avg(truth) - avg(r), 6) + 0.0 AS mean_diff, round(covar_pop(truth, r) / var_pop(r), 6) AS beta FROM tr GROUP BY sid")
def desmoothing_diagnostics(spark, d):
    g = tr.geltner(t.ret_m(spark, d)).groupBy("sid")
    out = g.agg(F.try_divide(F.stddev_pop("truth"), F.stddev_pop("r")).alias("sigma_ratio"), (F.avg("truth") - F.avg("r")).alias("mean_diff"), F.try_divide(F.covar_pop("truth", "r"), F.var_pop("r")).alias("beta"))
    return out.select("sid", *r6("sigma_ratio", "mean_diff", "beta"))


@query(
    """WITH RECURSIVE n AS (SELECT sid, dt, r, row_number() OVER (PARTITION BY sid ORDER BY dt) AS i FROM ret_m),
    f AS (SELECT sid, dt, i, r / 0.6 AS truth, CAST(0.0 AS DOUBLE) AS prev FROM n WHERE i = 1 UNION ALL
          SELECT n.sid, n.dt, n.i, (n.r - 0.3 * f.truth - 0.1 * f.prev) / 0.6, f.truth FROM f JOIN n ON n.sid = f.sid AND n.i = f.i + 1)
    SELECT sid, dt, round(truth, 6) + 0.0 AS truth FROM f"""
)
def recovered_truth(spark, d):
    return tr.recover_truth(t.ret_m(spark, d), [0.6, 0.3, 0.1]).select("sid", "dt", *r6("truth"))


@query()
def fitted_smoothing_weights(spark, d):
    """A grid search; tested against a plain loop."""
    fit = tr.fit_smoothing(t.ret_m(spark, d), kmax=2)
    return fit.select("sid", F.col("k").cast("long").alias("k"), F.round(F.col("theta")[0], 6).alias("theta0"), "fell_back")


_BACKFILL = "coalesce(lag(r, {0}) OVER o, first_value(r) OVER o)"


@query(f"SELECT sid, dt, round(0.5 * r + 0.3 * {_BACKFILL.format(1)} + 0.2 * {_BACKFILL.format(2)}, 6) + 0.0 AS reported FROM ret_m WINDOW o AS (PARTITION BY sid ORDER BY dt)")
def smoothing_kernel(spark, d):
    return tr.smooth(t.ret_m(spark, d), [0.5, 0.3, 0.2]).select("sid", "dt", *r6("reported"))


@query(
    """WITH RECURSIVE q AS (SELECT sid, CAST(date_trunc('quarter', dt) AS DATE) AS q, product(1 + r) - 1 AS x FROM ret_m GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY q) AS i FROM q),
    f AS (SELECT sid, q, i, 0.4 * x AS mark FROM n WHERE i = 1 UNION ALL SELECT n.sid, n.q, n.i, 0.4 * n.x + 0.6 * f.mark FROM f JOIN n ON n.sid = f.sid AND n.i = f.i + 1)
    SELECT sid, q, round(mark, 6) + 0.0 AS mark FROM f"""
)
def quarter_end_marks(spark, d):
    return tr.quarter_marks(t.ret_m(spark, d), 0.4).select("sid", "q", *r6("mark"))


@query(
    """WITH d AS (SELECT sid, dt, r - avg(r) OVER (PARTITION BY sid) AS x, count(*) OVER (PARTITION BY sid) AS n FROM ret_m),
    l AS (SELECT sid, n, x, k, lag(x, CAST(k AS INT)) OVER (PARTITION BY sid, k ORDER BY dt) AS y FROM d, (SELECT unnest([1, 2, 3, 4]) AS k)), a AS (SELECT sid, n, k, sum(x * y) / sum(x * x) AS acf FROM l GROUP BY sid, n, k)
    SELECT sid, round(n * (n + 2) * sum(acf * acf / (n - k)), 5) AS q FROM a GROUP BY sid, n"""
)
def ljung_box_statistic(spark, d):
    r = t.ret_m(spark, d)
    return tr.ljung_box(st.autocorrelations(r, range(1, 5), "sid", "dt", "r"), r.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))).select("sid", F.round("q", 5).alias("q"))


@query("SELECT sid, dt, round(ln(v) - avg(ln(v)) OVER (PARTITION BY sid), 6) + 0.0 AS level FROM series_m WHERE v > 0")
def demeaned_log(spark, d):
    from pyspark.sql import Window

    level = F.log("v") - F.avg(F.log("v")).over(Window.partitionBy("sid"))
    return t.series_m(spark, d).where("v > 0").select("sid", "dt", F.round(level, 6).alias("level"))


@query("SELECT dt, round(CASE WHEN dt < DATE '1998-01-01' THEN a ELSE b END, 2) AS v FROM wide_m WHERE CASE WHEN dt < DATE '1998-01-01' THEN a ELSE b END IS NOT NULL")
def cutover_union(spark, d):
    """One series before a date, another from it on."""
    s = t.series_m(spark, d)
    before, after = s.where("sid = '1-URGENT' AND dt < DATE '1998-01-01'"), s.where("sid = '2-HIGH' AND dt >= DATE '1998-01-01'")
    return before.select("dt", F.round("v", 2).alias("v")).unionByName(after.select("dt", F.round("v", 2).alias("v")))


@query()
def benchmarked_paths(spark, d):
    """Monthly paths moved so that their years meet an anchor; tested for its conditions."""
    e = t.ensemble(spark, d).withColumn("anchor", F.lit(0.01))
    return tr.denton(e, "path", "m", "r", "anchor").select("path", "m", *r6("benchmarked"))
