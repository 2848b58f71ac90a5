"""Join, alignment, vintage and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn, windows as w
from ..operators.ranges import quantiles
from . import tables as t
from .registry import query
from .windows_q import r6


def one(spark, d, sid):
    return t.series_m(spark, d).where(F.col("sid") == sid).select("dt", "v")


@query("SELECT dt, round(a + b, 2) AS v FROM wide_m WHERE a IS NOT NULL AND b IS NOT NULL")
def sum_on_common_dates(spark, d):
    return jn.combine(one(spark, d, "1-URGENT"), one(spark, d, "2-HIGH"), F.round(F.col("a") + F.col("b"), 2))


@query("SELECT dt, round(a - b, 2) + 0.0 AS v FROM wide_m WHERE a IS NOT NULL AND b IS NOT NULL AND dt BETWEEN DATE '1996-01-01' AND DATE '1999-12-01'")
def difference_in_window(spark, d):
    gap = jn.combine(one(spark, d, "1-URGENT"), one(spark, d, "2-HIGH"), F.round(F.col("a") - F.col("b"), 2))
    return gap.where(F.col("dt").between("1996-01-01", "1999-12-01"))


@query(
    """WITH k AS (SELECT * FROM series_m WHERE month(dt) <> 7 AND NOT (sid = '2-HIGH' AND year(dt) = 1995)),
    s AS (SELECT sid, CAST(unnest(generate_series(min(dt), (SELECT max(dt) FROM k), INTERVAL 1 MONTH)) AS DATE) AS dt FROM k GROUP BY sid)
    SELECT s.sid, s.dt, k.v, k.v IS NULL AS gap FROM s LEFT JOIN k ON k.sid = s.sid AND k.dt = s.dt"""
)
def month_panel(spark, d):
    return jn.month_panel(t.series_m(spark, d).where("month(dt) <> 7 AND NOT (sid = '2-HIGH' AND year(dt) = 1995)"))


@query(
    """WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'purchase')
    SELECT q.event_id, max_by(p.event_id, (p.ts, p.event_id)) AS fact_id, max_by(p.value, (p.ts, p.event_id)) AS value FROM q LEFT JOIN p ON p.user_id = q.user_id AND p.ts <= q.ts GROUP BY q.event_id"""
)
def as_of_join(spark, d):
    """For each other event, its user's latest purchase by then."""
    e = t.read(spark, d, "events")
    facts = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    facts = facts.groupBy("user_id", "ts").agg(F.max_by(F.struct(F.col("event_id").alias("fact_id"), "value"), "event_id").alias("f")).select("user_id", "ts", "f.*")
    asks = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return jn.as_of(asks, facts, ["user_id"], "ts", "ts", ["fact_id", "value"]).select("event_id", "fact_id", "value")


@query("SELECT sid, vintage, count(*) AS n_obs, min(dt) AS first_dt, max(dt) AS last_dt FROM obs_vintage GROUP BY 1, 2")
def observations_index(spark, d):
    return t.obs_vintage(spark, d).groupBy("sid", "vintage").agg(F.count(F.lit(1)).alias("n_obs"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")).withColumn("vintage", F.col("vintage").cast("long"))


@query("WITH k AS (SELECT * FROM obs_vintage WHERE vintage <= 1998 AND NOT (sid = '5-LOW' AND vintage > 1996)), l AS (SELECT sid, max(vintage) AS vintage FROM k GROUP BY sid) SELECT k.sid, CAST(k.vintage AS BIGINT) AS vintage, k.dt, k.v FROM k JOIN l ON k.sid = l.sid AND k.vintage = l.vintage")
def latest_vintage_read(spark, d):
    """Each series from the newest vintage by 1998 that holds it."""
    known = t.obs_vintage(spark, d).where("vintage <= 1998 AND NOT (sid = '5-LOW' AND vintage > 1996)")
    newest = known.groupBy("sid").agg(F.max("vintage").alias("vintage"))
    return known.join(newest, ["sid", "vintage"]).select("sid", F.col("vintage").cast("long").alias("vintage"), "dt", "v")


_N = "SELECT sid, count(*) AS n FROM obs_vintage WHERE vintage = {} AND sid <> '{}' GROUP BY sid"


@query(
    f"""SELECT coalesce(a.sid, b.sid) AS sid, a.n AS n_a, b.n AS n_b, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN b.n > a.n THEN 'grew' WHEN b.n < a.n THEN 'shrank' ELSE 'same' END AS status
    FROM ({_N.format(1996, '5-LOW')}) a FULL JOIN ({_N.format(1997, '1-URGENT')}) b ON a.sid = b.sid"""
)
def vintage_diff(spark, d):
    n = t.obs_vintage(spark, d).groupBy("sid", "vintage").agg(F.count(F.lit(1)).alias("n"))
    return jn.vintage_diff(n.where("vintage = 1996 AND sid <> '5-LOW'"), n.where("vintage = 1997 AND sid <> '1-URGENT'"))


@query("SELECT b.sid, b.dt, a.v AS before, b.v AS now FROM obs_vintage a JOIN obs_vintage b ON a.sid = b.sid AND a.dt = b.dt WHERE a.vintage = 1997 AND b.vintage = 1998 AND abs(a.v - b.v) > 1e-9")
def revisions(spark, d):
    o = t.obs_vintage(spark, d)
    return jn.revisions(o.where("vintage = 1998"), o.where("vintage = 1997")).select("sid", "dt", "before", "now")


@query(
    """WITH w AS (SELECT DISTINCT o_orderpriority AS sid FROM orders WHERE o_orderpriority <> '3-MEDIUM'), l AS (SELECT sid, max(vintage) AS vintage FROM obs_vintage GROUP BY sid)
    SELECT l.sid, CAST(l.vintage AS BIGINT) AS vintage FROM l WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.sid = l.sid)"""
)
def carry_forward(spark, d):
    """Registered series that a refresh didn't write, with the newest vintage that has them."""
    written = t.read(spark, d, "orders").select(F.col("o_orderpriority").alias("sid")).where("sid <> '3-MEDIUM'").distinct()
    holders = t.obs_vintage(spark, d).groupBy("sid").agg(F.max("vintage").cast("long").alias("vintage"))
    return holders.join(written, "sid", "left_anti")


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 40 AND p_retailprice > 1500) GROUP BY p_brand")
def unmapped_codes(spark, d):
    part = t.read(spark, d, "part")
    return jn.unmapped(part, part.where("p_size > 40 AND p_retailprice > 1500").select("p_brand").distinct(), "p_brand")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def code_lookup(spark, d):
    """Codes to names through two dimension tables, which Spark broadcasts by their size."""
    c, n, r = (t.read(spark, d, x) for x in ("customer", "nation", "region"))
    both = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return both.select("c_custkey", "n_name", "r_name")


@query(
    """WITH k AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1), a AS (SELECT c_nationkey AS nk, lo, hi, c_custkey FROM customer JOIN k ON c_custkey = o_custkey),
    b AS (SELECT nk, min(lo) AS lo, CAST(min(lo) + INTERVAL 400 DAY AS DATE) AS hi FROM a GROUP BY nk)
    SELECT a.nk AS nk, count(*) AS pairs FROM a JOIN b ON a.nk = b.nk AND a.lo < b.hi AND b.lo < a.hi GROUP BY a.nk"""
)
def interval_overlaps(spark, d):
    day = F.col("o_orderdate").cast("date")
    k = t.read(spark, d, "orders").groupBy("o_custkey").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    c = t.read(spark, d, "customer")
    a = c.join(k, c.c_custkey == k.o_custkey).select(F.col("c_nationkey").alias("nk"), "lo", "hi")
    b = a.groupBy("nk").agg(F.min("lo").alias("lo")).withColumn("hi", F.date_add("lo", 400))
    return jn.overlapping(a, b, ["nk"]).groupBy("nk").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT sid, dt, v FROM series_m WHERE (dt >= DATE '1995-01-01' AND dt < DATE '1998-01-01') OR (dt >= DATE '1998-01-01' AND dt < DATE '2000-01-01')")
def train_and_validation(spark, d):
    """Two half-open spans as one filter, which reaches the scan of the months' source."""
    return t.series_m(spark, d).where("(dt >= DATE '1995-01-01' AND dt < DATE '1998-01-01') OR (dt >= DATE '1998-01-01' AND dt < DATE '2000-01-01')")


@query(
    """WITH x AS (SELECT sid, dt, CASE WHEN dt >= DATE '1997-01-01' AND dt < DATE '1997-07-01' THEN 1 ELSE 0 END AS inside FROM series_m),
    i AS (SELECT *, sum(inside) OVER (PARTITION BY sid ORDER BY dt) AS island FROM x) SELECT sid, min(dt) AS lo, max(dt) AS hi, count(*) AS months FROM i WHERE inside = 0 GROUP BY sid, island"""
)
def segments_outside_span(spark, d):
    """Runs of months outside an excluded half-open span."""
    outside = ~((F.col("dt") >= "1997-01-01") & (F.col("dt") < "1997-07-01"))
    return w.islands(t.series_m(spark, d), outside).groupBy("sid", "island").agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"), F.count(F.lit(1)).alias("months")).drop("island")


@query(
    """WITH p AS (SELECT DISTINCT user_id, day(ts) AS dy FROM events WHERE event_type = 'view'), e AS (SELECT DISTINCT user_id, day(ts) AS dy FROM events WHERE event_type = 'click')
    SELECT p.user_id, count(*) AS triggered, count(e.user_id) AS followed, round(count(e.user_id) / count(*), 6) AS adherence FROM p LEFT JOIN e ON p.user_id = e.user_id AND p.dy = e.dy GROUP BY p.user_id"""
)
def plan_adherence(spark, d):
    """Share of triggered rules that were followed."""
    e = t.read(spark, d, "events").select("user_id", "event_type", F.dayofmonth("ts").alias("dy"))
    planned, done = (e.where(F.col("event_type") == x).select("user_id", "dy").distinct() for x in ("view", "click"))
    both = planned.join(done.withColumn("hit", F.lit(1)), ["user_id", "dy"], "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("triggered"), F.count("hit").alias("followed"))
    return both.withColumn("adherence", F.round(F.col("followed") / F.col("triggered"), 6))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS i FROM events) WHERE i <= 3")
def leaderboard(spark, d):
    return jn.first_of(t.read(spark, d, "events"), ["user_id"], [F.desc("value"), "event_id"], 3).select("user_id", "event_id", "value")


@query("SELECT sid, max_by(dt, (v, dt)) AS dt, max(v) AS v FROM series_m GROUP BY sid")
def latest_of_group(spark, d):
    return jn.latest_by(t.series_m(spark, d), ["sid"], F.struct("v", "dt"), ["dt", "v"]).select("sid", "dt", "v")


@query("SELECT path, m, r FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY r, m) AS i, count(*) OVER (PARTITION BY path) AS n FROM ensemble) WHERE i <= greatest(1, n * 10 // 100)")
def worst_share_of_rows(spark, d):
    """The lowest tenth of each path's rows, one at least."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("path"))
    ranked = t.ensemble(spark, d).withColumn("_n", n).withColumn("_i", F.row_number().over(Window.partitionBy("path").orderBy("r", "m")))
    return ranked.where(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 10 / 100))).select("path", "m", "r")


@query("WITH g AS (SELECT path, product(1 + r) AS g FROM ensemble GROUP BY path), q AS (SELECT quantile_cont(g, 0.7) AS q FROM g) SELECT min_by(path, (abs(g - q), path)) AS path, round(min(abs(g - q)), 6) + 0.0 AS gap FROM g, q")
def nearest_to_percentile(spark, d):
    """The path whose end is nearest to a percentile of all ends; ties go to the lowest."""
    g = t.ensemble(spark, d).groupBy("path").agg(F.product(1 + F.col("r")).alias("g"))
    q = quantiles(g, "g", {"q": 0.7}).select("q")
    gap = F.abs(F.col("g") - F.col("q"))
    return g.crossJoin(F.broadcast(q)).agg(F.min_by("path", F.struct(gap, "path")).alias("path"), F.min(gap).alias("gap")).select(F.col("path"), *r6("gap"))


@query("SELECT sid, CAST(year(dt) AS BIGINT) AS y, round(max(v) FILTER (month(dt) = 1), 2) AS jan, round(max(v) FILTER (month(dt) = 7), 2) AS jul FROM series_m GROUP BY 1, 2")
def pivoted_months(spark, d):
    s = t.series_m(spark, d).withColumn("y", F.year("dt").cast("long")).withColumn("mon", F.month("dt"))
    out = s.groupBy("sid", "y").pivot("mon", [1, 7]).agg(F.round(F.max("v"), 2))
    return out.withColumnsRenamed({"1": "jan", "7": "jul"})
