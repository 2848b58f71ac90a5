"""Event, text and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import events as ev, neighbours, regimes, resample as rs, texts as tx, windows as w
from . import tables as t
from .registry import ORACLE_SQL, query
from .windows_q import r6


@query(
    """WITH s AS (SELECT sid, dt, r, CASE WHEN count(r) OVER f = 12 AND stddev_pop(r) OVER f > 0 THEN stddev_pop(r) OVER f END AS sigma FROM ret_m WINDOW f AS (PARTITION BY sid ORDER BY dt ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
    SELECT sid, dt, round(r, 6) + 0.0 AS r, round(r / sigma, 5) AS severity FROM s WHERE abs(r) > 1.5 * sigma"""
)
def big_moves(spark, d):
    return ev.big_moves(t.ret_m(spark, d), 1.5, 12).select("sid", "dt", *r6("r"), F.round("severity", 5).alias("severity"))


_TIER = "CASE WHEN v >= {0} THEN 1 ELSE 0 END"


@query(
    f"""WITH t AS (SELECT sid, dt, v, {' + '.join(_TIER.format(c) for c in (40, 50, 60))} AS tier FROM series_d), p AS (SELECT *, lag(tier) OVER (PARTITION BY sid ORDER BY dt) AS prior FROM t)
    SELECT sid, dt, tier, prior, CASE WHEN tier > prior THEN 'up' ELSE 'down' END AS direction FROM p WHERE tier <> prior"""
)
def tier_changes(spark, d):
    return ev.tier_changes(t.series_d(spark, d), [40, 50, 60]).select("sid", "dt", "tier", "prior", "direction")


@query(
    """WITH s AS (SELECT sid, dt, CASE WHEN r < -0.05 THEN 'below' WHEN r > 0.05 THEN 'above' END AS state FROM ret_m), k AS (SELECT *, lag(state) OVER (PARTITION BY sid ORDER BY dt) AS prior FROM s WHERE state IS NOT NULL)
    SELECT sid, dt, state, prior FROM k WHERE state <> prior"""
)
def hysteresis_flips(spark, d):
    return ev.hysteresis(t.ret_m(spark, d), 0.05, value="r").select("sid", "dt", "state", "prior")


@query(
    """WITH p AS (SELECT sid, dt, v, max(v) OVER (PARTITION BY sid ORDER BY dt) AS peak FROM series_m), e AS (SELECT *, sum(CASE WHEN v >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY dt) AS episode FROM p),
    x AS (SELECT *, unnest([0.05, 0.1, 0.2]) AS milestone FROM e) SELECT sid, CAST(episode AS BIGINT) AS episode, CAST(milestone AS DOUBLE) AS milestone, min(dt) AS dt FROM x WHERE 1 - v / peak >= milestone GROUP BY 1, 2, 3"""
)
def drawdown_milestones(spark, d):
    return ev.milestones(t.series_m(spark, d), [0.05, 0.1, 0.2])


@query(
    """WITH h AS (SELECT sid, dt, v, coalesce(v >= max(v) OVER (PARTITION BY sid ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS high FROM series_m),
    n AS (SELECT *, sum(CASE WHEN high THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY dt) AS run FROM h), l AS (SELECT sid, run, min(v) AS low, max(v) AS top FROM n GROUP BY 1, 2)
    SELECT n.sid, n.dt, round(1 - low / top, 6) AS depth FROM n JOIN l ON n.sid = l.sid AND n.run = l.run + 1 WHERE high AND 1 - low / top >= 0.1"""
)
def recoveries(spark, d):
    return ev.recoveries(t.series_m(spark, d), 0.1).select("sid", "dt", *r6("depth"))


@query(
    """WITH l AS (SELECT sid, dt, v, lag(v, 1) OVER o AS a, lag(v, 2) OVER o AS b FROM series_d WINDOW o AS (PARTITION BY sid ORDER BY dt))
    SELECT sid, dt, round(a + 0.5 * (a - b), 10) + 0.0 AS consensus, round((v - a - 0.5 * (a - b)) / 10, 10) + 0.0 AS severity FROM l WHERE b IS NOT NULL"""
)
def release_surprises(spark, d):
    return ev.surprises(t.series_d(spark, d), 0.5, 10.0).select("sid", "dt", *(F.round(c, 10).alias(c) for c in ("consensus", "severity")))


@query(
    """WITH e AS (SELECT event_id, event_type AS slot, CAST(ts AS DATE) AS dt, value - 50 AS severity FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY dt, slot ORDER BY abs(severity) DESC, event_id) AS i, count(*) OVER (PARTITION BY dt, slot) - 1 AS losers FROM e)
    SELECT dt, slot, event_id, round(severity, 6) + 0.0 AS severity, losers FROM k WHERE i = 1"""
)
def slot_contest(spark, d):
    e = t.read(spark, d, "events").select("event_id", F.col("event_type").alias("slot"), F.col("ts").cast("date").alias("dt"), (F.col("value") - 50).alias("severity"))
    return ev.contest(e, ["dt", "slot"], "severity", ["event_id"]).select("dt", "slot", "event_id", *r6("severity"), "losers")


#: Sizes from which an event is severe, and very severe.
CUTS = (2.0, 3.0)
_STREAMS = {
    "E01": ("big_moves", "severity", "'return ' || CASE WHEN r < 0 THEN 'down' ELSE 'up' END"),
    "E02": ("hysteresis_flips", "CAST(NULL AS DOUBLE)", "prior || ' to ' || state"),
    "E03": ("drawdown_milestones", "milestone * 20", "'fall'"),
    "E04": ("recoveries", "depth * 20", "'recovered'"),
}
_DETECTED = " UNION ALL ".join(f"SELECT sid, dt, '{cls}' AS cls, CAST({size} AS DOUBLE) AS size, {label} AS label FROM ({ORACLE_SQL[name]})" for cls, (name, size, label) in _STREAMS.items())


def _streams(spark, d):
    return {cls: ({"big_moves": big_moves, "hysteresis_flips": hysteresis_flips, "drawdown_milestones": drawdown_milestones, "recoveries": recoveries}[name](spark, d), F.expr(size), F.expr(label)) for cls, (name, size, label) in _STREAMS.items()}


@query(
    f"""SELECT sid, dt, CAST(row_number() OVER (PARTITION BY sid ORDER BY dt NULLS FIRST, cls, size NULLS FIRST, label) AS INTEGER) AS place, cls, round(size, 5) + 0.0 AS size,
       1 + CASE WHEN abs(size) >= {CUTS[0]} THEN 1 ELSE 0 END + CASE WHEN abs(size) >= {CUTS[1]} THEN 1 ELSE 0 END AS severity, label, CAST(NULL AS VARCHAR) AS fault FROM ({_DETECTED})"""
)
def event_stream(spark, d):
    """Moves, flips, falls and recoveries of each priority as one numbered stream."""
    return ev.detected(_streams(spark, d), CUTS).withColumn("size", F.round("size", 5) + 0.0)


@query(
    f"""SELECT s.sid, array_to_string(list_sort(list_filter({list(_STREAMS)}, lambda c: NOT list_contains(coalesce(f, []), c))), ',') AS classes
FROM (SELECT DISTINCT sid FROM series_m) s LEFT JOIN (SELECT sid, list(DISTINCT cls) AS f FROM ({_DETECTED}) WHERE size > 2 OR size < -2 OR size IS NULL GROUP BY sid) e ON e.sid = s.sid"""
)
def uncovered_events(spark, d):
    """Classes of which a priority never had a severe event, or none at all."""
    severe = ev.detected(_streams(spark, d), CUTS).where("size > 2 OR size < -2 OR size IS NULL")
    return ev.uncovered(severe, t.series_m(spark, d), list(_STREAMS)).select("sid", F.array_join("classes", ",").alias("classes"))


@query("SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 50")
def top_words(spark, d):
    return tx.top_terms(t.read(spark, d, "documents"), "text", 50)


@query(
    """WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents)
    SELECT term, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM w WHERE len(ws) >= 2) GROUP BY term ORDER BY n DESC, term LIMIT 50"""
)
def top_bigrams(spark, d):
    return tx.top_terms(t.read(spark, d, "documents"), "text", 50, 2)


@query(
    """WITH j AS (SELECT regexp_matches(text, '!!') AS p, quality AS l, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
    m AS (SELECT *, sum(n) OVER (PARTITION BY p) AS x, sum(n) OVER (PARTITION BY l) AS y, sum(n) OVER () AS t FROM j) SELECT round(sum(n / t * log2(n * t / (x * y))), 6) + 0.0 AS bits FROM m"""
)
def token_label_information(spark, d):
    docs = t.read(spark, d, "documents").join(t.read(spark, d, "labels"), "doc_id")
    return tx.mutual_information(docs, F.col("text").rlike("!!"), F.col("quality")).select(*r6("bits"))


@query(
    """WITH x AS (SELECT item_id, text FROM benchmark), r AS (SELECT * FROM (VALUES ('dot', '[.]'), ('the', '(?:^|[^a-z])the(?:[^a-z]|$)'), ('line', '\n'), ('digit', '[0-9]')) r(rule, p))
    SELECT item_id, rule, regexp_matches(text, p) AS hit FROM x, r""".replace("\\n", "' || chr(10) || '")
)
def text_gate(spark, d):
    rules = {"dot": "[.]", "the": "(?:^|[^a-z])the(?:[^a-z]|$)", "line": "\n", "digit": "[0-9]"}
    return tx.gate(t.read(spark, d, "benchmark").select("item_id", "text"), "text", rules).select("item_id", "rule", "hit")


@query(
    """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS name,
    regexp_replace(trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), '( (steel|brass|tin|copper|nickel))+$', '') AS kind FROM part"""
)
def normalized_names(spark, d):
    kind = tx.without_suffixes(tx.normalized(F.col("p_type")), ["steel", "brass", "tin", "copper", "nickel"])
    return t.read(spark, d, "part").select("p_partkey", tx.normalized(F.col("p_name")).alias("name"), kind.alias("kind"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, substr(sha256(props), 1, 16) AS tag FROM events")
def json_fields(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return t.read(spark, d, "events").select("event_id", k.alias("k"), F.substring(F.sha2("props", 256), 1, 16).alias("tag"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END || printf('%.1f', CAST(round(CAST(abs(c_acctbal) AS DECIMAL(18, 2)), -1) AS DOUBLE) / 100) || '%' AS pct,
    'Y' || (c_custkey // 12 + 1) || 'M' || (c_custkey % 12 + 1) AS dateline FROM customer"""
)
def formatted_values(spark, d):
    """Signed percentages, whose halves go away from zero, and years and months of an ordinal."""
    key = F.col("c_custkey")
    dateline = F.concat(F.lit("Y"), (F.floor(key / 12) + 1).cast("string"), F.lit("M"), (key % 12 + 1).cast("string"))
    return t.read(spark, d, "customer").select("c_custkey", scalars.signed_percent(F.col("c_acctbal")).alias("pct"), dateline.alias("dateline"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations WHERE turn < 4 GROUP BY conv_id")
def revealed_turns(spark, d):
    """What is revealed up to a pointer, in order."""
    c = t.read(spark, d, "conversations").where("turn < 4").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("s"), F.count(F.lit(1)).alias("turns"))
    return c.select("conv_id", F.array_join(F.transform("s", lambda x: x["role"]), ">").alias("roles"), "turns")


_UNIT = "CAST(('0x' || substr(md5('{0}:{1}:' || {2}), 1, 8)) AS BIGINT) / 4294967296.0"
_CELL = "sid || ':' || path || ':' || m"
_PATHS = 1000
_DRAWS = f"""h AS (SELECT sid, dt, r, row_number() OVER (PARTITION BY sid ORDER BY dt) - 1 AS i FROM ret_m), c AS (SELECT sid, count(*) AS n FROM h GROUP BY sid),
    g AS (SELECT sid, n, path, unnest(range(0, n)) AS m FROM c, (SELECT unnest(range(0, {_PATHS})) AS path)),
    s AS (SELECT sid, n, path, m, CASE WHEN m = 0 OR {_UNIT.format(7, 'restart', _CELL)} < 1 / 6.0 THEN m END AS since, CAST(floor({_UNIT.format(7, 'start', _CELL)} * n) AS BIGINT) AS start FROM g),
    l AS (SELECT sid, path, m, n, last_value(since IGNORE NULLS) OVER w AS since, last_value(CASE WHEN since IS NOT NULL THEN start END IGNORE NULLS) OVER w AS start FROM s WINDOW w AS (PARTITION BY sid, path ORDER BY m)),
    dr AS (SELECT sid, path, m, (start + m - since) % n AS "row" FROM l)"""


def draws(spark, d):
    """The reference count of resamples of every series, each as long as its history."""
    history = rs.numbered(t.ret_m(spark, d), ["sid"], "dt")
    return history, rs.block_draws(spark, _PATHS, history.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), 1 / 6, 7)


@query(f'WITH {_DRAWS} SELECT sid, path, m, "row" FROM dr')
def block_bootstrap_draws(spark, d):
    return draws(spark, d)[1]


@query(
    f"""WITH {_DRAWS}, x AS (SELECT dr.sid, path, avg(r) AS mean FROM dr JOIN h ON dr.sid = h.sid AND dr."row" = h.i GROUP BY dr.sid, path)
    SELECT sid, round(quantile_cont(mean, 0.05), 6) + 0.0 AS lo, round(quantile_cont(mean, 0.95), 6) + 0.0 AS hi, count(*) AS n FROM x GROUP BY sid"""
)
def bootstrap_band(spark, d):
    """Percentile band of the mean over resampled histories of every series."""
    history, index = draws(spark, d)
    means = rs.resampled(index, history).groupBy("sid", "path").agg(F.avg("r").alias("mean"))
    return rs.bands(means, ["sid"], "mean", 0.9).select("sid", *r6("lo", "hi"), "n")


_STRATA = f"""r AS (SELECT row_number() OVER (ORDER BY dt) - 1 AS "row", dt, a, CASE WHEN a < -0.05 THEN 'down' WHEN a > 0.05 THEN 'up' ELSE 'flat' END AS label FROM ret_w WHERE a IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "row") - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM r),
    w AS (SELECT path, k."row" AS m, label, CAST(floor({_UNIT.format(5, 'row', "path || ':' || k." + '"row"')} * n) AS BIGINT) AS i FROM k, (SELECT unnest(range(0, 200)) AS path)),
    sd AS (SELECT w.path, w.m, w.label, k."row" FROM w JOIN k ON w.label = k.label AND w.i = k.i)"""


#: Resampled worlds, of which a tenth is reported.
PATHS = 200


def _strata(spark, d):
    r = t.ret_w(spark, d).where("a IS NOT NULL").select("dt", "a", F.when(F.col("a") < -0.05, "down").when(F.col("a") > 0.05, "up").otherwise("flat").alias("label"))
    rows = rs.numbered(r, [], "dt")  # one row a month
    return rows, rs.stratified_draws(spark, rows.select(F.col("row").alias("m"), "label"), rows.select("row", "label"), PATHS, 5)


@query(f'WITH {_STRATA} SELECT path, m, label, "row" FROM sd')
def stratified_bootstrap_draws(spark, d):
    """Months resampled from months of the same regime."""
    return _strata(spark, d)[1]


@query(
    f"""WITH {_STRATA}, x AS (SELECT sd.path, sd.m, sum(k.a) OVER (PARTITION BY sd.path ORDER BY sd.m ROWS 11 PRECEDING) AS s, count(*) OVER (PARTITION BY sd.path ORDER BY sd.m ROWS 11 PRECEDING) AS c FROM sd JOIN k ON sd."row" = k."row"),
    y AS (SELECT path, min(s) AS worst FROM x WHERE c = 12 GROUP BY path), z AS (SELECT path, worst, row_number() OVER (ORDER BY worst, path) AS i FROM y)
    SELECT path, round(worst, 6) + 0.0 AS worst FROM z WHERE i <= 20"""
)
def stress_paths(spark, d):
    """Of the resampled worlds, the tenth with the most severe twelve months: a report."""
    rows, drawn = _strata(spark, d)
    both = drawn.join(rows.select("row", "a"), "row")
    year = w.rolling_sums(both, 12, "path", "m", "a").groupBy("path").agg(F.min("s").alias("worst"))
    return year.orderBy("worst", "path").limit(PATHS // 10).select("path", *r6("worst"))


@query(
    """WITH b AS (SELECT sid, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM ret_m WHERE year(dt) < 1998 GROUP BY sid)
    SELECT r.sid, count(*) FILTER (r < lo OR r > hi) AS outside, round(min(least(r - lo, hi - r)), 6) + 0.0 AS distance FROM ret_m r LEFT JOIN b ON r.sid = b.sid AND b.sid <> '5-LOW' WHERE year(dt) >= 1998 GROUP BY r.sid"""
)
def outside_band(spark, d):
    r = t.ret_m(spark, d)
    band = rs.bands(r.where("year(dt) < 1998"), ["sid"], "r", 0.9).where("sid <> '5-LOW'")
    both = r.where("year(dt) >= 1998").join(F.broadcast(band), "sid", "left")
    out = F.count(F.when(rs.outside(F.col("r"), F.col("lo"), F.col("hi")), 1))
    gap = F.when(F.col("lo").isNotNull(), F.least(F.col("r") - F.col("lo"), F.col("hi") - F.col("r")))
    return both.groupBy("sid").agg(out.alias("outside"), F.round(F.min(gap), 6).alias("distance"))


@query("SELECT quality = 1 AS predicted, toxic = 1 AS actual, count(*) AS n FROM labels GROUP BY 1, 2")
def label_confusion(spark, d):
    return regimes.confusion(t.read(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query(
    """WITH n AS (SELECT event_type, count(*) FILTER (day(ts) <= 15) AS x, count(*) FILTER (day(ts) > 15) AS y FROM events GROUP BY 1)
    SELECT round(sum(abs(x / (SELECT sum(x) FROM n) - y / (SELECT sum(y) FROM n))) / 2, 6) AS tv FROM n"""
)
def total_variation(spark, d):
    return regimes.total_variation(t.read(spark, d, "events"), "event_type", F.dayofmonth("ts") <= 15).select(*r6("tv"))


@query("SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS wk, round(avg(value), 6) AS mean, max_by(value, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_aggregates(spark, d):
    """Daily to weekly: mean and last value."""
    e = t.read(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("week", "ts").cast("date").alias("wk")).agg(F.round(F.avg("value"), 6).alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM s) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS events FROM k GROUP BY user_id"""
)
def session_counts(spark, d):
    e = t.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))


@query(
    """WITH a AS (SELECT doc_id % 2 AS arm, source AS world, avg(n_chars) AS x FROM documents GROUP BY 1, 2), p AS (SELECT world, max(x) FILTER (arm = 1) - max(x) FILTER (arm = 0) AS d FROM a GROUP BY world)
    SELECT count(*) AS worlds, round(avg(d), 4) + 0.0 AS effect, round(stddev_samp(d), 4) AS spread FROM p WHERE d IS NOT NULL"""
)
def paired_effect(spark, d):
    """Mean difference of two arms paired by world."""
    docs = t.read(spark, d, "documents")
    arm = lambda k: F.avg(F.when(F.col("doc_id") % 2 == k, F.col("n_chars")))
    pairs = docs.groupBy("source").agg((arm(1) - arm(0)).alias("d")).where("d IS NOT NULL")
    return pairs.agg(F.count(F.lit(1)).alias("worlds"), F.round(F.avg("d"), 4).alias("effect"), F.round(F.stddev_samp("d"), 4).alias("spread"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT a.vec_id, round(min(sqrt(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: pow(a.e[i] - b.e[i], 2))))), 5) AS distance FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id"""
)
def nearest_neighbour_distance(spark, d):
    """Every hundredth vector against all others, block by block of queries, one matrix product a batch of candidates."""
    v = t.read(spark, d, "embeddings")
    return neighbours.nearest(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding").select("vec_id", F.round("distance", 5).alias("distance"))
