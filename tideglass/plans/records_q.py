"""Queries over records: differences of documents, digests, and delivered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digests as dg, documents as doc, rules as ru
from ..sources import decisions as dec, intake
from . import tables as t
from .registry import query

#: A nation's customers and its suppliers as two versions of one document.
_SIDES = {"customer": ("c_nationkey", "c_acctbal", "c_name"), "supplier": ("s_nationkey", "s_acctbal", "s_name")}


def _documents(spark, d, table):
    key, balance, name = _SIDES[table]
    rows = t.read(spark, d, table).groupBy(F.col(key).alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("first"), F.max(name).alias("last"), F.count_if(F.col(balance) < 0).alias("owing"))
    body = F.struct(
        F.struct(F.col("n").alias("all"), F.when(F.col("owing") > 0, F.col("owing")).alias("in debt")).alias("count"),
        F.when(F.col("n") > 2, F.array("first", "last")).otherwise(F.array("first")).alias("names"), (F.col("owing") == 0).alias("sound"),
    )
    return rows.select("nation", F.to_json(body).alias("document"))


_LEAVES = """SELECT {0} AS nation, count(*) AS n, min({2}) AS a, max({2}) AS z, count(*) FILTER ({1} < 0) AS owing FROM {3} GROUP BY 1"""
_FLAT = """SELECT nation, unnest([{{'p': '$.count.all', 'k': 'number', 'v': CAST(n AS VARCHAR)}}, {{'p': '$.count["in debt"]', 'k': 'number', 'v': CASE WHEN owing > 0 THEN CAST(owing AS VARCHAR) END}},
  {{'p': '$.names[0]', 'k': 'string', 'v': a}}, {{'p': '$.names[1]', 'k': 'string', 'v': CASE WHEN n > 2 THEN z END}}, {{'p': '$.sound', 'k': 'boolean', 'v': CASE WHEN owing = 0 THEN 'true' ELSE 'false' END}}]) AS u FROM ({0})"""
_BOTH = ", ".join(f"{name} AS (SELECT nation, u.p AS path, u.k AS kind, u.v AS value FROM ({_FLAT.format(_LEAVES.format(*_SIDES[table], table))}) WHERE u.v IS NOT NULL)" for name, table in (("old", "customer"), ("new", "supplier")))


@query(
    f"""WITH {_BOTH} SELECT coalesce(o.nation, w.nation) AS nation, coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
       o.kind AS old_kind, o.value AS old_value, w.kind AS new_kind, w.value AS new_value FROM old o FULL JOIN new w ON o.nation = w.nation AND o.path = w.path WHERE o.value IS DISTINCT FROM w.value"""
)
def document_differences(spark, d):
    return doc.difference(_documents(spark, d, "customer"), _documents(spark, d, "supplier"), ["nation"])


_ROW = """SELECT path, CAST(floor(m / 12) AS BIGINT) AS block, sha256(string_agg(length(x) || ':' || x, '' ORDER BY i)) AS h FROM (SELECT path, m, unnest([1, 2, 3, 4]) AS i,
  unnest(['=' || path, '=' || m, {0}, {1}]) AS x FROM ensemble) GROUP BY path, m"""
_NUMBER = "coalesce('=' || CAST(CAST(round({0}, 12) AS DECIMAL(38, 12)) AS VARCHAR), '-')"
_DIGESTS = f"""WITH rows_ AS ({_ROW.format(_NUMBER.format("r"), _NUMBER.format("g"))}),
blocks AS (SELECT path, block, count(*) AS rows, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM rows_ GROUP BY path, block)"""


def _blocked(spark, d):
    rows = t.ensemble(spark, d).select("path", "m", "r", "g")
    return rows.withColumn("block", F.floor(F.col("m") / 12))


@query(_DIGESTS + " SELECT * FROM blocks")
def block_digests(spark, d):
    """A digest of each year of each path."""
    return dg.block_digests(_blocked(spark, d), ["path", "block"], ["path", "m", "r", "g"])


@query(
    _DIGESTS
    + """, leaves AS (SELECT sha256(length('=' || path) || ':=' || path || length('=' || block) || ':=' || block || digest) AS d, rows FROM blocks),
one AS (SELECT left(d, 5) AS p, sha256(string_agg(d, '' ORDER BY d)) AS d, count(*) AS blocks, sum(rows) AS rows FROM leaves GROUP BY 1),
two AS (SELECT left(p, 2) AS p, sha256(string_agg(p || d, '' ORDER BY p || d)) AS d, sum(blocks) AS blocks, sum(rows) AS rows FROM one GROUP BY 1)
SELECT CAST(coalesce(sum(blocks), 0) AS BIGINT) AS blocks, CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows, 'sha256:' || sha256(coalesce(string_agg(p || d, '' ORDER BY p || d), '')) AS digest FROM two"""
)
def table_digest(spark, d):
    return dg.root_digest(dg.block_digests(_blocked(spark, d), ["path", "block"], ["path", "m", "r", "g"]), ["path", "block"])


@query(
    """SELECT 'desk.' || o_orderpriority AS series_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, round(avg(o_totalprice) / 1e6, 8) AS value FROM orders GROUP BY 1, 2"""
)
def delivered_series(spark, d):
    """Quarters of a delivered table as series of their own."""
    orders = t.read(spark, d, "orders")
    quarter = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    drop = orders.groupBy(quarter.alias("period"), F.col("o_orderpriority").alias("strategy")).agg(F.round(F.avg("o_totalprice") / 1e6, 8).alias("ret"))
    return intake.series_frames(drop, "desk", "strategy")


ACTIONS = ("click", "purchase", "view")
#: A user's events ask for decisions on their day; every third day from one of the first three is a window.
_REQUESTS = f"""
WITH RECURSIVE q AS (SELECT user_id AS session, event_id AS seq, CAST(day(ts) - 1 AS BIGINT) AS month, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, list_transform(range(10), lambda k: user_id % 3 + 3 * k) AS ws FROM events),
f AS (SELECT session, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS c, NULL::BIGINT AS seq, NULL::BIGINT AS month, NULL::VARCHAR AS action, NULL::VARCHAR AS fault FROM (SELECT DISTINCT session FROM q)
      UNION ALL SELECT session, i, c + CASE WHEN fault IS NULL THEN 1 ELSE 0 END, seq, month, action, fault
      FROM (SELECT q.session, q.i, f.c, q.seq, q.month, q.action, CASE WHEN q.action NOT IN {ACTIONS} THEN 'unknown action' WHEN NOT list_contains(ws, q.month) THEN 'not a window' WHEN list_position(ws, q.month) <= f.c THEN 'already decided'
            WHEN list_position(ws, q.month) > f.c + 1 THEN 'out of order' END AS fault FROM f JOIN q ON q.session = f.session AND q.i = f.i + 1))
"""


def _judged(spark, d):
    events = t.read(spark, d, "events")
    requests = events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.day("ts") - 1).cast("long").alias("month"), F.col("event_type").alias("action"))
    days = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("session") % 3 + 3 * k)
    windows = requests.select("session").distinct().withColumn("windows", days).withColumn("months", F.lit(31).cast("long"))
    return dec.judged(requests, windows, ACTIONS), windows


@query(_REQUESTS + "SELECT session, seq, month, action, fault FROM f WHERE i > 0")
def judged_decisions(spark, d):
    return _judged(spark, d)[0]


@query(_REQUESTS + "SELECT session, max(c) AS decided, CASE WHEN max(c) < 10 THEN session % 3 + 3 * max(c) END AS next_window, CASE WHEN max(c) < 10 THEN session % 3 + 3 * max(c) + 1 ELSE 31 END AS ceiling FROM f GROUP BY session")
def reveal_ceilings(spark, d):
    return dec.ceilings(*_judged(spark, d))


#: A customer's document: a balance with its bounds, a horizon of some quarters, and a window for each order.
_SCHEMA = "horizon struct<quarters:bigint>, credit struct<balance:double,share:double>, windows array<struct<start:bigint,length:bigint>>"
_BOUNDS = {"/credit/balance": (0.0, 8000.0), "/credit/share": (None, 0.5), "/windows/*/length": (2, 7)}


def _plans(spark, d):
    orders = t.read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.month("o_orderdate") - 1).cast("long").alias("start"), (1 + F.col("o_orderkey") % 9).alias("length")))).alias("w"))
    customers = t.read(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    body = F.struct(
        F.struct(F.when(F.col("c_nationkey") % 7 != 0, 6 + F.col("c_nationkey") % 5).cast("long").alias("quarters")).alias("horizon"), F.struct(F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 10 / 10).alias("share")).alias("credit"),
        F.transform("w", lambda x: F.struct(x.start.alias("start"), x.length.alias("length"))).alias("windows"),
    )
    return customers.select("c_custkey", F.from_json(F.to_json(body), _SCHEMA).alias("doc"))


def _checked(spark, d):
    """The documents within bounds, with all clamps."""
    docs = ru.clamped(_plans(spark, d), "doc", _BOUNDS)
    windows, moved = ru.windows_inside(F.col("doc.windows"), F.col("doc.horizon.quarters"), "/windows")
    return docs.withColumn("clamps", F.concat("clamps", moved)).withColumn("doc", F.col("doc").withField("windows", windows))


_PLANS = """w AS (SELECT o_custkey AS c_custkey, o_orderkey, month(o_orderdate) - 1 AS start, 1 + o_orderkey % 9 AS len, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
h AS (SELECT c_custkey, c_acctbal, c_custkey % 10 / 10 AS share, CASE WHEN c_nationkey % 7 <> 0 THEN 6 + c_nationkey % 5 END AS q FROM customer),
w1 AS (SELECT w.*, q, least(greatest(len, 2), 7) AS l1 FROM w JOIN h USING (c_custkey)), w2 AS (SELECT *, CASE WHEN q IS NULL THEN l1 ELSE least(l1, q) END AS l2 FROM w1),
w3 AS (SELECT *, CASE WHEN start + l2 > q THEN greatest(0, q - l2) ELSE start END AS s2 FROM w2),
cl AS (SELECT c_custkey, '/credit/balance' AS path, c_acctbal AS submitted, least(greatest(c_acctbal, 0), 8000) AS applied FROM h WHERE c_acctbal < 0 OR c_acctbal > 8000 UNION ALL SELECT c_custkey, '/credit/share', share, 0.5 FROM h WHERE share > 0.5
  UNION ALL SELECT c_custkey, '/windows/' || i || '/length', len, l1 FROM w3 WHERE l1 <> len UNION ALL SELECT c_custkey, '/windows/' || i || '/length', l1, l2 FROM w3 WHERE l2 <> l1 UNION ALL SELECT c_custkey, '/windows/' || i || '/start', start, s2 FROM w3 WHERE s2 <> start)"""


@query(f"WITH {_PLANS} SELECT c_custkey, path, CAST(submitted AS DOUBLE) AS submitted, CAST(applied AS DOUBLE) AS applied FROM cl")
def clamped_documents(spark, d):
    return _checked(spark, d).select("c_custkey", F.explode("clamps").alias("c")).select("c_custkey", "c.path", "c.submitted", "c.applied")


def _rules() -> list[ru.Rule]:
    windows, apart = F.col("doc.windows"), lambda x: x.start + x.length
    total = F.aggregate(windows, F.lit(0).cast("long"), lambda a, x: a + x.length)
    return [
        ru.Rule("B1", True, F.forall(windows, lambda x: apart(x) <= F.col("doc.horizon.quarters")), F.lit("a window beyond the horizon")),
        ru.Rule("B2", True, F.size(F.array_distinct(F.transform(windows, lambda x: x.start))) == F.size(windows), F.lit("windows that begin together")),
        ru.Rule("W1", False, F.size("clamps") <= ru.HEAVY, F.concat(F.size("clamps").cast("string"), F.lit(" clamps"))),
        ru.Rule("W2", False, F.when(F.col("doc.horizon.quarters").isNotNull(), total <= 3 * F.col("doc.horizon.quarters")), F.concat(total.cast("string"), F.lit(" quarters of windows"))),
    ]


_VERDICTS = f"""WITH {_PLANS}, n AS (SELECT c_custkey, count(*) AS n FROM cl GROUP BY 1), g AS (SELECT c_custkey, count(*) AS k, count(DISTINCT s2) AS starts, sum(l2) AS total, max(s2 + l2) AS last FROM w3 GROUP BY 1),
x AS (SELECT h.c_custkey, q, k, starts, total, last, coalesce(n, 0) AS n FROM h LEFT JOIN n USING (c_custkey) LEFT JOIN g USING (c_custkey)),
v AS (SELECT c_custkey, 'B1' AS rule, true AS blocking, last <= q AS holds, 'a window beyond the horizon' AS said FROM x UNION ALL SELECT c_custkey, 'B2', true, starts = k, 'windows that begin together' FROM x
  UNION ALL SELECT c_custkey, 'W1', false, n <= {ru.HEAVY}, n || ' clamps' FROM x UNION ALL SELECT c_custkey, 'W2', false, total <= 3 * q, total || ' quarters of windows' FROM x)"""


@query(_VERDICTS + " SELECT c_custkey, rule, blocking, CASE WHEN holds IS NULL THEN 'not evaluated' WHEN holds THEN 'passed' ELSE 'failed' END AS verdict, CASE WHEN NOT holds THEN said END AS message FROM v")
def document_verdicts(spark, d):
    return ru.judged(_checked(spark, d), ["c_custkey"], _rules())


@query(
    _VERDICTS
    + """ SELECT c_custkey, count(*) FILTER (blocking AND NOT holds) = 0 AS accepted, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (blocking AND NOT holds), '') AS refusals,
    coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (NOT blocking AND NOT holds), '') AS warnings, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (holds IS NULL), '') AS untold FROM v GROUP BY c_custkey"""
)
def document_decisions(spark, d):
    out = ru.decided(_checked(spark, d), ["c_custkey"], _rules())
    return out.select("c_custkey", "accepted", *[F.array_join(c, ",").alias(c) for c in ("refusals", "warnings", "untold")])
