"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` may start from the common tables named in it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return add


#: Common tables over the test tables; ``tables`` has the same as DataFrames. Each may name earlier ones.
TABLES = {
    "series_m": """SELECT o_orderpriority AS sid, CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2""",
    "ret_m": """SELECT sid, dt, v / prev - 1 AS r FROM (SELECT *, lag(v) OVER (PARTITION BY sid ORDER BY dt) AS prev FROM series_m) WHERE prev IS NOT NULL""",
    "wide_m": """SELECT dt, max(v) FILTER (sid = '1-URGENT') AS a, max(v) FILTER (sid = '2-HIGH') AS b, max(v) FILTER (sid = '3-MEDIUM') AS c FROM series_m GROUP BY dt""",
    "ret_w": """SELECT dt, max(r) FILTER (sid = '1-URGENT') AS a, max(r) FILTER (sid = '2-HIGH') AS b, max(r) FILTER (sid = '3-MEDIUM') AS c FROM ret_m GROUP BY dt""",
    "series_d": """SELECT event_type AS sid, CAST(ts AS DATE) AS dt, round(avg(value), 8) AS v, max_by(value, (ts, event_id)) AS last_v, min(value) AS low, max(value) AS high,
                          min_by(value, (ts, event_id)) AS first_v FROM events GROUP BY 1, 2""",
    "ensemble": """SELECT l_linenumber AS path, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 - 1995 * 12 AS BIGINT) AS m,
                          round(sum(l_extendedprice * (l_discount - 0.05)) / sum(l_extendedprice), 8) AS r, round(avg(l_tax) - 0.04, 8) AS g FROM lineitem GROUP BY 1, 2""",
    "obs_vintage": """SELECT o.o_orderpriority AS sid, y.vintage, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS dt, round(sum(o.o_totalprice), 2) AS v
                      FROM orders o JOIN (SELECT DISTINCT year(o_orderdate) AS vintage FROM orders) y ON year(o.o_orderdate) <= y.vintage
                      WHERE NOT (year(o.o_orderdate) = y.vintage AND o.o_orderkey % 10 = 0) GROUP BY 1, 2, 3""",
}


def with_tables(sql: str) -> str:
    """``sql`` after the common tables that it needs."""
    import re

    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in TABLES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    head = ", ".join(f"{name} AS ({TABLES[name]})" for name in needed)
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {rest[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {rest[len('WITH'):]}" if rest.upper().startswith("WITH ") else f"WITH {head} {rest}"
