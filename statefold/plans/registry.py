"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The events table as changelogs of value, list and map state.
EVENTS = """ev AS (SELECT user_id AS k, event_type AS uk, strftime(ts, '%Y-%m-%d') AS ns, ts, value, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'DELETE' ELSE 'PUT' END AS vop,
  CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'PUT' ELSE 'APPEND' END AS lop FROM events)"""
VALUES = f"""{EVENTS}, vals AS (SELECT k, arg_max(value, seq) AS value, max(seq) AS seq FROM ev GROUP BY k HAVING arg_max(vop, seq) <> 'DELETE')"""
LISTS = f"""{EVENTS}, resets AS (SELECT k, max(seq) AS r FROM ev WHERE lop <> 'APPEND' GROUP BY k),
lists AS (SELECT ev.k, CAST(row_number() OVER (PARTITION BY ev.k ORDER BY ev.seq) - 1 AS BIGINT) AS pos, value AS e, uk, ts, ev.seq
  FROM ev LEFT JOIN resets ON ev.k = resets.k WHERE lop <> 'DELETE' AND (r IS NULL OR ev.seq >= r))"""
MAPS = f"""{EVENTS}, clears AS (SELECT k, max(seq) AS c FROM ev WHERE uk = 'error' GROUP BY k),
maps AS (SELECT e.k, e.uk, e.uv, e.seq FROM (SELECT k, uk, arg_max(value, seq) AS uv, max(seq) AS seq FROM ev WHERE uk <> 'error' GROUP BY k, uk) e
  LEFT JOIN clears ON e.k = clears.k WHERE c IS NULL OR e.seq > c)"""


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` continues a WITH list or stands alone."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
