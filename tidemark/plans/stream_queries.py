"""Streams over the events table, run to their end, with DuckDB twins of the batch results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str):
    def keep(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(S.read_events(spark, sf_dir))
        ORACLES[name] = sql
        return fn

    return keep


@_query("st1_stream_dedupe_filings", "SELECT DISTINCT user_id, event_type FROM events")
def _(e):
    return S.drained(S.stream_dedupe_filings(e, ["user_id", "event_type"], "ts").select("user_id", "event_type"), "st1")


@_query("st2_stream_distinct_buyers", "SELECT (d - n::INT)::TIMESTAMP AS window_start, event_type AS symbol, count(DISTINCT user_id) AS buyers FROM (SELECT *, ts::DATE AS d, unnest(generate_series(0, 6)) AS n FROM events) GROUP BY 1, 2")
def _(e):
    events, close = S.closable(e, "ts")
    return S.drained(S.stream_distinct_buyers(events, "event_type", "user_id", "ts", days=7), "st2", close)


@_query("st3_stream_daily_counts", "SELECT ts::DATE AS day, event_type AS source, count(*) AS rows, count(*) FILTER (WHERE value > 50) AS hits FROM events GROUP BY 1, 2")
def _(e):
    events, close = S.closable(e, "ts")
    return S.drained(S.stream_daily_counts(events, "event_type", "ts", F.col("value") > 50), "st3", close)


# Quotes of a user: the last before every pause of more than a day, and the last of all.
@_query(
    "st4_stream_latest_quote",
    """WITH o AS (SELECT user_id, ts, value, coalesce(lead(ts) OVER w > ts + INTERVAL 1 DAY, true) AS last_ FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id::VARCHAR AS symbol, ts AS quoted_at, value AS quote FROM o WHERE last_""",
)
def _(e):
    events, close = S.closable(e.withColumn("user_id", F.col("user_id").cast("string")), "ts")
    return S.drained(S.stream_latest_quote(events, "user_id", "ts", "value", stale="1 day"), "st4", close)


_RAW = "CASE WHEN event_type = 'click' THEN 'FB' WHEN event_type = 'view' THEN 'SP' WHEN event_type = 'purchase' THEN 'brk.b' WHEN event_id % 5 = 0 THEN 'BK' WHEN event_id % 5 = 1 THEN 'NaN' ELSE concat('T', substr(event_type, 1, 2)) END"


@_query(
    "st5_stream_enrich",
    f"""WITH r AS (SELECT event_id, upper({_RAW}) AS raw FROM events) SELECT event_id, CASE raw WHEN 'FB' THEN 'META' WHEN 'BRK.B' THEN 'BRK-B' WHEN 'NAN' THEN NULL ELSE raw END AS symbol,
 CASE raw WHEN 'FB' THEN 'renamed' WHEN 'SP' THEN 'quarantined' WHEN 'BRK.B' THEN 'class_share' WHEN 'BK' THEN 'pre_rename' WHEN 'NAN' THEN 'unresolved' ELSE 'unverified' END AS symbol_status, CASE raw WHEN 'FB' THEN 'META' WHEN 'BRK.B' THEN 'BRK-B' WHEN 'BK' THEN 'BNY' WHEN 'NAN' THEN NULL ELSE raw END AS family FROM r""",
)
def _(e):
    rows = e.select("event_id", "ts", F.expr(_RAW).alias("raw_symbol"))
    return S.drained(S.stream_enrich(rows, "raw_symbol", "ts").select("event_id", "symbol", "symbol_status", "family"), "st5")


@_query("st6_stream_merge", "SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events")
def _(e):
    merged = S.stream_merge(e.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")
    return S.drained(merged, "st6").select("user_id", "event_type", F.col("day").cast("date").alias("day"))


@_query(
    "st7_stream_activity_sessions",
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT user_id AS actor, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS rows FROM s GROUP BY user_id, n""",
)
def _(e):
    events, close = S.closable(e, "ts")
    return S.drained(S.stream_activity_sessions(events, "user_id", "ts"), "st7", close)
