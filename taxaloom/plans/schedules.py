"""Queries on calls to services: when they may go out. Events stand for calls and users for callers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import schedule
from .registry import Tables, query


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id, user_id, n * 1800000000 + max(us - n * 1800000000) OVER (PARTITION BY user_id ORDER BY n) AS release_us FROM e"""
)
def release_schedule(t: Tables) -> DataFrame:
    """When each call goes out if a caller's calls are half an hour apart at least."""
    return schedule.limited(t.events, "user_id", "ts", "event_id", 1800.0).select("event_id", "user_id", F.unix_micros("release").alias("release_us"))


@query(
    """WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN event_id % 5 = 0 THEN [{'s': 429, 'r': event_id % 40}, {'s': 503, 'r': NULL}, {'s': 200, 'r': NULL}]
        WHEN event_id % 5 = 1 THEN [{'s': 503, 'r': 20}, {'s': 200, 'r': NULL}] WHEN event_id % 7 = 2 THEN [{'s': 500, 'r': NULL}, {'s': 429, 'r': NULL}, {'s': 504, 'r': NULL}, {'s': 200, 'r': NULL}]
        WHEN event_id % 11 = 3 THEN [{'s': 404, 'r': NULL}] ELSE [{'s': 200, 'r': NULL}] END AS ans FROM events),
    t AS (SELECT event_id, user_id, us, least(len(ans), 3) AS n, unnest(ans[1:3]) AS x, generate_subscripts(ans[1:3], 1) AS k FROM a),
    w AS (SELECT *, x.s AS status, CASE WHEN x.s = 429 AND x.r IS NOT NULL THEN least(x.r, 30) * 1000000 ELSE CAST(500000 * 2 ** (k - 1) AS BIGINT) END AS wait FROM t),
    g AS (SELECT *, greatest(350000, coalesce(lag(wait) OVER (PARTITION BY event_id ORDER BY k), 0)) AS gap FROM w),
    s AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY us, event_id, k) AS BIGINT) AS G FROM g)
    SELECT event_id, CAST(k - 1 AS INTEGER) AS attempt, status, CASE WHEN k < n THEN NULL WHEN status >= 429 THEN 'given up' WHEN status = 404 THEN 'refused' ELSE 'answered' END AS outcome,
      G + max(CASE WHEN k = 1 THEN us - G END) OVER (PARTITION BY user_id ORDER BY us, event_id, k) AS release_us FROM s"""
)
def retry_schedule(t: Tables) -> DataFrame:
    """All attempts of all calls, each caller waiting out what it is told or what doubles each time."""
    a = lambda status, after=None: F.struct(F.lit(status).alias("status"), (F.lit(None) if after is None else after).cast("double").alias("retry_after"))
    k = F.col("event_id")
    answers = (
        F.when(k % 5 == 0, F.array(a(429, k % 40), a(503), a(200)))
        .when(k % 5 == 1, F.array(a(503, F.lit(20)), a(200)))
        .when(k % 7 == 2, F.array(a(500), a(429), a(504), a(200)))
        .when(k % 11 == 3, F.array(a(404)))
        .otherwise(F.array(a(200)))
    )
    found = schedule.retried(t.events.select("event_id", "user_id", "ts", answers.alias("answers")), "user_id", "ts", "event_id")
    return found.select("event_id", "attempt", "status", "outcome", F.unix_micros("release").alias("release_us"))
