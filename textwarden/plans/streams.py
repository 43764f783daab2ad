"""Streaming queries and the batch twins of the stateful operators, with recursive SQL beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scorer as S0
from ..sources.storage import fresh
from ..streaming import stateful as S
from .evidence import one_answer
from .registry import query, read

# each client's events in order; the recursion goes over their numbers, all clients at once
_E = "e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS client, CAST(ts AS TIMESTAMP) AS ts, epoch(CAST(ts AS TIMESTAMP)) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"
_LIMITER = f"""WITH RECURSIVE {_E}, s AS (
SELECT client, ts, n, [t] AS log, true AS allowed, 1 AS remaining FROM e WHERE n = 1
UNION ALL SELECT e.client, e.ts, e.n, CASE WHEN len(k.k) < 2 THEN list_append(k.k, e.t) ELSE k.k END, len(k.k) < 2, CAST(greatest(0, 2 - len(k.k) - CAST(len(k.k) < 2 AS INT)) AS INT)
FROM s JOIN e ON e.client = s.client AND e.n = s.n + 1, LATERAL (SELECT list_filter(s.log, lambda x: x > e.t - 3600) AS k) k)
SELECT client, ts, allowed, remaining FROM s"""
_BREAKER = f"""WITH RECURSIVE {_E}, s AS (
SELECT client, ts, n, ok, true AS admitted, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS fails, 0 AS good, CAST(0 AS DOUBLE) AS opened FROM e WHERE n = 1
UNION ALL SELECT client, ts, n, ok, admitted, CASE WHEN NOT admitted THEN 'open' WHEN was <> 'closed' AND NOT ok THEN 'open' WHEN was <> 'closed' THEN CASE WHEN g + 1 >= 3 THEN 'closed' ELSE 'half_open' END WHEN NOT ok AND fails + 1 >= 5 THEN 'open' ELSE 'closed' END,
CASE WHEN NOT admitted THEN fails WHEN was <> 'closed' THEN CASE WHEN ok AND g + 1 >= 3 THEN 0 ELSE fails END WHEN ok THEN 0 ELSE fails + 1 END,
CASE WHEN NOT admitted THEN good WHEN was <> 'closed' THEN CASE WHEN NOT ok OR g + 1 >= 3 THEN 0 ELSE g + 1 END ELSE 0 END,
CASE WHEN NOT admitted THEN opened WHEN was <> 'closed' THEN CASE WHEN NOT ok THEN t WHEN g + 1 >= 3 THEN 0 ELSE opened END WHEN NOT ok AND fails + 1 >= 5 THEN t ELSE 0 END
FROM (SELECT e.client, e.ts, e.n, e.ok, e.t, s.state AS was, s.fails, s.good, s.opened, NOT (s.state = 'open' AND e.t - s.opened < 30) AS admitted, CASE WHEN s.state = 'open' THEN 0 ELSE s.good END AS g FROM s JOIN e ON e.client = s.client AND e.n = s.n + 1))
SELECT client, ts, ok, admitted, state FROM s"""
_BUDGET = f"""WITH RECURSIVE {_E}, s AS (
SELECT client, ts, n, [t] AS log, 1 AS made, t AS start, true AS called FROM e WHERE n = 1
UNION ALL SELECT client, ts, n, CASE WHEN go THEN list_append(k, t) ELSE k END, CASE WHEN go THEN m + 1 ELSE m END, st, go
FROM (SELECT *, len(k) < 30 AND m < 3 AS go FROM (SELECT e.client, e.ts, e.n, e.t, list_filter(s.log, lambda x: x > e.t - 60) AS k, CASE WHEN e.t - s.start >= 86400 THEN 0 ELSE s.made END AS m, CASE WHEN e.t - s.start >= 86400 THEN e.t ELSE s.start END AS st FROM s JOIN e ON e.client = s.client AND e.n = s.n + 1)))
SELECT client, ts, called FROM s"""


def _events(spark, d):
    return read(spark, d, "events", "event_id", "user_id", "ts", "event_type").select("event_id", F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


def _stream(spark, d):
    src = S.events(spark, f"{d}/events.parquet", read(spark, d, "events").schema)
    return src.select("event_id", F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), "event_type", "value")


def _plain(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stream_daily_usage(spark, d):
    out = S.run_to_end(S.daily_usage(_stream(spark, d)), "daily_" + uuid.uuid4().hex[:8], "complete")
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


@query("SELECT w AS start, count(*) / 5.0 AS per_minute FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS w FROM (SELECT CAST(ts AS TIMESTAMP) AS ts FROM events)) GROUP BY 1")
def stream_sliding_rate(spark, d):
    """Rates of the last five minutes, a window a minute."""
    out = S.run_to_end(S.sliding_rate(_stream(spark, d), step="1 minute"), "rate_" + uuid.uuid4().hex[:8], "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "per_minute")


@query("SELECT f.feedback_id FROM (SELECT DISTINCT feedback_id, request_id, feedback_ts FROM feedback) f JOIN (SELECT DISTINCT request_id, event_ts FROM api_request) r ON f.request_id = r.request_id AND f.feedback_ts BETWEEN r.event_ts AND r.event_ts + INTERVAL 1 HOUR")
def stream_feedback_join(spark, d):
    """Feedback within an hour of its request, both sides as streams."""
    a, b = fresh(spark, "requests"), fresh(spark, "feedback")
    r = read(spark, d, "api_request", "request_id", "event_ts").distinct().withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    f = read(spark, d, "feedback", "feedback_id", "request_id", "feedback_ts").distinct().withColumn("feedback_ts", F.col("feedback_ts").cast("timestamp"))
    for df, path in ((r, a), (f, b)):
        df.coalesce(1).write.parquet(path)
    out = S.requests_with_feedback(S.events(spark, a, r.schema), S.events(spark, b, f.schema))
    return S.run_to_end(out.select("f.feedback_id"), "join_" + uuid.uuid4().hex[:8])


@query(_LIMITER)
def stream_rate_limit(spark, d):
    return _plain(S.run_to_end(S.limiter_stream(_stream(spark, d).select("event_id", "client", "ts")), "limit_" + uuid.uuid4().hex[:8]))


@query(_BREAKER)
def stream_breaker(spark, d):
    out = S.run_to_end(S.breaker_stream(_stream(spark, d).select("event_id", "client", "ts", "ok")), "breaker_" + uuid.uuid4().hex[:8])
    return _plain(out).select("client", "ts", "ok", "admitted", "state")


@query(_BUDGET)
def stream_budget(spark, d):
    out = S.run_to_end(S.budget_stream(_stream(spark, d).select("event_id", "client", "ts")), "budget_" + uuid.uuid4().hex[:8])
    return _plain(out).select("client", "ts", "called")


@query(_LIMITER)
def rate_limit_stateful(spark, d):
    return _plain(S.limiter_batch(_events(spark, d).select("event_id", "client", "ts")))


@query(_BREAKER)
def breaker_fsm(spark, d):
    return _plain(S.breaker_batch(_events(spark, d).select("event_id", "client", "ts", (F.col("event_type") != "error").alias("ok"))))


@query(_BUDGET)
def call_budget(spark, d):
    return _plain(S.budget_batch(_events(spark, d).select("event_id", "client", "ts")))


def half_cent(prompt, answer):
    return 0.5


@query(f"""WITH RECURSIVE {_E}, s AS (SELECT client, event_id, n, t AS day, 1 AS made, 'called' AS status FROM e WHERE n = 1
UNION ALL SELECT client, event_id, n, st, CASE WHEN m < 2 THEN m + 1 ELSE m END, CASE WHEN m < 2 THEN 'called' ELSE 'cost_cap' END
FROM (SELECT e.client, e.event_id, e.n, CASE WHEN e.t - s.day >= 86400 THEN e.t ELSE s.day END AS st, CASE WHEN e.t - s.day >= 86400 THEN 0 ELSE s.made END AS m FROM s JOIN e ON e.client = s.client AND e.n = s.n + 1))
SELECT event_id, status, CASE WHEN status = 'called' AND event_type = 'click' THEN 1 ELSE 0 END AS found FROM s JOIN (SELECT event_id, event_type FROM events) USING (event_id)""")
def gated_judge(spark, d):
    """A judge behind its gates: two calls of half a unit a day and client; a question mark stands in the texts of clicks."""
    e = _events(spark, d).withColumn("_t", F.when(F.col("event_type") == "click", "why?").otherwise("so it is")).withColumn("ask", F.lit(True))
    out = S0.gated_judge(one_answer, "event_id", "client", "ts", daily_cost=1.0, cost_of=half_cent)(e)
    return out.select("event_id", F.col("judged.status").alias("status"), F.size("judged.found").alias("found"))
