"""Telemetry and feedback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as B
from ..operators import telemetry as T
from .registry import query, read

_R = "(SELECT DISTINCT ON (request_id) request_id, tenant_id, lower(action) AS action, categories, confidence, processing_time_ms AS ms, client_ip, detectors_used, input_length, input_hash, event_ts, ingested_at FROM api_request ORDER BY request_id, ingested_at, event_ts)"
_F = "(SELECT DISTINCT * FROM feedback)"
_KIND = "regexp_replace(lower(trim(feedback_type)), '[ -]+', '_', 'g')"


def _req(spark, d, *cols):
    """Requests once, actions in one spelling; a time of -1 is no time."""
    r = read(spark, d, "api_request", "request_id", *[c for c in cols if c not in ("request_id", "ms")], *(["processing_time_ms"] if "ms" in cols else []))
    if "action" in cols:
        r = r.withColumn("action", F.lower("action"))
    if "ms" in cols:
        r = r.withColumnRenamed("processing_time_ms", "ms")
    return r.dropDuplicates(["request_id"])


def _fb(spark, d):
    return read(spark, d, "feedback").distinct()


# ---- requests --------------------------------------------------------------------------------------
@query(f"SELECT action, count(*) AS requests, count(DISTINCT tenant_id) AS tenants FROM {_R} GROUP BY 1")
def requests_by_action(spark, d):
    return _req(spark, d, "action", "tenant_id").groupBy("action").agg(F.count("*").alias("requests"), F.countDistinct("tenant_id").alias("tenants"))


@query(f"SELECT CAST(CAST(event_ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, count(*) FILTER (action = 'block') AS blocked FROM {_R} GROUP BY 1")
def requests_daily(spark, d):
    return _req(spark, d, "action", "event_ts").groupBy(F.to_date("event_ts").cast("string").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("action") == "block").alias("blocked"))


@query(f"SELECT date_trunc('minute', event_ts) AS minute, count(*) AS requests FROM {_R} GROUP BY 1")
def requests_minute(spark, d):
    return _req(spark, d, "event_ts").groupBy(F.date_trunc("minute", "event_ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("requests"))


@query(f"SELECT tenant_id, action, CAST(grouping(tenant_id) * 2 + grouping(action) AS INT) AS level, count(*) AS requests FROM {_R} GROUP BY GROUPING SETS ((), (tenant_id), (action), (tenant_id, action))")
def requests_grouping_sets(spark, d):
    return T.grouped_totals(_req(spark, d, "tenant_id", "action"), [["tenant_id", "action"], ["tenant_id"], ["action"], []], requests=F.count("*"))


@query(f"SELECT category, count(*) AS detections, count(DISTINCT tenant_id) AS tenants FROM (SELECT tenant_id, unnest(categories) AS category FROM {_R}) GROUP BY 1")
def detections_by_category(spark, d):
    return _req(spark, d, "tenant_id", "categories").select("tenant_id", F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("detections"), F.countDistinct("tenant_id").alias("tenants"))


@query(f"SELECT detector, action, count(*) AS n FROM (SELECT action, unnest(detectors_used) AS detector FROM {_R}) GROUP BY 1, 2")
def detections_by_detector(spark, d):
    return _req(spark, d, "action", "detectors_used").select("action", F.explode("detectors_used").alias("detector")).groupBy("detector", "action").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS requests, CAST(sum(coalesce(len(categories), 0)) AS BIGINT) AS detections, round(sum(coalesce(len(categories), 0)) / count(*) * 100, 6) AS rate_pct, count(*) FILTER (action IN ('block', 'redact')) AS stopped FROM {_R}")
def detection_rate(spark, d):
    n = F.coalesce(F.size("categories"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return _req(spark, d, "action", "categories").agg(F.count("*").alias("requests"), F.sum(n).alias("detections"), F.round(F.sum(n) / F.count("*") * 100, 6).alias("rate_pct"), F.count_if(F.col("action").isin("block", "redact")).alias("stopped"))


_B = T.LATENCY_BOUNDS
_OK = f"(SELECT * FROM {_R} WHERE ms >= 0)"
_HIST = " UNION ALL ".join([f"SELECT CAST({b} AS DOUBLE) AS le, count(*) FILTER (ms <= {b}) AS n FROM {_OK}" for b in _B] + [f"SELECT CAST('inf' AS DOUBLE) AS le, count(*) AS n FROM {_OK}"])


def _hist(spark, d):
    return T.histogram(_req(spark, d, "ms").where("ms >= 0"), F.col("ms"))


@query(_HIST)
def latency_histogram(spark, d):
    return _hist(spark, d)


@query(f"""WITH h AS ({_HIST}), x AS (SELECT le, n, max(n) OVER () AS total, lag(le, 1, 0.0) OVER (ORDER BY le) AS lo, lag(n, 1, 0) OVER (ORDER BY le) AS before FROM h),
q AS (SELECT unnest([0.5, 0.95, 0.99]) AS q)
SELECT CAST(q AS DOUBLE) AS q, round(min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (total * q - before) / (n - before) END), 6) AS value FROM x, q WHERE n >= total * q AND before < total * q GROUP BY 1""")
def histogram_quantile(spark, d):
    h = _hist(spark, d)
    out = None
    for q in (0.5, 0.95, 0.99):
        one = T.histogram_quantile(h, q).select(F.lit(q).alias("q"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT tenant_id, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, count(*) AS n FROM {_OK} GROUP BY 1")
def latency_percentiles(spark, d):
    r = _req(spark, d, "tenant_id", "ms").where("ms >= 0")
    return T.percentiles(r, "tenant_id", "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""WITH s AS (SELECT client_ip, CAST(floor(epoch(event_ts)) AS BIGINT) AS sec, count(*) AS calls FROM (SELECT DISTINCT request_id, client_ip, event_ts FROM api_request) WHERE client_ip IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, count(*) OVER (PARTITION BY client_ip ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) - 1 AS used FROM s)
SELECT client_ip, sec, calls, used, used < 2 AS allowed, greatest(0, 2 - used) AS remaining FROM w""")
def rate_limit_window(spark, d):
    r = read(spark, d, "api_request", "request_id", "client_ip", "event_ts").distinct()
    return T.rate_limit(r, "client_ip", "event_ts", 2)


@query(f"SELECT CAST(CAST(event_ts AS DATE) AS VARCHAR) AS day, round(1 - count(*) FILTER (ms = -1) / count(*), 6) AS availability, CASE WHEN count(*) FILTER (ms = -1) / count(*) <= 0.001 THEN 'healthy' WHEN count(*) FILTER (ms = -1) / count(*) <= 0.01 THEN 'warning' ELSE 'exhausted' END AS budget FROM {_R} GROUP BY 1")
def slo_budget(spark, d):
    bad = F.count_if(F.col("ms") == -1) / F.count("*")
    x = _req(spark, d, "event_ts", "ms").groupBy(F.to_date("event_ts").cast("string").alias("day")).agg(bad.alias("bad"))
    return x.select("day", F.round(1 - F.col("bad"), 6).alias("availability"), F.when(F.col("bad") <= 0.001, "healthy").when(F.col("bad") <= 0.01, "warning").otherwise("exhausted").alias("budget"))


@query(f"SELECT date_trunc('hour', event_ts) AS hour, count(*) AS requests, round(avg(confidence), 6) AS mean_confidence FROM {_R} GROUP BY 1 HAVING avg(confidence) < 0.7")
def alert_confidence_drift(spark, d):
    x = _req(spark, d, "event_ts", "confidence").groupBy(F.date_trunc("hour", "event_ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("requests"), F.avg("confidence").alias("c"))
    return x.where("c < 0.7").select("hour", "requests", F.round("c", 6).alias("mean_confidence"))


@query(f"SELECT CAST(CAST(event_ts AS DATE) AS VARCHAR) AS day, CAST(sum(coalesce(input_length, 0)) AS BIGINT) AS tokens_in, count(*) * 50 AS tokens_out, round(sum(coalesce(input_length, 0)) * 0.25 / 1e6 + count(*) * 50 * 1.25 / 1e6, 6) AS cost, round(10 - (sum(coalesce(input_length, 0)) * 0.25 / 1e6 + count(*) * 50 * 1.25 / 1e6), 6) AS remaining FROM {_R} GROUP BY 1")
def usage_cost_daily(spark, d):
    x = _req(spark, d, "event_ts", "input_length").groupBy(F.to_date("event_ts").cast("string").alias("day")).agg(F.sum(F.coalesce("input_length", F.lit(0))).alias("tokens_in"), (F.count("*") * 50).alias("tokens_out"))
    c = T.usage_cost(F.col("tokens_in"), F.col("tokens_out"))
    return x.select("day", "tokens_in", "tokens_out", F.round(c, 6).alias("cost"), F.round(10 - c, 6).alias("remaining"))


@query("SELECT w AS start, count(*) AS n FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS w FROM (SELECT CAST(ts AS TIMESTAMP) AS ts FROM events)) GROUP BY 1")
def sliding_counts(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "60 minutes", "15 minutes")
    return read(spark, d, "events", "ts").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM events")
def in_flight(spark, d):
    e = read(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    return T.running(e, ["user_id"], "ts", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", -1).otherwise(1)).select("event_id", "in_flight")


@query("""WITH m AS (SELECT max(CAST(ts AS DATE)) AS last FROM events) SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events, m WHERE CAST(ts AS DATE) > last - 7 GROUP BY 1, 2""")
def last_seven_days(spark, d):
    e = read(spark, d, "events", "ts", "event_type").select(F.to_date("ts").alias("day"), "event_type")
    last = F.broadcast(e.agg(F.max("day").alias("last")))  # one row
    return e.join(last, F.col("day") > F.date_sub("last", 7)).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20""")
def latest_twenty(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events", "event_id", "user_id", "ts").withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("event_id")


@query(f"""SELECT arm, count(*) AS n, round(avg(ms), 4) AS mean_ms FROM (SELECT CASE WHEN ascii(right(request_id, 1)) % 10 = 0 THEN 'shadow' ELSE 'live' END AS arm, ms FROM {_OK}) GROUP BY 1""")
def shadow_routing(spark, d):
    arm = F.when(F.ascii(F.right("request_id", F.lit(1))) % 10 == 0, "shadow").otherwise("live")
    return _req(spark, d, "ms").where("ms >= 0").groupBy(arm.alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg("ms"), 4).alias("mean_ms"))


# ---- feedback --------------------------------------------------------------------------------------
@query(f"""WITH r AS (SELECT request_id, max(event_ts) AS ts, arg_max(tenant_id, event_ts) AS tenant FROM api_request WHERE request_id IS NOT NULL GROUP BY 1)
SELECT f.feedback_id, coalesce(f.tenant_id, r.tenant) AS tenant FROM {_F} f JOIN r USING (request_id) WHERE floor(epoch(f.feedback_ts)) - floor(epoch(r.ts)) BETWEEN 0 AND 3600""")
def feedback_join(spark, d):
    req = read(spark, d, "api_request", "request_id", "tenant_id", "action", "input_hash", "confidence", "event_ts")
    return B.with_request(_fb(spark, d), req).select("feedback_id", "tenant")


@query(f"SELECT feedback_id FROM {_F} f WHERE request_id IS NULL OR request_id NOT IN (SELECT request_id FROM api_request WHERE request_id IS NOT NULL)")
def feedback_orphans(spark, d):
    r = read(spark, d, "api_request", "request_id").distinct()
    return _fb(spark, d).join(r, "request_id", "left_anti").select("feedback_id")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS total, map_from_entries(list(row(t, n) ORDER BY t)) AS by_type, CAST(sum(r) AS BIGINT) AS reviewed, CAST(sum(n) - sum(r) AS BIGINT) AS pending FROM (SELECT coalesce({_KIND}, 'unknown') AS t, count(*) AS n, count(*) FILTER (coalesce(reviewed, false)) AS r FROM {_F} GROUP BY 1)")
def feedback_stats(spark, d):
    return B.stats(_fb(spark, d))


@query(f"SELECT {_KIND} AS kind, tenant_id, count(*) AS n FROM {_F} GROUP BY 1, 2")
def feedback_by_type(spark, d):
    return _fb(spark, d).groupBy(B.kind(F.col("feedback_type")).alias("kind"), "tenant_id").agg(F.count("*").alias("n"))


@query(f"SELECT feedback_id, 'approved' AS rule FROM {_F} WHERE approved AND NOT coalesce(included_in_training, false) UNION ALL SELECT feedback_id, 'reviewed' FROM {_F} WHERE reviewed AND NOT coalesce(included_in_training, false)")
def feedback_for_training(spark, d):
    f = _fb(spark, d)
    return B.for_training(f).select("feedback_id", F.lit("approved").alias("rule")).unionByName(B.for_training(f, False).select("feedback_id", F.lit("reviewed").alias("rule")))


@query(f"SELECT feedback_id FROM {_F} ORDER BY feedback_ts DESC, feedback_id LIMIT 1000")
def feedback_list(spark, d):
    return _fb(spark, d).orderBy(F.desc("feedback_ts"), "feedback_id").limit(1000).select("feedback_id")


@query(f"SELECT feedback_id, CASE WHEN NOT coalesce(regexp_matches(request_id, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$'), false) THEN 'request_id' WHEN NOT coalesce({_KIND} IN ('correct', 'false_positive', 'false_negative', 'category_correction'), false) THEN 'feedback_type' WHEN length(comment) > 1000 THEN 'comment' END AS reject FROM {_F}")
def feedback_validate(spark, d):
    return B.valid(_fb(spark, d)).select("feedback_id", "reject")


_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_LOW = f"regexp_replace(lower(comment), '^{_WS}+|{_WS}+$', '', 'g')"
_BODY = f"CASE WHEN length({_LOW}) BETWEEN 3 AND 50 THEN {_LOW} ELSE array_to_string(list_filter(string_split_regex({_LOW}, '{_WS}+'), lambda w: w <> '')[1:4], ' ') END"


@query(rf"""WITH s AS (SELECT feedback_id, corrected_category, {_BODY} AS body FROM {_F} WHERE approved AND NOT coalesce(included_in_training, false) AND {_KIND} = 'false_negative' AND trim(comment) <> '')
SELECT '(?i)\b' || regexp_replace(regexp_replace(body, '([\\.^$|?*+()\[\]{{}}\-&~#])', '\\\1', 'g'), ' +', '\\s+', 'g') || '\b' AS pattern, 'learned_' || left(regexp_replace(body, '[^a-z0-9]+', '_', 'g'), 20) AS name, min(feedback_id) AS source_feedback FROM s GROUP BY 1, 2""")
def learned_patterns(spark, d):
    return B.learned(_fb(spark, d)).select("pattern", "name", "source_feedback")


@query(f"SELECT count(*) AS processed, count(*) FILTER ({_KIND} = 'false_negative' AND trim(coalesce(comment, '')) <> '') AS with_pattern, count(*) - count(*) FILTER ({_KIND} = 'false_negative' AND trim(coalesce(comment, '')) <> '') AS skipped FROM {_F} WHERE approved AND NOT coalesce(included_in_training, false)")
def training_counts(spark, d):
    return B.training_counts(_fb(spark, d))


@query(f"SELECT feedback_id, reviewed, approved, included_in_training FROM (SELECT feedback_id, true AS reviewed, {_KIND} = 'false_negative' AS approved, false AS included_in_training FROM {_F} WHERE NOT coalesce(reviewed, false) UNION ALL SELECT feedback_id, reviewed, approved, included_in_training FROM {_F} WHERE coalesce(reviewed, false))")
def feedback_review(spark, d):
    f = _fb(spark, d)
    todo = f.where(~F.coalesce("reviewed", F.lit(False)))
    dec = todo.select("feedback_id", (B.kind(F.col("feedback_type")) == "false_negative").alias("approve"), F.lit("reviewer").alias("reviewer"), F.col("feedback_ts").alias("at")).distinct()
    return B.review(f, dec).select("feedback_id", "reviewed", "approved", "included_in_training")


@query(f"SELECT feedback_id, included_in_training, trained_at FROM (SELECT feedback_id, coalesce(included_in_training, false) OR coalesce(approved, false) AS included_in_training, CASE WHEN approved AND NOT coalesce(included_in_training, false) THEN TIMESTAMP '2025-01-01 00:00:00' ELSE trained_at END AS trained_at FROM {_F})")
def mark_trained(spark, d):
    f = _fb(spark, d)
    at = F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))
    return B.mark_trained(f, B.for_training(f), at).select("feedback_id", "included_in_training", "trained_at")


@query(f"WITH a AS (SELECT count(*) AS f, count(*) FILTER ({_KIND} = 'false_positive') AS fp, count(*) FILTER ({_KIND} = 'false_negative') AS fn FROM {_F}), b AS (SELECT count(DISTINCT request_id) AS r FROM api_request) SELECT round(f / r, 6) AS feedback_rate, round(fp / f, 6) AS fp_rate, round(fn / f, 6) AS fn_rate, f >= 500 AS enough, fp / f > 0.05 AS too_many_fp FROM a, b")
def loop_metrics(spark, d):
    k = B.kind(F.col("feedback_type"))
    n = read(spark, d, "api_request", "request_id").agg(F.countDistinct("request_id").alias("r"))
    a = _fb(spark, d).agg(F.count("*").alias("f"), F.count_if(k == "false_positive").alias("fp"), F.count_if(k == "false_negative").alias("fn")).crossJoin(F.broadcast(n))  # one row each
    return a.select(F.round(F.col("f") / F.col("r"), 6).alias("feedback_rate"), F.round(F.col("fp") / F.col("f"), 6).alias("fp_rate"), F.round(F.col("fn") / F.col("f"), 6).alias("fn_rate"), (F.col("f") >= 500).alias("enough"), (F.col("fp") / F.col("f") > 0.05).alias("too_many_fp"))


@query(f"""WITH x AS (SELECT CAST(feedback_ts AS DATE) AS day, count(*) FILTER ({_KIND} = 'false_negative') AS missed FROM {_F} GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, missed, CAST(sum(missed) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM x QUALIFY week > 10""")
def retrain_days(spark, d):
    """Days on which more than ten missed texts of the last seven days ask for a new training. The window runs over one row per day."""
    from pyspark.sql import Window

    x = _fb(spark, d).groupBy(F.to_date("feedback_ts").alias("day")).agg(F.count_if(B.kind(F.col("feedback_type")) == "false_negative").alias("missed"))
    w = Window.orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-6, 0)
    return x.withColumn("week", F.sum("missed").over(w)).where("week > 10").select(F.col("day").cast("string").alias("day"), "missed", "week")


@query(f"SELECT 'requests_total{{action=\"' || coalesce(action, '') || '\"}} ' || CAST(count(*) AS VARCHAR) AS line FROM {_R} GROUP BY action")
def metrics_exposition(spark, d):
    from ..sources.writers import exposition

    return exposition(_req(spark, d, "action").groupBy("action").agg(F.count("*").alias("n")), "requests_total", "n", "action")


@query(f"SELECT 'requests_total' AS metric, coalesce(action, '') AS action, CAST(count(*) AS DOUBLE) AS value FROM {_R} GROUP BY 2")
def metrics_parse(spark, d):
    from ..sources.readers import metrics_text

    lines = metrics_exposition(spark, d).select(F.col("line").alias("value"))
    return metrics_text(lines).select("metric", F.col("labels")["action"].alias("action"), "value")


@query("SELECT raw_id, json_extract_string(body, '$.label') AS label, json_extract_string(body, '$.category') AS category, json_extract_string(body, '$.source') AS source FROM (SELECT DISTINCT raw_id, body FROM raw_records) WHERE json_valid(body)")
def raw_jsonl(spark, d):
    r = read(spark, d, "raw_records", "raw_id", "body").distinct()
    x = r.select("raw_id", F.from_json("body", "text string, label string, category string, source string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return x.where("j._bad is null").select("raw_id", "j.label", "j.category", "j.source")


@query("SELECT 'key-' || n_nationkey AS tenant, CASE WHEN n_nationkey % 2 = 0 THEN 'pro' ELSE 'free' END AS tier FROM nation")
def api_key_list(spark, d):
    from ..sources.readers import api_keys

    n = read(spark, d, "nation", "n_nationkey")
    spec = F.concat(F.lit("short:x,"), F.lit("abcdefghijklmnop:key-"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ":pro").otherwise(""))
    return n.select(F.explode(api_keys(spec)).alias("k")).select("k.tenant", "k.tier")
