"""Queries of the service's surface: sources of verdicts, answer parsing, keys, listings, panels, expert sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detect as D
from ..operators import curate as C
from ..rules import fixed_values as V
from ..rules.packs import TOXIC
from .decisions import hit
from .registry import any_sql, query, read
from .telemetry import _R, _req

VALID_LABELS = ("harassment", "hate_speech", "sexual", "self_harm", "threat", "safe")


@query("SELECT DISTINCT id, CASE WHEN " + " OR ".join(hit("text", r.pattern) for r in TOXIC) + " THEN 'keyword' ELSE 'none' END AS source FROM gold_v1 WHERE text IS NOT NULL")
def toxicity_with_source(spark, d):
    g = read(spark, d, "gold_v1", "id", "text").distinct().where("text is not null").withColumn("low", D.low_text(F.col("text")))
    return g.select("id", F.when(F.size(D.keyword("text", "low")) > 0, "keyword").otherwise("none").alias("source"))


_LINE = "CASE " + " ".join(f"WHEN contains(l, '{x}') THEN '{x}'" for x in VALID_LABELS) + " ELSE 'safe' END"


@query(f"""WITH b AS (SELECT (row_number() OVER (ORDER BY item_id) - 1) // 20 AS batch, (row_number() OVER (ORDER BY item_id) - 1) % 20 AS pos, item_id, suite, expected_action FROM eval_items),
a AS (SELECT batch, unnest(range(0, 20)) AS pos, unnest(list_concat(list(coalesce(lower(suite), '?') ORDER BY item_id), list_transform(range(0, 20 - count(*)), lambda x: '?'))) AS l FROM b GROUP BY batch)
SELECT b.item_id, {_LINE} AS label FROM b LEFT JOIN a ON a.batch = b.batch AND a.pos = b.pos""")
def annotator_answers(spark, d):
    """An answer of one line per item, joined back to its batch by position; a missing line is safe."""
    i = F.col("_pos")
    b = C.positions(read(spark, d, "eval_items", "item_id", "suite"), F.floor(F.col("item_id") / 1000), ["item_id"]).select("item_id", "suite", F.floor(i / 20).alias("batch"), (i % 20).cast("int").alias("pos"))
    answers = b.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.lower("suite"), F.lit("?")).alias("s")))), lambda x: x["s"]), "\n").alias("answer"))
    lines = answers.select("batch", F.posexplode(F.split("answer", "\n")).alias("pos", "line"))
    label = F.lit("safe")
    for x in reversed(VALID_LABELS):
        label = F.when(F.col("line").contains(x), x).otherwise(label)
    return b.join(lines, ["batch", "pos"], "left").select("item_id", label.alias("label"))


@query(f"SELECT category, count(*) FILTER ({any_sql('lower(text)', V.TOXIC_WORDS)}) AS has, count(*) FILTER (NOT {any_sql('lower(text)', V.TOXIC_WORDS)}) AS has_not, round(count(*) FILTER ({any_sql('lower(text)', V.TOXIC_WORDS)}) * 100 / count(*), 4) AS pct FROM (SELECT DISTINCT ON (id) labels.category AS category, text FROM gold_v1 WHERE text IS NOT NULL) GROUP BY 1")
def indicator_coverage(spark, d):
    g = read(spark, d, "gold_v1", "id", "text", "labels").dropDuplicates(["id"]).where("text is not null").select(F.col("labels.category").alias("category"), C.toxic_flag(F.col("text")).alias("t"))
    return g.groupBy("category").agg(F.count_if("t").alias("has"), F.count_if(~F.col("t")).alias("has_not"), F.round(F.count_if("t") * 100 / F.count("*"), 4).alias("pct"))


@query(f"SELECT request_id FROM {_R} WHERE list_has_any(categories, ['pii_email', 'pii_phone', 'toxic_hate', 'hate_speech'])")
def multi_label_any(spark, d):
    wanted = F.array(*[F.lit(x) for x in ("pii_email", "pii_phone", "toxic_hate", "hate_speech")])
    return _req(spark, d, "categories").where(F.arrays_overlap("categories", wanted)).select("request_id")


@query(f"""WITH k AS (SELECT tenant_id, CASE WHEN hash_no % 3 = 0 THEN 'pro' ELSE 'free' END AS tier FROM (SELECT DISTINCT tenant_id, ascii(right(tenant_id, 1)) AS hash_no FROM feedback WHERE tenant_id IS NOT NULL))
SELECT r.request_id, CASE WHEN r.tenant_id IS NULL THEN 401 WHEN k.tenant_id IS NULL THEN 403 ELSE 200 END AS status, k.tier FROM {_R} r LEFT JOIN k ON r.tenant_id = k.tenant_id""")
def key_validation(spark, d):
    t = read(spark, d, "feedback", "tenant_id").where("tenant_id is not null").distinct()
    k = t.select(F.col("tenant_id").alias("kt"), F.when(F.ascii(F.right("tenant_id", F.lit(1))) % 3 == 0, "pro").otherwise("free").alias("tier"))
    r = _req(spark, d, "tenant_id")
    return r.join(k, r["tenant_id"] == k["kt"], "left").select("request_id", F.when(F.col("tenant_id").isNull(), 401).when(F.col("kt").isNull(), 403).otherwise(200).alias("status"), "tier")


_SHC = "(SELECT DISTINCT ON (id) id, labels.category AS category FROM gold_v1 WHERE labels.category IS NOT NULL)"


@query(f"""WITH c AS (SELECT category, count(*) AS n FROM {_SHC} GROUP BY 1), s AS (SELECT n AS safe FROM c WHERE category = 'safe')
SELECT category, n AS positive, CAST(least(safe, floor(n * 1.5)) AS BIGINT) AS negative FROM c, s WHERE category <> 'safe'""")
def expert_sets(spark, d):
    """Per category its examples and up to 1.5 times as many safe ones, counted."""
    n = read(spark, d, "gold_v1", "id", "labels").dropDuplicates(["id"]).groupBy(F.col("labels.category").alias("category")).agg(F.count("*").alias("n")).where("category is not null")
    safe = n.where("category = 'safe'").select(F.col("n").alias("safe"))
    limit = F.least(F.col("safe"), F.floor(F.col("n") * 1.5))
    return n.where("category <> 'safe'").join(F.broadcast(safe.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select("category", F.col("n").alias("positive"), limit.alias("negative"))


@query(f"SELECT count(*) AS requests, CAST(sum(coalesce(len(categories), 0)) AS BIGINT) AS detections, count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'redact') AS redacted, count(*) FILTER (action = 'allow') AS allowed, count(*) FILTER (action = 'allow_with_warning') AS warned FROM {_R}")
def panel_totals(spark, d):
    n = F.when(F.size("categories") > 0, F.size("categories")).otherwise(0)
    a = lambda x: F.count_if(F.col("action") == x)
    return _req(spark, d, "action", "categories").agg(F.count("*").alias("requests"), F.sum(n).alias("detections"), a("block").alias("blocked"), a("redact").alias("redacted"), a("allow").alias("allowed"), a("allow_with_warning").alias("warned"))


@query(f"SELECT date_trunc('hour', event_ts) AS hour, count(*) AS requests, count(*) FILTER (ms = -1) AS failed FROM {_R} GROUP BY 1 HAVING count(*) FILTER (ms = -1) / count(*) > 0.05")
def alert_error_rate(spark, d):
    x = _req(spark, d, "event_ts", "ms").groupBy(F.date_trunc("hour", "event_ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("requests"), F.count_if(F.col("ms") == -1).alias("failed"))
    return x.where(F.col("failed") / F.col("requests") > 0.05)


@query("SELECT DISTINCT id, replace('toxic_' || labels.category, 'toxic_', '') AS category, CASE WHEN labels.category IN ('safe', 'other') THEN labels.category ELSE 'toxic' END AS router FROM gold_v1 WHERE labels.category IS NOT NULL")
def prefix_labels(spark, d):
    c = F.col("labels.category")
    return read(spark, d, "gold_v1", "id", "labels").where(c.isNotNull()).select("id", F.replace(F.concat(F.lit("toxic_"), c), F.lit("toxic_"), F.lit("")).alias("category"), F.when(c.isin("safe", "other"), c).otherwise("toxic").alias("router")).distinct()


@query(f"SELECT count(*) FILTER (late >= 3600) AS late_hour, count(*) FILTER (late >= 86400) AS late_day, count(*) AS n FROM (SELECT floor(epoch(ingested_at)) - floor(epoch(event_ts)) AS late FROM {_R})")
def late_rows(spark, d):
    r = read(spark, d, "api_request", "request_id", "event_ts", "ingested_at").groupBy("request_id").agg(F.min_by(F.struct("event_ts", "ingested_at"), F.struct("ingested_at", "event_ts")).alias("x"))
    late = F.unix_timestamp(F.col("x.ingested_at").cast("timestamp")) - F.unix_timestamp(F.col("x.event_ts").cast("timestamp"))
    return r.agg(F.count_if(late >= 3600).alias("late_hour"), F.count_if(late >= 86400).alias("late_day"), F.count("*").alias("n"))


