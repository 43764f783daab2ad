"""Lists, dimensions, metric families, alerts, model parts and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as SC
from ..operators import curate as C
from ..operators import evaluate as E
from ..operators import feedback as B
from ..operators import telemetry as T
from ..rules import fixed_values as V
from .curation import _G, _gold, _sh
from .registry import SQL, any_sql, query, read
from .telemetry import _F, _KIND, _R, _fb, _req

_SH = "(SELECT DISTINCT * FROM self_harm_generated)"


# ---- feedback lists --------------------------------------------------------------------------------
@query(f"WITH t AS (SELECT min(tenant_id) AS t FROM feedback) SELECT feedback_id FROM {_F}, t WHERE tenant_id = t.t ORDER BY feedback_ts DESC, feedback_id LIMIT 1000")
def feedback_list_tenant(spark, d):
    """The list of one tenant: the first by name."""
    first = read(spark, d, "feedback", "tenant_id").agg(F.min("tenant_id").alias("t"))
    f = _fb(spark, d)
    mine = f.join(F.broadcast(first), F.col("tenant_id") == F.col("t")).select(f.columns)
    return B.listed(mine).select("feedback_id")


@query(f"SELECT feedback_id, true AS pending FROM (SELECT * FROM {_F} WHERE NOT coalesce(reviewed, false) ORDER BY feedback_ts DESC, feedback_id LIMIT 1000) UNION ALL SELECT feedback_id, false FROM (SELECT * FROM {_F} WHERE reviewed ORDER BY feedback_ts DESC, feedback_id LIMIT 1000)")
def feedback_pending(spark, d):
    f = _fb(spark, d)
    one = lambda p: B.listed(f, pending=p).select("feedback_id", F.lit(p).alias("pending"))
    return one(True).unionByName(one(False))


@query("SELECT request_id, arg_max(lower(action), event_ts) AS decision, max(event_ts) AS event_ts FROM api_request WHERE request_id IS NOT NULL GROUP BY 1")
def request_cache(spark, d):
    r = read(spark, d, "api_request").withColumn("action", F.lower("action"))
    return B.request_cache(r).select("request_id", "decision", "event_ts")


@query("WITH c AS (SELECT request_id, max(event_ts) AS event_ts FROM api_request WHERE request_id IS NOT NULL GROUP BY 1) SELECT DISTINCT f.request_id, c.request_id IS NOT NULL AS known FROM feedback f LEFT JOIN c ON f.request_id = c.request_id WHERE f.request_id IS NOT NULL")
def cached_request(spark, d):
    """Looking up requests by id; what is not there is not known."""
    cache = B.request_cache(read(spark, d, "api_request")).select(F.col("request_id").alias("have"))
    asked = read(spark, d, "feedback", "request_id").where("request_id is not null").distinct()
    return asked.join(cache, F.col("request_id") == F.col("have"), "left").select("request_id", F.col("have").isNotNull().alias("known"))


# ---- dimensions ------------------------------------------------------------------------------------
@query(f"""SELECT g.id, d.code AS decision_code, c.code AS category_code, s.typical FROM {_G} g LEFT JOIN (VALUES ('ALLOW', 0), ('WARN', 1), ('BLOCK', 2)) AS d(name, code) ON g.decision = d.name
LEFT JOIN (VALUES ('harassment', 0), ('hate_speech', 1), ('threat', 2), ('violence', 3), ('sexual', 4), ('self_harm', 5), ('fraud_or_scam', 6), ('other', 7), ('safe', 8)) AS c(name, code) ON g.category = c.name
LEFT JOIN (VALUES (0, 'ALLOW'), (1, 'ALLOW or WARN'), (2, 'WARN'), (3, 'BLOCK'), (4, 'BLOCK')) AS s(level, typical) ON g.severity = s.level""")
def code_dimensions(spark, d):
    g = _gold(spark, d).select("id", "decision", "category", "severity")
    dim = lambda rows, cols: F.broadcast(spark.createDataFrame(rows, cols))  # noqa: E731  # fixed tables of at most nine rows
    g = g.join(dim(list(SC.DECISIONS.items()), "decision string, decision_code int"), "decision", "left")
    g = g.join(dim(list(SC.CATEGORY_CODES.items()), "category string, category_code int"), "category", "left")
    return g.join(dim(list(SC.SEVERITY_BANDS.items()), "severity int, typical string"), "severity", "left").select("id", "decision_code", "category_code", "typical")


_TIERS = " UNION ALL ".join(f"SELECT {t} AS tier, '{w}' AS word, {s} AS severity, '{a}' AS decision" for t, (ws, s, a) in V.SLUR_TIERS.items() for w in ws)


@query(f"""WITH tiers AS ({_TIERS}), g AS (SELECT DISTINCT id, text FROM gold_v1 WHERE text IS NOT NULL)
SELECT id, CAST(min(tier) AS INT) AS tier, CAST(max(severity) AS INT) AS severity FROM g, tiers WHERE contains(lower(g.text), word) GROUP BY 1""")
def slur_tiers(spark, d):
    """The severest tier of listed words in each text; the tier table is fixed and small."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(C.any_of(low, ws), F.struct(F.lit(t).alias("tier"), F.lit(s).alias("severity"))) for t, (ws, s, _) in V.SLUR_TIERS.items()]))
    g = read(spark, d, "gold_v1", "id", "text").distinct().where("text is not null").withColumn("h", hits).where(F.size("h") > 0)
    return g.select("id", F.array_min(F.transform("h", lambda x: x["tier"])).alias("tier"), F.array_max(F.transform("h", lambda x: x["severity"])).alias("severity"))


@query(f"SELECT id, CASE WHEN category = 'hate_speech' THEN 'toxic_hate_speech' WHEN category = 'harassment' THEN 'toxic_harassment' WHEN category = 'safe' THEN 'safe' ELSE 'toxic_harassment' END AS label FROM {_G}")
def annotator_labels(spark, d):
    return _gold(spark, d).select("id", C.annotator_label(F.col("category"), F.col("category")).alias("label"))


@query(f"SELECT lower(category) AS category, count(*) FILTER (lower(label) = 'safe' AND {any_sql('lower(text)', V.TOXIC_WORDS)}) AS suspicious_safe, count(*) FILTER (NOT regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') AND NOT {any_sql('lower(text)', V.HINGLISH)}) AS not_hindi FROM {_SH} WHERE text IS NOT NULL GROUP BY 1")
def suspicious_counts(spark, d):
    """Per category: safe texts with a listed word, and texts without any sign of Hindi."""
    t, low = F.col("text"), F.lower("text")
    x = _sh(spark, d, "record_id", "text", "label", "category").where("text is not null")
    return x.groupBy(F.lower("category").alias("category")).agg(F.count_if((F.lower("label") == "safe") & C.toxic_flag(t)).alias("suspicious_safe"), F.count_if(~t.rlike("[\\u0900-\\u097F]") & ~C.any_of(low, V.HINGLISH)).alias("not_hindi"))


# ---- metric families, alerts -----------------------------------------------------------------------
_ENDPOINT = "CASE WHEN input_length IS NULL THEN '/analyze/batch' ELSE '/analyze' END"
_STATUS = "CASE WHEN ms = -1 THEN '5xx' ELSE '2xx' END"


def _families(spark, d):
    x = _req(spark, d, "tenant_id", "action", "categories", "input_length", "event_ts", "ms")
    return x.withColumn("endpoint", F.when(F.col("input_length").isNull(), "/analyze/batch").otherwise("/analyze")).withColumn("status", T.status_of(F.col("ms"))).withColumn("method", F.lit("POST"))


@query(f"SELECT {_ENDPOINT} AS endpoint, 'POST' AS method, {_STATUS} AS status, count(*) AS requests FROM {_R} GROUP BY ALL")
def requests_by_status(spark, d):
    return _families(spark, d).groupBy("endpoint", "method", "status").agg(F.count("*").alias("requests"))


@query(f"SELECT {_ENDPOINT} AS endpoint, CAST(CAST(event_ts AS DATE) AS VARCHAR) AS day, CAST(grouping({_ENDPOINT}) * 2 + grouping(CAST(CAST(event_ts AS DATE) AS VARCHAR)) AS INT) AS level, count(*) AS requests FROM {_R} GROUP BY GROUPING SETS (({_ENDPOINT}, CAST(CAST(event_ts AS DATE) AS VARCHAR)), ({_ENDPOINT}), (CAST(CAST(event_ts AS DATE) AS VARCHAR)), ())")
def requests_endpoint_day(spark, d):
    x = _families(spark, d).withColumn("day", F.to_date("event_ts").cast("string"))
    return T.grouped_totals(x, [["endpoint", "day"], ["endpoint"], ["day"], []], requests=F.count("*"))


@query(f"SELECT 'detections' AS family, category AS a, action AS b, CAST(count(*) AS DOUBLE) AS value FROM (SELECT unnest(categories) AS category, action FROM {_R}) GROUP BY 2, 3 UNION ALL SELECT 'actions', action, NULL, count(*) FROM {_R} GROUP BY 2 UNION ALL SELECT 'feedback', {_KIND}, CASE WHEN NOT coalesce(reviewed, false) THEN 'pending' WHEN approved THEN 'approved' ELSE 'rejected' END, count(*) FROM {_F} GROUP BY 2, 3 UNION ALL SELECT 'tokens', 'input', NULL, sum(coalesce(input_length, 0)) FROM {_R} UNION ALL SELECT 'limit_hits', 'api_key', NULL, coalesce(sum(calls - 1) FILTER (calls > 1), 0) FROM (SELECT client_ip, date_trunc('hour', event_ts) AS h, count(*) AS calls FROM {_R} WHERE client_ip IS NOT NULL GROUP BY 1, 2)")
def counter_families(spark, d):
    """Counters by their labels, as (family, a, b, value)."""
    r, nil = _families(spark, d), F.lit(None).cast("string")
    count = F.count("*").cast("double").alias("value")
    det = r.select("action", F.explode("categories").alias("c")).groupBy(F.col("c").alias("a"), F.col("action").alias("b")).agg(count).withColumn("family", F.lit("detections"))
    act = r.groupBy(F.col("action").alias("a")).agg(count).withColumn("b", nil).withColumn("family", F.lit("actions"))
    status = F.when(~F.coalesce("reviewed", F.lit(False)), "pending").when(F.col("approved"), "approved").otherwise("rejected")
    fb = _fb(spark, d).groupBy(B.kind(F.col("feedback_type")).alias("a"), status.alias("b")).agg(count).withColumn("family", F.lit("feedback"))
    tok = r.agg(F.sum(F.coalesce("input_length", F.lit(0))).cast("double").alias("value")).withColumns({"a": F.lit("input"), "b": nil, "family": F.lit("tokens")})
    hits = _limit_hits(spark, d).agg(F.coalesce(F.sum("hits"), F.lit(0)).cast("double").alias("value")).withColumns({"a": F.lit("api_key"), "b": nil, "family": F.lit("limit_hits")})
    cols = ["family", "a", "b", "value"]
    return det.select(cols).unionByName(act.select(cols)).unionByName(fb.select(cols)).unionByName(tok.select(cols)).unionByName(hits.select(cols))


def _limit_hits(spark, d):
    """Calls of a client beyond the first of an hour."""
    h = F.date_trunc("hour", "event_ts").cast("timestamp_ntz")
    n = _req(spark, d, "client_ip", "event_ts").where("client_ip is not null").groupBy("client_ip", h.alias("hour")).agg(F.count("*").alias("calls"))
    return n.select("hour", (F.col("calls") - 1).alias("hits")).where("hits > 0")


@query(f"SELECT hour, CAST(sum(calls - 1) AS BIGINT) AS hits FROM (SELECT client_ip, date_trunc('hour', event_ts) AS hour, count(*) AS calls FROM {_R} WHERE client_ip IS NOT NULL GROUP BY 1, 2) WHERE calls > 1 GROUP BY 1 HAVING sum(calls - 1) > 0")
def alert_limit_hits(spark, d):
    return _limit_hits(spark, d).groupBy("hour").agg(F.sum("hits").alias("hits")).where("hits > 0")


# in millionths, so that sums are exact
_COST = "sum(coalesce(input_length, 0)) * CAST(0.25 AS DOUBLE) + count(*) * CAST(62.5 AS DOUBLE)"


def _micro(tokens, requests):
    return tokens * F.lit(0.25) + requests * F.lit(62.5)


@query(f"WITH h AS (SELECT date_trunc('hour', event_ts) AS hour, {_COST} AS cost FROM {_R} GROUP BY 1), m AS (SELECT avg(cost) AS mean FROM h) SELECT hour, cost AS cost_micro FROM h, m WHERE cost > 2 * mean")
def alert_cost_increase(spark, d):
    """Hours that cost more than twice the mean hour."""
    h = _req(spark, d, "event_ts", "input_length").groupBy(F.date_trunc("hour", "event_ts").cast("timestamp_ntz").alias("hour")).agg(_micro(F.sum(F.coalesce("input_length", F.lit(0))), F.count("*")).alias("cost"))
    return h.crossJoin(F.broadcast(h.agg(F.avg("cost").alias("mean")))).where(F.col("cost") > 2 * F.col("mean")).select("hour", F.col("cost").alias("cost_micro"))  # one row


@query(f"""WITH r AS (SELECT CASE WHEN ascii(right(request_id, 1)) % 10 = 0 THEN 'shadow' ELSE 'live' END AS arm, request_id, ms FROM {_R} WHERE ms >= 0),
f AS (SELECT request_id, max(CAST({_KIND} = 'false_positive' AS INT)) AS fp, max(CAST({_KIND} = 'false_negative' AS INT)) AS fn FROM {_F} GROUP BY 1),
s AS (SELECT arm, count(*) AS n, sum(coalesce(fp, 0)) / count(*) AS fp, sum(coalesce(fn, 0)) / count(*) AS fn, avg(ms) AS ms FROM r LEFT JOIN f USING (request_id) GROUP BY 1),
x AS (SELECT b.n >= 1000 AS enough, b.fp <= a.fp AS fp_ok, b.fn < a.fn AS fn_ok, b.ms <= a.ms * 1.1 AS latency_ok FROM s a, s b WHERE a.arm = 'live' AND b.arm = 'shadow')
SELECT *, enough AND fp_ok AND fn_ok AND latency_ok AS promote FROM x""")
def shadow_promotion(spark, d):
    """Whether the model on a tenth of the requests may replace the other."""
    arm = F.when(F.ascii(F.right("request_id", F.lit(1))) % 10 == 0, "shadow").otherwise("live")
    k = B.kind(F.col("feedback_type"))
    f = _fb(spark, d).groupBy("request_id").agg(F.max((k == "false_positive").cast("int")).alias("fp"), F.max((k == "false_negative").cast("int")).alias("fn"))
    r = _req(spark, d, "ms").where("ms >= 0").join(f, "request_id", "left")
    s = r.groupBy(arm.alias("arm")).agg(F.count("*").alias("n"), (F.sum(F.coalesce("fp", F.lit(0))) / F.count("*")).alias("fp_rate"), (F.sum(F.coalesce("fn", F.lit(0))) / F.count("*")).alias("fn_rate"), F.avg("ms").alias("mean_ms"))
    return T.promotion(s)


@query(f"SELECT coalesce(tenant_id, 'default') AS tenant, count(*) AS requests, {_COST} AS cost_micro FROM {_R} GROUP BY 1")
def usage_by_tenant(spark, d):
    """Usage; requests without a tenant fall back to the default one."""
    x = _req(spark, d, "tenant_id", "input_length").groupBy(F.coalesce("tenant_id", F.lit("default")).alias("tenant")).agg(F.count("*").alias("requests"), F.sum(F.coalesce("input_length", F.lit(0))).alias("tokens"))
    return x.select("tenant", "requests", _micro(F.col("tokens"), F.col("requests")).alias("cost_micro"))


# ---- model parts, training sets --------------------------------------------------------------------
@query(f"SELECT id, CASE WHEN severity IS NULL THEN NULL ELSE round(exp(severity) / (exp(severity) + exp(1) + exp(0.5)), 6) END AS p, CASE WHEN severity >= 1 THEN 0 WHEN severity < 1 THEN 1 END AS best FROM {_G}")
def softmax_scores(spark, d):
    """Probabilities and the best class of three scores."""
    s = F.array(F.col("severity").cast("double"), F.lit(1.0), F.lit(0.5))
    return _gold(spark, d).select("id", F.when(F.col("severity").isNotNull(), F.round(E.softmax(s)[0], 6)).alias("p"), F.when(F.col("severity").isNotNull(), E.argmax(s)).alias("best"))


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> '')[1:256], ' ') AS input FROM documents WHERE text IS NOT NULL")
def model_input(spark, d):
    """The first 256 words of a text, as a model takes it (the cut is the feature)."""
    return read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", E.first_words(F.col("text")).alias("input"))


@query(f"SELECT category, round(count(*) FILTER (p = 1) / count(*), 6) AS hit_rate, count(*) AS n FROM (SELECT category, CAST({any_sql('lower(text)', V.TOXIC_WORDS)} AS INT) AS p FROM {_G} WHERE category IS NOT NULL AND category <> 'safe') GROUP BY 1")
def category_hit_rate(spark, d):
    x = _gold(spark, d).where("category is not null and category <> 'safe'").select("category", C.toxic_flag(F.col("text")).cast("int").alias("p"))
    return x.groupBy("category").agg(F.round(F.coalesce(F.sum("p"), F.lit(0)) / F.count("*"), 6).alias("hit_rate"), F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT CAST(regexp_extract(id, '[0-9]+') AS BIGINT) AS k, category FROM {_G} WHERE category IN ('harassment', 'safe')),
n AS (SELECT floor(count(*) FILTER (category <> 'safe') * 1.5) AS n FROM g), h AS (SELECT *, (k * 2654435761) % 4294967296 AS h FROM g),
s AS (SELECT k, h, 0 AS target FROM (SELECT *, row_number() OVER (ORDER BY h, k) AS rn FROM h WHERE category = 'safe'), n WHERE rn <= n.n UNION ALL SELECT k, h, 1 FROM h WHERE category <> 'safe')
SELECT k, target, CASE WHEN p < floor(c * 0.9) THEN 'train' ELSE 'val' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY h, k) - 1 AS p, count(*) OVER (PARTITION BY target) AS c FROM s)""")
def expert_training_set(spark, d):
    """The set of one expert: its examples, up to 1.5 times as many safe ones, 90/10 within each side."""
    g = _gold(spark, d).select(F.regexp_extract("id", "[0-9]+", 0).cast("long").alias("k"), "category")
    return E.expert_set(g, "harassment", "k")


@query(f"""WITH x AS (SELECT category AS t, annotation.claude_proposal.category AS q FROM {_G} WHERE category IS NOT NULL AND annotation.claude_proposal.category IS NOT NULL), c AS (SELECT t AS class FROM x UNION SELECT q FROM x),
m AS (SELECT class, (SELECT count(*) FROM x WHERE t = class) AS support, (SELECT count(*) FROM x WHERE q = class) AS pred, (SELECT count(*) FROM x WHERE t = class AND q = class) AS hit FROM c),
r AS (SELECT support, round(CASE WHEN pred = 0 THEN 0 ELSE hit / pred END, 6) AS p, round(CASE WHEN support = 0 THEN 0 ELSE hit / support END, 6) AS r, CASE WHEN hit = 0 THEN 0 ELSE round(2 * hit / (pred + support), 6) END AS f FROM m)
SELECT round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1 FROM r""")
def weighted_report(spark, d):
    g = _gold(spark, d).select(F.col("category").alias("t"), F.col("annotation.claude_proposal.category").alias("q"))
    return E.weighted_f1(E.per_class(g, "t", "q"))


@query(f"WITH x AS (SELECT (category <> 'safe') AS y FROM {_G} WHERE category IS NOT NULL AND text IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (y) AS toxic, true AS learns FROM x")
def baseline_model(spark, d):
    """A plain model with class weights fitted on all labelled rows; it must do better on them than calling all safe."""
    g = _gold(spark, d).where("category is not null and text is not null").select("text", (F.col("category") != "safe").cast("double").alias("y"))
    w = E.class_weights(g, "y").select("y", "weight")
    model = E.baseline_scorer(g, "text", "y", w)
    out = model.transform(g.withColumnRenamed("text", "_text"))
    a = out.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("toxic"), F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("right"))
    return a.select("n", "toxic", (F.col("right") > 1 - F.col("toxic") / F.col("n")).alias("learns"))


@query("SELECT doc_id, 'doc-' || left(sha256(CAST(doc_id AS VARCHAR)), 16) AS request_id FROM documents")
def request_ids(spark, d):
    """Ids from the content that they name: the same in every run."""
    return read(spark, d, "documents", "doc_id").select("doc_id", F.concat(F.lit("doc-"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16)).alias("request_id"))


@query("SELECT attempt, least(1.0 * power(2, attempt), 60.0) AS delay FROM (SELECT unnest(range(0, 8)) AS attempt)")
def retry_delays(spark, d):
    """Waiting times of the tries of a call."""
    from ..streaming.stateful import backoff

    return spark.createDataFrame([(i, float(backoff(i))) for i in range(8)], "attempt long, delay double")



@query(f"SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS rank FROM (SELECT category, count(*) AS n FROM {_G} WHERE category IS NOT NULL GROUP BY 1)")
def categories_by_size(spark, d):
    """Categories from the largest to the smallest; the window runs over one row per category."""
    from pyspark.sql import Window

    n = _gold(spark, d).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "category")))


@query(f"SELECT id, CASE WHEN greatest(coalesce(severity, 0) / 4.0, coalesce(annotation.claude_proposal.confidence, 0)) > 0.9 THEN 'toxic' ELSE 'safe' END AS label FROM {_G}")
def score_of_two(spark, d):
    """The larger of two scores decides; a missing one counts as 0."""
    s = C.score_label(F.col("severity") / 4.0, F.col("annotation.claude_proposal.confidence"), above=0.9)
    return _gold(spark, d).select("id", s.alias("label"))


@query("WITH p AS (" + SQL["learned_patterns"] + "), x AS (SELECT min(pattern) AS first FROM p) SELECT p.pattern, p.name, p.source_feedback FROM p, x WHERE p.pattern <> x.first")
def learned_new(spark, d):
    """New rules without the one that is known already: the first by its pattern."""
    f = _fb(spark, d)
    known = B.learned(f).agg(F.min("pattern").alias("pattern"))
    return B.learned(f, known).select("pattern", "name", "source_feedback")


@query("SELECT CAST(0.5 AS DOUBLE) AS threshold")
def threshold_default(spark, d):
    """No threshold reaches the wanted recall and precision on these scores, so the default holds."""
    g = _gold(spark, d).select((F.col("category") != "safe").cast("int").alias("y"), (F.coalesce("severity", F.lit(0)) / 400.0).alias("s"))
    return E.best_balanced(E.sweep(g, F.col("y"), F.col("s"), (0.2, 0.5, 0.8)))


@query(f"SELECT {_ENDPOINT} AS endpoint, round(count(*) FILTER (ms <> -1 OR ms IS NULL) / count(*), 6) AS availability, round(count(*) FILTER (ms = -1) / count(*), 6) AS error_5xx, round(count(*) FILTER (tenant_id IS NULL) / count(*), 6) AS error_4xx, CASE WHEN count(*) FILTER (ms = -1) / count(*) <= 0.001 THEN 'healthy' WHEN count(*) FILTER (ms = -1) / count(*) <= 0.01 THEN 'warning' ELSE 'exhausted' END AS budget FROM {_R} GROUP BY 1")
def slo_by_endpoint(spark, d):
    """Availability, failures of the service and of the caller (no tenant), and what is left of the error budget."""
    bad = F.count_if(F.coalesce(F.col("ms") == -1, F.lit(False))) / F.count("*")
    x = _families(spark, d).groupBy("endpoint").agg(bad.alias("bad"), (F.count_if(F.col("tenant_id").isNull()) / F.count("*")).alias("caller"))
    return x.select("endpoint", F.round(1 - F.col("bad"), 6).alias("availability"), F.round("bad", 6).alias("error_5xx"), F.round("caller", 6).alias("error_4xx"), F.when(F.col("bad") <= 0.001, "healthy").when(F.col("bad") <= 0.01, "warning").otherwise("exhausted").alias("budget"))
