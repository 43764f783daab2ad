"""Curation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from ..operators import evaluate as E
from ..rules import fixed_values as V
from .registry import any_sql, lit, query, read, texts

_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_STRIP = f"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"
_SH = "(SELECT DISTINCT * FROM self_harm_generated)"


def _sh(spark, d, *cols):
    """Labelled posts, whole-row repeats once."""
    return read(spark, d, "self_harm_generated", *(cols or ("record_id", "text", "label", "category", "source", "split"))).dropDuplicates(["record_id"])


def _gold(spark, d):
    g = read(spark, d, "gold_v1").dropDuplicates(["id"])
    return g.select("id", "text", "lang", "script", F.col("labels.decision").alias("decision"), F.col("labels.decision_code").alias("decision_code"), F.col("labels.category").alias("category"), F.col("labels.category_code").alias("category_code"), F.col("labels.severity").alias("severity"), F.col("labels.targeted").alias("targeted"), F.col("labels.contains_profanity").alias("contains_profanity"), F.col("metadata.source").alias("source"), F.col("metadata.domain").alias("domain"), F.col("metadata.annotator").alias("annotator"), "annotation")


_G = "(SELECT DISTINCT ON (id) id, text, lang, script, labels.decision AS decision, labels.decision_code AS decision_code, labels.category AS category, labels.category_code AS category_code, labels.severity AS severity, labels.targeted AS targeted, labels.contains_profanity AS contains_profanity, metadata.source AS source, metadata.domain AS domain, metadata.annotator AS annotator, annotation FROM gold_v1)"


# ---- dedupe ----------------------------------------------------------------------------------------
def _dedupe_sql(key: str, where: str = "k <> ''", within: str = "") -> str:
    return f"SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY {within}k ORDER BY record_id) AS rn FROM (SELECT record_id, category, {key} AS k FROM (SELECT DISTINCT ON (record_id) * FROM self_harm_generated) WHERE text IS NOT NULL) WHERE {where}) WHERE rn = 1"


@query(_dedupe_sql(f"lower({_STRIP})"))
def dedupe_normalized(spark, d):
    return C.dedupe(_sh(spark, d, "record_id", "text"), C.normalized_key(F.col("text")), ["record_id"]).select("record_id")


@query(_dedupe_sql("left(text, 100)", "true"))
def dedupe_prefix100(spark, d):
    return C.dedupe(_sh(spark, d, "record_id", "text"), F.substring("text", 1, 100), ["record_id"], drop_empty=False).select("record_id")


@query(_dedupe_sql(f"lower(left({_STRIP}, 200))"))
def dedupe_prefix200(spark, d):
    return C.dedupe(_sh(spark, d, "record_id", "text"), C.normalized_key(F.col("text"), 200), ["record_id"]).select("record_id")


@query(_dedupe_sql(f"lower({_STRIP})", "length(k) > 3", "category, "))
def dedupe_per_category(spark, d):
    src = _sh(spark, d, "record_id", "text", "category")
    return C.dedupe(src.where(F.length(C.normalized_key(F.col("text"))) > 3), C.normalized_key(F.col("text")), ["record_id"], within=["category"]).select("record_id")


@query(f"""WITH u AS (SELECT record_id AS k, 0 AS o, lower({_STRIP}) AS t FROM {_SH} UNION ALL SELECT row_id, 1, lower({_STRIP}) FROM (SELECT DISTINCT * FROM hasoc_hindi_raw))
SELECT k FROM (SELECT k, row_number() OVER (PARTITION BY t ORDER BY o, k) AS rn FROM u WHERE t <> '') WHERE rn = 1""")
def union_distinct(spark, d):
    a = _sh(spark, d, "record_id", "text").select(F.col("record_id").alias("k"), "text", F.lit(0).alias("o"))
    b = read(spark, d, "hasoc_hindi_raw", "row_id", "text").distinct().select(F.col("row_id").alias("k"), "text", F.lit(1).alias("o"))
    return C.dedupe(a.unionByName(b), C.normalized_key(F.col("text")), ["o", "k"]).select("k")


# ---- audits ----------------------------------------------------------------------------------------
@query(f"SELECT category, count(*) AS n, count(DISTINCT lower({_STRIP})) AS unique_texts, count(*) - count(DISTINCT lower({_STRIP})) AS duplicates FROM {_SH} GROUP BY 1")
def dup_stats(spark, d):
    return C.duplicates(_sh(spark, d, "record_id", "text", "category"), "category")


@query(f"SELECT md5(lower({_STRIP})) AS text_key, count(DISTINCT source) AS categories, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def contamination(spark, d):
    """Texts that stand under more than one source."""
    return C.contamination(read(spark, d, "documents", "text", "source"), "source")


for _c in ("label", "category", "source"):
    query(f"SELECT {_c}, count(*) AS n, CAST(floor(count(*) * 100 / sum(count(*)) OVER ()) AS BIGINT) AS pct_floor FROM {_SH} GROUP BY 1", name=f"count_by_{_c}")(lambda spark, d, _c=_c: C.counts(_sh(spark, d, "record_id", _c), _c))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def count_source_lang(spark, d):
    return read(spark, d, "documents", "source", "lang").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, min(length(text)) AS min_len, max(length(text)) AS max_len, CAST(floor(sum(length(text)) / count(text)) AS BIGINT) AS avg_len, round(stddev_pop(length(text)), 6) AS std_len, count(*) FILTER (length(text) < 20) AS short, count(*) FILTER (length(text) > 500) AS long FROM documents GROUP BY 1")
def length_stats(spark, d):
    return C.length_stats(read(spark, d, "documents", "source", "text"), "source")


@query("SELECT source, list_sort(list(length(text)))[CAST(floor(count(text) / 2) AS INT) + 1] AS median FROM documents WHERE text IS NOT NULL GROUP BY 1")
def upper_median(spark, d):
    return C.upper_median(read(spark, d, "documents", "source", "text").where("text is not null"), "source", F.length("text"))


_NW = f"len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> ''))"


@query(f"SELECT label, round(avg({_NW}), 6) AS avg_words, min({_NW}) AS min_words, max({_NW}) AS max_words FROM {_SH} GROUP BY 1")
def word_stats(spark, d):
    n = F.size(C.words(F.col("text")))
    return _sh(spark, d, "record_id", "text", "label").groupBy("label").agg(F.round(F.avg(n), 6).alias("avg_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"))


@query("SELECT * FROM (SELECT lang, source, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 3")
def top_sources(spark, d):
    return C.top_k(read(spark, d, "documents", "lang", "source"), "lang", "source", 3)


@query(f"""WITH x AS (SELECT category, count(*) AS n, count(*) - count(DISTINCT lower({_STRIP})) AS dup, stddev_pop(length(text)) AS sd, count(DISTINCT source) AS so FROM {_SH} GROUP BY 1),
s AS (SELECT category, CASE WHEN n >= 1000 THEN 25 WHEN n >= 500 THEN 15 ELSE 5 END + CASE WHEN dup * 100 / n < 5 THEN 25 WHEN dup * 100 / n < 15 THEN 15 ELSE 5 END + CASE WHEN sd > 50 THEN 25 WHEN sd > 20 THEN 15 ELSE 5 END + CASE WHEN so >= 3 THEN 25 WHEN so = 2 THEN 15 ELSE 5 END AS score FROM x)
SELECT category, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM s""")
def readiness(spark, d):
    return C.readiness(_sh(spark, d, "record_id", "text", "category", "source"), "category")


@query(f"SELECT count(*) FILTER (lower(label) = 'safe' AND {any_sql('lower(text)', V.TOXIC_INDICATORS)}) AS toxic_in_safe, count(*) FILTER (lower(label) = 'toxic' AND {_NW} < 10 AND {any_sql('lower(text)', V.SAFE_INDICATORS)} AND NOT {any_sql('lower(text)', V.TOXIC_INDICATORS)}) AS safe_in_toxic, count(*) AS n, round((count(*) FILTER (lower(label) = 'safe' AND {any_sql('lower(text)', V.TOXIC_INDICATORS)}) + count(*) FILTER (lower(label) = 'toxic' AND {_NW} < 10 AND {any_sql('lower(text)', V.SAFE_INDICATORS)} AND NOT {any_sql('lower(text)', V.TOXIC_INDICATORS)})) * 100 / count(*), 4) AS error_rate FROM {_SH}")
def label_issues(spark, d):
    low, lab = F.lower("text"), F.lower("label")
    bad, calm = C.any_of(low, V.TOXIC_INDICATORS), C.any_of(low, V.SAFE_INDICATORS)
    x = _sh(spark, d, "record_id", "text", "label").agg(F.count_if((lab == "safe") & bad).alias("toxic_in_safe"), F.count_if((lab == "toxic") & (F.size(C.words(F.col("text"))) < 10) & calm & ~bad).alias("safe_in_toxic"), F.count("*").alias("n"))
    return x.withColumn("error_rate", F.round((F.col("toxic_in_safe") + F.col("safe_in_toxic")) * 100 / F.col("n"), 4))


@query(f"WITH c AS (SELECT category, count(*) AS n FROM {_SH} GROUP BY 1), t AS (SELECT coalesce(sum(n) FILTER (category <> 'safe'), 0) AS toxic FROM c) SELECT category, n, CASE WHEN n >= 1000 THEN 'good' WHEN n >= 300 THEN 'ok' ELSE 'weak' END AS status, CAST(floor(1.5 * n) AS BIGINT) AS safe_needed FROM c")
def expert_status(spark, d):
    n = _sh(spark, d, "record_id", "category").groupBy("category").agg(F.count("*").alias("n"))
    return n.select("category", "n", F.when(F.col("n") >= 1000, "good").when(F.col("n") >= 300, "ok").otherwise("weak").alias("status"), F.floor(F.col("n") * 1.5).alias("safe_needed"))


# ---- labels ----------------------------------------------------------------------------------------
@query(f"SELECT id, CASE WHEN coalesce(severity, 0) / 4.0 > 0.5 THEN 'toxic' ELSE 'safe' END AS by_score, CASE WHEN category IN ('hate_speech', 'harassment') THEN 'toxic' ELSE 'safe' END AS by_class, CASE WHEN targeted THEN 'toxic' ELSE 'safe' END AS by_flag FROM {_G}")
def binary_labels(spark, d):
    return _gold(spark, d).select("id", C.score_label(F.col("severity") / 4.0).alias("by_score"), C.class_label(F.col("category"), ["hate_speech", "harassment"]).alias("by_class"), C.binary_label(F.col("targeted").cast("int")).alias("by_flag"))


_NL = "lower(category)"


@query(f"""SELECT id, CASE WHEN {_NL} IN ('safe', 'not_hate', 'normal') THEN 'safe' ELSE 'toxic' END AS label,
CASE WHEN {_NL} IN ('safe', 'not_hate', 'normal') THEN 'safe' WHEN contains({_NL}, 'harassment') THEN 'harassment' WHEN contains({_NL}, 'hate') THEN 'hate_speech' WHEN contains({_NL}, 'threat') OR contains({_NL}, 'violence') THEN 'violence' WHEN contains({_NL}, 'sexual') THEN 'sexual' ELSE 'harassment' END AS category FROM {_G} WHERE category IS NOT NULL""")
def normalize_label(spark, d):
    label, category = C.normalize_label(F.col("category"))
    return _gold(spark, d).where("category is not null").select("id", label.alias("label"), category.alias("category"))


_LOWT = "lower(text)"
_THIRD = "CASE WHEN label = 'safe' THEN coalesce(" + ", ".join([f"CASE WHEN contains({_LOWT}, {lit(w)}) THEN {lit(f'contains {chr(39)}{w}{chr(39)}')} END" for w in V.ALWAYS_TOXIC] + [f"CASE WHEN contains({_LOWT}, {lit(w)}) AND {any_sql(_LOWT, c)} AND NOT {any_sql(_LOWT, V.DISCUSSION)} THEN {lit(f'{chr(39)}{w}{chr(39)} with violent context')} END" for w, c in V.CONTEXT_DEPENDENT.items()]) + ") END"
_ROWS = f"(SELECT id, text, CASE WHEN category = 'safe' THEN 'safe' ELSE 'toxic' END AS label FROM {_G})"


@query(f"""SELECT id, CASE WHEN label = 'safe' AND {any_sql(_LOWT, V.TOXIC_INDICATORS)} THEN 'toxic' ELSE label END AS first_pass,
CASE WHEN label = 'safe' THEN CASE WHEN {any_sql(_LOWT, V.STRONG_TOXIC)} THEN 'strong_toxic' WHEN {any_sql(_LOWT, V.CONTEXT_TOXIC)} AND {any_sql(_LOWT, V.BAD_CONTEXT)} AND {any_sql(_LOWT, V.DIRECTED)} THEN 'directed_toxic' END END AS second_pass,
{_THIRD} AS third_pass FROM {_ROWS}""")
def relabel(spark, d):
    label = F.when(F.col("category") == "safe", "safe").otherwise("toxic")
    g = _gold(spark, d).select("id", "text", label.alias("label"))
    t, lab = F.col("text"), F.col("label")
    return g.select("id", C.relabel_first(t, lab).alias("first_pass"), C.relabel_second(t, lab).alias("second_pass"), C.relabel_third(t, lab).alias("third_pass"))


_SCORES = {c: "(" + " + ".join(f"CAST(regexp_matches(text, {lit(p)}) AS INT)" for p in ps) + ")" for c, ps in V.CATEGORY_PATTERNS.items()}
_TOP = f"greatest({', '.join(_SCORES.values())})"


@query(f"SELECT id, CASE WHEN label = 'safe' THEN 'safe' WHEN {_TOP} > 0 THEN CASE " + " ".join(f"WHEN {s} = {_TOP} THEN '{c}'" for c, s in _SCORES.items()) + f" END ELSE 'harassment' END AS category FROM {_ROWS}")
def categorize(spark, d):
    label = F.when(F.col("category") == "safe", "safe").otherwise("toxic")
    return _gold(spark, d).select("id", C.categorize(F.col("text"), label).alias("category"))


@query(f"SELECT CASE WHEN category IN ('violence', 'dangerous') THEN 'harmful_content' ELSE category END AS category, category AS original_category, count(*) AS n FROM {_G} GROUP BY ALL")
def merge_categories(spark, d):
    return _gold(spark, d).groupBy(C.merge_category(F.col("category")).alias("category"), F.col("category").alias("original_category")).agg(F.count("*").alias("n"))


_DEVA, _LAT = "regexp_matches(text, '[\\x{0900}-\\x{097F}]')", "regexp_matches(text, '[A-Za-z]')"


@query(f"""SELECT doc_id, CASE WHEN {_DEVA} AND {_LAT} THEN 'mixed' WHEN {_DEVA} THEN 'devanagari' ELSE 'english' END AS script,
{_DEVA} OR ({' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in V.HINGLISH)}) >= 2 AS has_hindi,
{_DEVA} OR ({' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in V.HINGLISH_SHORT)}) >= 2 AS has_hindi_short,
{any_sql('lower(text)', V.TOXIC_WORDS)} AS toxic FROM documents WHERE text IS NOT NULL""")
def script_flags(spark, d):
    t = F.col("text")
    return texts(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", C.script(t).alias("script"), C.has_hindi(t).alias("has_hindi"), C.has_hindi(t, V.HINGLISH_SHORT).alias("has_hindi_short"), C.toxic_flag(t).alias("toxic"))


@query(f"SELECT doc_id FROM documents WHERE text NOT IN ('[deleted]', '[removed]') AND length(text) > 20 AND ({any_sql('lower(text)', V.TOXIC_WORDS)} OR length(text) > 500)")
def relevance_filter(spark, d):
    t = F.col("text")
    return read(spark, d, "documents", "doc_id", "text").where(~t.isin("[deleted]", "[removed]") & (F.length(t) > 20) & (C.toxic_flag(t) | (F.length(t) > 500))).select("doc_id")


@query("SELECT row_id, (length(text) - length(replace(text, '@', ''))) AS mentions FROM (SELECT DISTINCT * FROM hasoc_hindi_raw) WHERE length(text) - length(replace(text, '@', '')) >= 1")
def mention_filter(spark, d):
    n = F.size(F.split("text", "@")) - 1
    return read(spark, d, "hasoc_hindi_raw").distinct().select("row_id", n.alias("mentions")).where("mentions >= 1")


# ---- gold checks -----------------------------------------------------------------------------------
_CODE = "CASE decision WHEN 'ALLOW' THEN 0 WHEN 'WARN' THEN 1 WHEN 'BLOCK' THEN 2 END"


@query(f"""SELECT id, length(text) BETWEEN 5 AND 500 AS length_ok, (decision = 'ALLOW') = (category = 'safe') AS category_ok, CASE decision WHEN 'ALLOW' THEN severity <= 1 WHEN 'WARN' THEN severity BETWEEN 1 AND 2 WHEN 'BLOCK' THEN severity BETWEEN 3 AND 4 END AS severity_ok,
{_CODE} = decision_code AS code_ok, CASE lower(lang) WHEN 'hi' THEN script IN ('devanagari', 'mixed') WHEN 'mr' THEN script IN ('devanagari', 'mixed') WHEN 'en' THEN script IN ('latin', 'mixed') WHEN 'hinglish' THEN script IN ('latin', 'mixed') WHEN 'es' THEN script IN ('latin', 'mixed') END AS script_ok FROM {_G}""")
def gold_validation(spark, d):
    g = _gold(spark, d)
    s, low = F.col("severity"), F.lower("lang")
    code = F.when(F.col("decision") == "ALLOW", 0).when(F.col("decision") == "WARN", 1).when(F.col("decision") == "BLOCK", 2)
    return g.select("id", F.length("text").between(5, 500).alias("length_ok"), ((F.col("decision") == "ALLOW") == (F.col("category") == "safe")).alias("category_ok"), F.when(F.col("decision") == "ALLOW", s <= 1).when(F.col("decision") == "WARN", s.between(1, 2)).when(F.col("decision") == "BLOCK", s.between(3, 4)).alias("severity_ok"), (code == F.col("decision_code")).alias("code_ok"), F.when(low.isin("hi", "mr"), F.col("script").isin("devanagari", "mixed")).when(low.isin("en", "hinglish", "es"), F.col("script").isin("latin", "mixed")).alias("script_ok"))


@query(f"""SELECT id, coalesce(contains_profanity AND decision = 'ALLOW', false) AS profanity_allowed, coalesce(decision = 'BLOCK' AND annotation.claude_proposal.confidence < 0.8, false) AS unsure_block, coalesce(lower(lang) IN ('hi', 'hinglish'), false) AS needs_speaker, coalesce(decision <> annotation.claude_proposal.decision, false) AS disagrees FROM {_G}""")
def review_triggers(spark, d):
    p = F.col("annotation.claude_proposal")
    no = lambda c: F.coalesce(c, F.lit(False))
    return _gold(spark, d).select("id", no(F.col("contains_profanity") & (F.col("decision") == "ALLOW")).alias("profanity_allowed"), no((F.col("decision") == "BLOCK") & (p["confidence"] < 0.8)).alias("unsure_block"), no(F.lower("lang").isin("hi", "hinglish")).alias("needs_speaker"), no(F.col("decision") != p["decision"]).alias("disagrees"))


@query("SELECT doc_id, contains(text, '@') AS has_at, regexp_matches(text, '[0-9]{4}') AS has_digits, " + _NW + " AS words, length(text) AS chars, sha256(text) AS text_hash FROM documents WHERE text IS NOT NULL")
def privacy_features(spark, d):
    t = F.col("text")
    return read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", t.contains("@").alias("has_at"), t.rlike("[0-9]{4}").alias("has_digits"), F.size(C.words(t)).alias("words"), F.length(t).alias("chars"), F.sha2(t, 256).alias("text_hash"))


# ---- balance, split, sample ------------------------------------------------------------------------
_H = "((doc_id * 2654435761) % 4294967296)"


@query(f"""WITH t AS (SELECT doc_id, {any_sql('lower(text)', V.TOXIC_WORDS)} AS toxic FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) FILTER (toxic) AS n FROM t),
s AS (SELECT doc_id, row_number() OVER (ORDER BY {_H}, doc_id) AS rn FROM t WHERE NOT toxic)
SELECT doc_id, 'toxic' AS label FROM t WHERE toxic UNION ALL SELECT doc_id, 'safe' FROM s, n WHERE rn <= floor(n.n * 1.5)""")
def undersample(spark, d):
    src = read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.when(C.toxic_flag(F.col("text")), "toxic").otherwise("safe").alias("label"))
    return C.undersample(src, "label", 1.5, "doc_id")


def _split_sql(within: str, cuts) -> str:
    part = f"PARTITION BY {within}" if within else ""
    case = "CASE " + " ".join(f"WHEN p < floor(n * {c}) THEN '{s}'" for s, c in cuts[:-1]) + f" ELSE '{cuts[-1][0]}' END"
    return f"SELECT doc_id, {case} AS split FROM (SELECT doc_id, row_number() OVER ({part} ORDER BY {_H}, doc_id) - 1 AS p, count(*) OVER ({part}) AS n FROM documents)"


@query(_split_sql("", (("train", 0.8), ("val", 0.9), ("test", 1.0))))
def split_80_10_10(spark, d):
    return C.split_positions(read(spark, d, "documents", "doc_id"), "doc_id").select("doc_id", "split")


@query(_split_sql("lang", (("train", 0.9), ("test", 1.0))))
def stratified_split(spark, d):
    return C.split_positions(read(spark, d, "documents", "doc_id", "lang"), "doc_id", ["lang"], (("train", 0.9), ("test", 1.0))).select("doc_id", "split")


@query(f"SELECT channel, doc_id FROM (SELECT channel, doc_id, row_number() OVER (PARTITION BY channel ORDER BY {_H}, doc_id) AS rn FROM documents) WHERE rn <= 2")
def review_sample(spark, d):
    return C.review_sample(read(spark, d, "documents", "channel", "doc_id"), "channel", "doc_id", 2).select("channel", "doc_id")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 20 AS BIGINT) AS batch FROM documents")
def batch_index(spark, d):
    at = C.positions(read(spark, d, "documents", "doc_id"), F.floor(F.col("doc_id") / 10_000), ["doc_id"])
    return at.select("doc_id", F.floor(F.col("_pos") / 20).alias("batch"))


@query(f"SELECT doc_id FROM documents ORDER BY {_H}, doc_id")
def shuffled(spark, d):
    return C.shuffled(read(spark, d, "documents", "doc_id"), "doc_id")


@query("SELECT category, text FROM (SELECT category, text, row_number() OVER (PARTITION BY category ORDER BY record_id) AS rn FROM (SELECT DISTINCT record_id, category, left(text, 60) AS text FROM self_harm_generated)) WHERE rn <= 5")
def preview(spark, d):
    """The first five of each category, cut to 60 characters (a preview: both limits are its feature)."""
    from pyspark.sql import Window

    x = read(spark, d, "self_harm_generated", "record_id", "category", F.substring("text", 1, 60).alias("text")).distinct()
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("record_id"))).where("rn <= 5").select("category", "text")


# ---- sets and joins --------------------------------------------------------------------------------
@query("""SELECT dataset, source, count(*) AS n, count(label) AS labelled FROM (
SELECT 'self_harm' AS dataset, source, label FROM self_harm_generated UNION ALL SELECT 'hasoc', NULL, task1 FROM hasoc_hindi_raw UNION ALL SELECT 'documents', source, NULL FROM documents) GROUP BY 1, 2""")
def union_sources(spark, d):
    u = C.union_sources([("self_harm", read(spark, d, "self_harm_generated", "text", "label", "source")), ("hasoc", read(spark, d, "hasoc_hindi_raw", "text", F.col("task1").alias("label"))), ("documents", read(spark, d, "documents", "text", "source"))])
    return u.groupBy("dataset", "source").agg(F.count("*").alias("n"), F.count("label").alias("labelled"))


_SIDES = "WITH s AS (SELECT DISTINCT record_id, text, lower(trim(split)) AS side FROM self_harm_generated), t AS (SELECT text FROM s WHERE side = 'train' AND text IS NOT NULL)"


def _sides(spark, d):
    s = _sh(spark, d, "record_id", "text", "split").withColumn("side", F.lower(F.trim("split")))
    return s.where("side in ('val', 'test')"), s.where("side = 'train'")


@query(_SIDES + " SELECT record_id FROM s WHERE side IN ('val', 'test') AND (text IS NULL OR text NOT IN (SELECT text FROM t))")
def anti_existing(spark, d):
    """Evaluation records whose text does not stand in train."""
    other, train = _sides(spark, d)
    return C.anti_existing(other, train.select("text")).select("record_id")


@query("SELECT replace('people in {} say no', '{}', n_name) AS text FROM nation UNION ALL SELECT replace('go home to {}', '{}', n_name) FROM nation")
def template_cross(spark, d):
    t = spark.createDataFrame([("people in {} say no",), ("go home to {}",)], "template string")
    return C.generate(t, read(spark, d, "nation", F.col("n_name").alias("term"))).select("text")


@query(_SIDES + " SELECT record_id FROM s WHERE side IN ('val', 'test') AND text IN (SELECT text FROM t)")
def exact_benchmark_hits(spark, d):
    """Evaluation records whose text stands in train as it is."""
    other, train = _sides(spark, d)
    return other.join(train.select(F.col("text").alias("t")), F.col("text") == F.col("t"), "left_semi").select("record_id")


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f, event_type) AS rn, sum(c) OVER (PARTITION BY user_id) AS votes FROM v)
SELECT user_id, event_type AS winner, CAST(votes AS BIGINT) AS votes, c / votes AS agreement FROM r WHERE rn = 1""")
def majority_vote(spark, d):
    return C.majority(read(spark, d, "events", "user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


@query("""WITH v AS (SELECT user_id, max(c) / sum(c) AS a FROM (SELECT user_id, event_type, count(*) AS c FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT count(*) FILTER (a >= 0.3) AS strong, count(*) FILTER (a >= 0.25 AND a < 0.3) AS fair, count(*) FILTER (a < 0.25) AS weak FROM v""")
def agreement_buckets(spark, d):
    m = C.majority(read(spark, d, "events", "user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")
    a = F.col("agreement")
    return m.agg(F.count_if(a >= 0.3).alias("strong"), F.count_if((a >= 0.25) & (a < 0.3)).alias("fair"), F.count_if(a < 0.25).alias("weak"))


@query("SELECT CAST((count(*) + 24) // 25 AS BIGINT) AS batches, round(CAST((count(*) + 24) // 25 AS DOUBLE) * 0.002, 6) AS cost FROM documents")
def annotation_cost(spark, d):
    n = read(spark, d, "documents", "doc_id").agg(F.count("*").alias("n"))
    b = F.floor((F.col("n") + 24) / 25)
    return n.select(b.alias("batches"), F.round(b * 0.002, 6).alias("cost"))


# ---- evaluation ------------------------------------------------------------------------------------
_EV = f"(SELECT id, lang, category, CASE WHEN category IS NULL THEN NULL WHEN category = 'safe' THEN 0 ELSE 1 END AS y, CAST({any_sql('lower(text)', V.TOXIC_WORDS)} AS INT) AS p, coalesce(severity, 0) / 4.0 AS s FROM {_G})"


def _ev(spark, d):
    return _gold(spark, d).select("id", "lang", "category", (F.col("category") != "safe").cast("int").alias("y"), C.toxic_flag(F.col("text")).cast("int").alias("p"), (F.coalesce("severity", F.lit(0)) / 4.0).alias("s"))


_CONF = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn"


@query(f"SELECT lang, {_CONF} FROM {_EV} WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY 1")
def confusion_by_lang(spark, d):
    return E.confusion(_ev(spark, d), F.col("y"), F.col("p"), "lang")


def _metric_sql(src: str, by: str = "") -> str:
    return f"""SELECT {by} round(CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + tn + fn) END, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM {src})"""


@query(_metric_sql(f"(SELECT {_CONF} FROM {_EV} WHERE y IS NOT NULL AND p IS NOT NULL)"))
def prf1(spark, d):
    return E.metrics(E.confusion(_ev(spark, d), F.col("y"), F.col("p")))


_THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
_SWEEP = _metric_sql("(" + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, {_CONF} FROM (SELECT y, CAST(s >= {t} AS INT) AS p FROM {_EV}) WHERE y IS NOT NULL" for t in _THRESHOLDS) + ")", "threshold,")


@query(_SWEEP)
def threshold_sweep(spark, d):
    return E.sweep(_ev(spark, d), F.col("y"), F.col("s"), _THRESHOLDS)


@query(f"SELECT * FROM ({_SWEEP}) ORDER BY recall DESC, threshold LIMIT 1")
def threshold_best_recall(spark, d):
    return E.best_recall(E.sweep(_ev(spark, d), F.col("y"), F.col("s"), _THRESHOLDS))


@query(f"SELECT coalesce((SELECT threshold FROM ({_SWEEP}) WHERE recall >= 0.5 AND precision >= 0.5 ORDER BY recall + 0.5 * precision DESC, threshold LIMIT 1), 0.5) AS threshold")
def threshold_balanced(spark, d):
    return E.best_balanced(E.sweep(_ev(spark, d), F.col("y"), F.col("s"), _THRESHOLDS), 0.5, 0.5)


@query(f"WITH c AS (SELECT category, count(*) AS n FROM {_G} WHERE category IS NOT NULL GROUP BY 1) SELECT category, n, round(sum(n) OVER () / (count(*) OVER () * n) * CASE WHEN category = 'self_harm' THEN 2.0 ELSE 1.0 END, 6) AS weight FROM c")
def class_weights(spark, d):
    return E.class_weights(_gold(spark, d), "category", {"self_harm": 2.0})


@query(f"SELECT category, row_number() OVER (ORDER BY category) - 1 AS label_id FROM (SELECT DISTINCT category FROM {_G} WHERE category IS NOT NULL)")
def label_index(spark, d):
    return E.label_index(_gold(spark, d), "category")


@query(f"""WITH x AS (SELECT category AS t, annotation.claude_proposal.category AS q FROM {_G} WHERE category IS NOT NULL AND annotation.claude_proposal.category IS NOT NULL), c AS (SELECT t AS class FROM x UNION SELECT q FROM x),
m AS (SELECT class, (SELECT count(*) FROM x WHERE t = class) AS support, (SELECT count(*) FROM x WHERE q = class) AS pred, (SELECT count(*) FROM x WHERE t = class AND q = class) AS hit FROM c),
r AS (SELECT class, support, CASE WHEN pred = 0 THEN 0 ELSE hit / pred END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM m)
SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r""")
def per_class_report(spark, d):
    g = _gold(spark, d).select(F.col("category").alias("t"), F.col("annotation.claude_proposal.category").alias("q"))
    return E.per_class(g, "t", "q")


@query(f"SELECT lang, count(*) FILTER (decision = 'ALLOW') AS allow, count(*) FILTER (decision = 'WARN') AS warn, count(*) FILTER (decision = 'BLOCK') AS block FROM {_G} GROUP BY 1")
def decisions_by_lang(spark, d):
    x = _gold(spark, d).groupBy("lang").pivot("decision", ["ALLOW", "WARN", "BLOCK"]).agg(F.count(F.lit(1)))
    return x.select("lang", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("ALLOW", "WARN", "BLOCK")])


@query(f"SELECT count(*) FILTER (y = 1) AS toxic, round(CASE WHEN count(*) FILTER (y = 1) = 0 THEN 0 ELSE count(*) FILTER (y = 1 AND p = 1) / count(*) FILTER (y = 1) END, 6) AS hit_rate FROM {_EV}")
def critical_hit_rate(spark, d):
    a = _ev(spark, d).agg(F.count_if(F.expr("y = 1")).alias("toxic"), F.count_if(F.expr("y = 1 and p = 1")).alias("h"))
    return a.select("toxic", F.round(E.ratio(F.col("h"), F.col("toxic")), 6).alias("hit_rate"))


