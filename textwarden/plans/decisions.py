"""Decision queries: rules over documents and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detect as D
from ..operators.decide import Policy, analyze, batch, exploded
from ..operators import scorer as S
from ..rules import fixed_values as V
from ..rules.packs import FINANCE, INJECTION, PII, TOXIC
from .registry import any_sql, lit, query, read, texts

# SQL engines without look-around get the same rule with consuming classes; enough to tell whether it matches
_SSN = r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d\d|6[0-57-9]\d|66[0-57-9])[-\s]?(?:0[1-9]|[1-9]\d)[-\s]?(?:000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{3})\b"
PLAIN = {
    r.no: (r.pattern if "(?<" not in r.pattern and "(?!" not in r.pattern else _SSN if r.category == "pii_ssn" else r.pattern.replace(r"(?<!\d)", "(?:^|[^0-9])").replace(r"(?![@\d])", "(?:[^@0-9]|$)"))
    for r in PII
}
EXACT = [r for r in PII if PLAIN[r.no] == r.pattern]
EXACT_TYPES = tuple(dict.fromkeys(r.category for r in PII if all(PLAIN[x.no] == x.pattern for x in PII if x.category == r.category)))
_CLASS_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def sql_pattern(p: str) -> str:
    """White space of every kind, as the Unicode class has it."""
    out, inside, i = "", False, 0
    while i < len(p):
        if p[i] == "\\" and i + 1 < len(p):
            out += (_CLASS_WS[1:-1] if inside else _CLASS_WS) if p[i + 1] == "s" else p[i : i + 2]
            i += 2
            continue
        inside = True if p[i] == "[" else False if p[i] == "]" else inside
        out += p[i]
        i += 1
    return out


def hit(col: str, p: str) -> str:
    return f"regexp_matches({col}, {lit(sql_pattern(p))})"


def _docs(spark, d):
    return texts(spark, d, "documents", "doc_id", "text")


def _low(df):
    return df.withColumn("low", D.low_text(F.col("text")))


def _matches_sql(rules) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {r.no} AS rule_no, '{r.category}' AS category, '{r.severity}' AS severity, unnest(regexp_extract_all(text, {lit(sql_pattern(r.pattern))}, {r.group})) AS matched_text FROM documents" for r in rules)


_M = f"m AS (SELECT * FROM ({_matches_sql(EXACT)}) WHERE length(matched_text) >= 4 AND NOT (category = 'pii_bank_account' AND length(matched_text) = 10 AND regexp_matches(matched_text, '^[6-9]')))"


@query(f"WITH {_M} SELECT doc_id, category, matched_text, count(*) AS n FROM m WHERE category <> 'pii_phone' GROUP BY ALL")
def pii_matches(spark, d):
    types = [t for t in dict.fromkeys(r.category for r in EXACT) if t != "pii_phone"]
    found = _docs(spark, d).select("doc_id", F.explode(D.pii_all("text", types)).alias("x"))
    return found.groupBy("doc_id", F.col("x.category").alias("category"), F.col("x.matched_text").alias("matched_text")).agg(F.count("*").alias("n"))


_PHONE = [r for r in PII if r.category == "pii_phone"]


@query("WITH " + ", ".join(f"r{r.no} AS (SELECT doc_id FROM documents WHERE {hit('text', PLAIN[r.no])})" for r in [*_PHONE, *[r for r in PII if r.category == 'pii_ssn']]) + " " + " UNION ALL ".join(f"SELECT {r.no} AS rule_no, '{r.category}' AS category, count(*) AS documents FROM r{r.no}" for r in [*_PHONE, *[r for r in PII if r.category == 'pii_ssn']]))
def pii_phone_ssn_rules(spark, d):
    rules = [r for r in PII if r.category in ("pii_phone", "pii_ssn")]
    one = _docs(spark, d).agg(*[F.count_if(F.col("text").rlike(r.java)).alias(f"r{r.no}") for r in rules])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r.no).alias("rule_no"), F.lit(r.category).alias("category"), F.col(f"r{r.no}").alias("documents")) for r in rules])).alias("x")).select("x.*")


_EMAIL = PII[0]


@query(f"""WITH a AS (SELECT doc_id, regexp_extract_all(text, {lit(_EMAIL.pattern)}) AS m, string_split_regex(text, {lit(_EMAIL.pattern)}) AS g FROM documents),
b AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM a)
SELECT doc_id, m[i] AS matched_text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start_pos FROM b""")
def pii_email_spans(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(D.spans(F.col("text"), _EMAIL.java)).alias("x")).select("doc_id", F.col("x.m").alias("matched_text"), F.col("x.s").cast("long").alias("start_pos"))


@query(f"WITH {_M} SELECT category, count(*) AS detections, count(DISTINCT doc_id) AS documents FROM (SELECT DISTINCT doc_id, category, matched_text FROM m WHERE category IN {EXACT_TYPES}) GROUP BY 1")
def pii_by_category(spark, d):
    found = exploded(analyze(_docs(spark, d), Policy(pii_types=EXACT_TYPES, detect_injection=False, detect_finance=False, detect_toxicity=False)))
    return found.groupBy("category").agg(F.count("*").alias("detections"), F.countDistinct("doc_id").alias("documents"))


@query(f"WITH {_M} SELECT severity, count(*) AS detections FROM (SELECT DISTINCT doc_id, category, severity, matched_text FROM m WHERE category IN {EXACT_TYPES}) GROUP BY 1")
def pii_severity_rollup(spark, d):
    found = exploded(analyze(_docs(spark, d), Policy(pii_types=EXACT_TYPES, detect_injection=False, detect_finance=False, detect_toxicity=False)))
    return found.groupBy("severity").agg(F.count("*").alias("detections"))


@query("WITH m AS (SELECT doc_id, " + ", ".join(f"{hit('text', PLAIN[r.no])} AS r{r.no}" for r in PII) + " FROM documents) " + " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS documents FROM m WHERE {' OR '.join(f'r{r.no}' for r in PII if r.category == c)} HAVING count(*) > 0" for c in dict.fromkeys(r.category for r in PII)))
def pii_documents(spark, d):
    """Documents with each kind of personal data, all rules."""
    found = exploded(analyze(_docs(spark, d), Policy(detect_injection=False, detect_finance=False, detect_toxicity=False)))
    return found.groupBy("category").agg(F.countDistinct("doc_id").alias("documents"))


@query(f"SELECT doc_id, regexp_replace(text, {lit(_EMAIL.pattern)}, '[REDACTED]', 'g') AS redacted_text FROM documents WHERE regexp_matches(text, {lit(_EMAIL.pattern)})")
def redact_email(spark, d):
    return analyze(_docs(spark, d), Policy(pii_types=("pii_email",), detect_injection=False, detect_finance=False, detect_toxicity=False)).where("action = 'redact'").select("doc_id", "redacted_text")


@query()
def redact_all_fixed(spark, d):
    return analyze(_docs(spark, d), Policy(detect_injection=False, detect_finance=False, detect_toxicity=False)).where("action = 'redact'").select("doc_id", "redacted_text")


@query()
def redact_all_strict(spark, d):
    return analyze(_docs(spark, d), Policy(detect_injection=False, detect_finance=False, detect_toxicity=False, compat="strict")).where("action = 'redact'").select("doc_id", "redacted_text")


@query(f"WITH {_M} SELECT doc_id, category, CASE WHEN length(matched_text) <= 4 THEN '***' ELSE left(matched_text, 2) || repeat('*', length(matched_text) - 4) || right(matched_text, 2) END AS masked FROM (SELECT DISTINCT doc_id, category, matched_text FROM m WHERE category IN {EXACT_TYPES})")
def mask_pii(spark, d):
    found = exploded(analyze(_docs(spark, d), Policy(pii_types=EXACT_TYPES, detect_injection=False, detect_finance=False, detect_toxicity=False)))
    return found.select("doc_id", "category", D.mask(F.col("matched_text")).alias("masked"))


def _first_sql(rules) -> str:
    cats = list(dict.fromkeys(r.category for r in rules))
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, CASE " + " ".join(f"WHEN {hit('text', r.pattern)} THEN {lit(r.explanation)}" for r in rules if r.category == c) + " END AS explanation FROM documents" for c in cats)


_FIN = sorted(FINANCE, key=lambda r: r.severity, reverse=True)


def _key(value) -> str:
    return "CASE " + " ".join(f"WHEN {hit('text', r.pattern)} THEN {lit(value(r))}" for r in TOXIC) + " END"


@query(f"SELECT id, category, explanation FROM (SELECT DISTINCT id, {_key(lambda r: r.category)} AS category, {_key(lambda r: '[KEYWORD] ' + r.explanation)} AS explanation FROM gold_v1) WHERE category IS NOT NULL")
def keyword_first_rule(spark, d):
    g = read(spark, d, "gold_v1", "id", "text").distinct()
    return _low(g).select("id", F.explode(D.keyword("text", "low")).alias("x")).select("id", "x.category", "x.explanation")


_LOW = f"regexp_replace(lower(text), '^{_CLASS_WS}+|{_CLASS_WS}+$', '', 'g')"
_NWORDS = f"len(list_filter(string_split_regex(text, '{_CLASS_WS}+'), lambda w: w <> ''))"
_SAFE = f"({any_sql(_LOW, V.SAFE_PHRASES_EN)} OR ({any_sql(_LOW, V.SAFE_PHRASES_HI)} AND NOT {any_sql(_LOW, V.SLURS_HI)}))"


@query(f"SELECT DISTINCT id, {_SAFE} AS safe_phrase, {any_sql(_LOW, V.SAFE_PHRASES_HI)} AND NOT {any_sql(_LOW, V.SLURS_HI_CHECK)} AS safe_hindi FROM gold_v1")
def safe_phrases(spark, d):
    return read(spark, d, "gold_v1", "id", "text").distinct().select("id", D.safe_phrase(F.col("text")).alias("safe_phrase"), D.safe_hindi(F.col("text")).alias("safe_hindi"))


@query(f"SELECT DISTINCT id, CAST(CASE WHEN {_NWORDS} <= 3 THEN 0.85 WHEN {_NWORDS} <= 6 THEN 0.8 WHEN {_NWORDS} <= 12 THEN 0.75 ELSE 0.7 END AS DOUBLE) AS threshold FROM gold_v1")
def dynamic_threshold(spark, d):
    return read(spark, d, "gold_v1", "id", "text").distinct().select("id", D.dynamic_threshold(F.col("text")).alias("threshold"))


# one word of each text: the first handle-like token, so that single words are exercised
_TOKEN = "regexp_extract(lower(text), '[a-z]+', 0)"
_TRIPLE = "|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")


@query(f"SELECT w AS word, length(w) < 2 OR (length(w) > 3 AND (length(regexp_replace(w, '[^aeiou]', '', 'g')) / length(w) < 0.15 OR regexp_matches(w, '{_TRIPLE}') OR regexp_matches(w, '[b-df-hj-np-tv-z]{{4}}'))) AS gibberish FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM gold_v1)")
def gibberish(spark, d):
    w = read(spark, d, "gold_v1", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", D.gibberish(F.col("word")).alias("gibberish"))


_NAMES = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {hit('text', p)} THEN '{n}' END" for n, p in V.SUSPICIOUS) + "], lambda x: x IS NOT NULL)))"
_HITS = "(" + " + ".join(f"CAST({hit('text', p)} AS INT)" for _, p in V.SUSPICIOUS) + ")"
_CLEAR = "(" + " OR ".join(hit("text", p) for p in V.CLEARLY_SAFE) + ")"


@query(f"""WITH a AS (SELECT DISTINCT id, text, {_CLEAR} AS clear, {_HITS} AS hits, {_NAMES} AS names FROM gold_v1)
SELECT id, NOT clear AND hits > 0 AS escalate, CASE WHEN clear THEN 'clearly_safe' WHEN hits > 0 THEN 'suspicious' WHEN {_NWORDS} < 5 THEN 'short_text' ELSE 'no_indicators' END AS reason,
CAST(round(CASE WHEN clear THEN 0.95 WHEN hits > 0 THEN least(0.95, 0.6 + 0.1 * hits) WHEN {_NWORDS} < 5 THEN 0.8 ELSE 0.7 END, 4) AS DOUBLE) AS confidence, CASE WHEN clear THEN '' ELSE array_to_string(names, ',') END AS names FROM a""")
def escalation_classify(spark, d):
    x = _low(read(spark, d, "gold_v1", "id", "text").distinct()).select("id", D.escalation("text", low="low").alias("e"))
    return x.select("id", "e.escalate", "e.reason", F.round("e.confidence", 4).alias("confidence"), F.array_join("e.names", ",").alias("names"))


def _stage(name: str, rules, pattern=lambda r: r.pattern) -> str:
    cats = list(dict.fromkeys(r.category for r in rules))
    return "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(hit("t", pattern(r)) for r in rules if r.category == c) + f" THEN '{c}' END" for c in cats) + f"], lambda x: x IS NOT NULL) AS {name}"


_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
# highest severity: per pack, since one category may have rules of several severities
_SEV = "[" + ", ".join(f"CASE WHEN {hit('t', PLAIN[r.no] if pack is PII else r.pattern)} THEN {_RANK[r.severity]} END" for pack in (PII,) for r in pack) + "]"
_DECIDE = f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, text, t, {_stage('pii', PII, lambda r: PLAIN[r.no])}, {_stage('inj', INJECTION)}, {_stage('fin', FINANCE)}, {_key(lambda r: r.category).replace('(text,', '(t,')} AS key,
  {_SAFE} OR {_LOW} = '' AS calm FROM a),
c AS (SELECT doc_id, pii, inj, fin, CASE WHEN len(pii) = 0 AND len(fin) = 0 AND NOT calm AND key IS NOT NULL THEN [key] ELSE [] END AS tox FROM b),
e AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_concat(pii, inj), list_concat(fin, tox)))) AS cats, CASE WHEN len(inj) > 0 THEN 'block' WHEN len(tox) > 0 THEN 'block' WHEN list_contains(fin, 'finance_insider_info') THEN 'block' WHEN len(fin) > 0 THEN 'allow_with_warning' WHEN len(pii) > 0 THEN 'redact' ELSE 'allow' END AS action FROM c)
"""


@query(_DECIDE + "SELECT action, count(*) AS documents FROM e GROUP BY 1")
def decision_action(spark, d):
    return analyze(_docs(spark, d)).groupBy("action").agg(F.count("*").alias("documents"))


@query(_DECIDE + "SELECT doc_id, action, array_to_string(cats, ',') AS categories, CAST(len(cats) > 0 AS INT) AS flagged FROM e")
def decision_rows(spark, d):
    out = analyze(_docs(spark, d))
    return out.select("doc_id", "action", F.array_join("categories_found", ",").alias("categories"), (F.size("detections") > 0).cast("int").alias("flagged"))


@query()
def decision_full(spark, d):
    return analyze(_docs(spark, d)).select("doc_id", "action", "max_severity", "max_confidence", F.size("detections").alias("n"), F.to_json("detections").alias("detections"), "redacted_text")


@query("SELECT doc_id, sha256(text) AS input_hash FROM documents WHERE text IS NOT NULL")
def input_hash(spark, d):
    return analyze(_docs(spark, d), Policy(detect_pii=False, detect_injection=False, detect_finance=False, detect_toxicity=False)).where("input_hash is not null").select("doc_id", "input_hash")


@query(f"SELECT CASE WHEN {hit('text', _EMAIL.pattern)} THEN 'redact' ELSE 'allow' END AS action, count(*) AS documents FROM documents GROUP BY 1")
def policy_pii_types(spark, d):
    return analyze(_docs(spark, d), Policy(pii_types=("pii_email",), detect_injection=False, detect_finance=False, detect_toxicity=False)).groupBy("action").agg(F.count("*").alias("documents"))


@query("SELECT CASE WHEN regexp_matches(text, '(?i)chirpora') THEN 'allow_with_warning' ELSE 'allow' END AS action, count(*) AS documents FROM documents GROUP BY 1")
def policy_custom_pattern(spark, d):
    p = Policy(custom_patterns=(("brand", "(?i)chirpora"),), detect_pii=False, detect_injection=False, detect_finance=False, detect_toxicity=False)
    return analyze(_docs(spark, d), p).groupBy("action").agg(F.count("*").alias("documents"))


def _sanitized_sql() -> str:
    x = r"regexp_replace(left(text, 10000), '[\x00\x1b\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g')"
    for p, rep in V.SANITIZE:
        x = f"regexp_replace({x}, {lit(sql_pattern(p) if p.startswith('(?i)') else p)}, {lit(rep)}, 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), ' {{4,}}', '   ', 'g')"


@query(f"SELECT doc_id, {_sanitized_sql()} AS sanitized FROM documents WHERE text IS NOT NULL")
def sanitize_text(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", D.sanitize(F.col("text"))["text"].alias("sanitized"))


@query("SELECT DISTINCT id, array_to_string(list_sort(list_distinct(list_filter([" + ", ".join([f"CASE WHEN {hit('text', p) if p.startswith('(?i)') else f'regexp_matches(text, {lit(p)})'} THEN {lit(rep)} END" for p, rep in V.SANITIZE] + [f"CASE WHEN contains(text, chr({ord(c)})) THEN 'char_{ord(c):04x}' END" for c in V.SANITIZE_CHARS if c != chr(0)]) + "], lambda x: x IS NOT NULL))), ',') AS flags FROM gold_v1 WHERE text IS NOT NULL")
def sanitize_flags(spark, d):
    return read(spark, d, "gold_v1", "id", "text").distinct().where("text is not null").select("id", F.array_join(D.sanitize_flags(F.col("text")), ",").alias("flags"))


@query(_DECIDE + "SELECT doc_id, action FROM e ORDER BY doc_id LIMIT 100")
def decision_batch(spark, d):
    return batch(_docs(spark, d), "doc_id").select("doc_id", "action")


@query("SELECT DISTINCT request_id, CASE WHEN len(string_split(client_ip, '.')) = 4 THEN split_part(client_ip, '.', 1) || '.' || split_part(client_ip, '.', 2) || '.*.*' WHEN length(client_ip) > 10 THEN left(client_ip, 10) || '...' ELSE client_ip END AS masked_ip FROM api_request")
def mask_client_ip(spark, d):
    return read(spark, d, "api_request", "request_id", "client_ip").select("request_id", D.mask_ip(F.col("client_ip")).alias("masked_ip")).distinct()


@query("SELECT DISTINCT request_id, coalesce(client_ip, '') || ':' || left(sha256(coalesce(tenant_id, '')), 16) AS client_id FROM api_request")
def client_id(spark, d):
    return read(spark, d, "api_request", "request_id", "client_ip", "tenant_id").select("request_id", F.concat(F.coalesce("client_ip", F.lit("")), F.lit(":"), F.substring(F.sha2(F.coalesce("tenant_id", F.lit("")), 256), 1, 16)).alias("client_id")).distinct()


@query(f"SELECT doc_id, CASE WHEN text IS NULL OR {_LOW} = '' THEN 'blank' WHEN length(text) > 50000 THEN 'too_long' END AS reject FROM documents WHERE text IS NULL OR {_LOW} = '' OR length(text) > 50000")
def input_rejects(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.when(t.isNull() | (D.strip(t) == ""), "blank").when(F.length(t) > 50_000, "too_long").alias("reject")).where("reject is not null")


@query("""WITH a AS (SELECT DISTINCT id, labels.category AS c, labels.severity AS s FROM gold_v1), b AS (SELECT id, c, coalesce(s, 0) / 4.0 AS p FROM a)
SELECT id, NOT (c = 'safe') AS toxic, CAST(CASE WHEN c = 'safe' THEN 0.9 ELSE round_even(0.9 * p, 4) END AS DOUBLE) AS confidence, CASE c WHEN 'hate_speech' THEN 'toxic_hate' WHEN 'sexual' THEN 'toxic_sexual' WHEN 'self_harm' THEN 'toxic_self_harm' ELSE 'toxic_harassment' END AS mapped FROM b WHERE c IS NOT NULL""")
def two_stage_compose(spark, d):
    g = read(spark, d, "gold_v1", "id", "labels").select("id", F.col("labels.category").alias("c"), F.col("labels.severity").alias("s")).distinct().where("c is not null")
    x = g.select("id", "c", S.two_stage(F.when(F.col("c") == "safe", "safe").otherwise("toxic"), F.lit(0.9), F.col("c"), F.coalesce("s", F.lit(0)) / 4.0).alias("r"))
    return x.select("id", "r.toxic", "r.confidence", S.label_map(F.col("c"), S.LABELS, ("toxic_harassment", "high"))[0].alias("mapped"))
