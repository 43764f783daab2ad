"""SQL of the queries that SQL can express over the whole tables."""

from __future__ import annotations

_CANON = r"regexp_replace(lower({}), '[\s\p{{Z}}\p{{P}}\x0b\x1c-\x1f\x85]', '', 'g')"

_P6_ROWS = f"""
rows AS (
  SELECT 'self_harm_generated' AS table_name, record_id AS k, {_CANON.format('text')} AS c
  FROM (SELECT DISTINCT record_id, text FROM self_harm_generated) WHERE text IS NOT NULL
  UNION ALL
  SELECT 'hasoc_hindi_raw', row_id, {_CANON.format('text')}
  FROM (SELECT DISTINCT row_id, text FROM hasoc_hindi_raw) WHERE text IS NOT NULL
  UNION ALL
  SELECT 'raw_records', raw_id,
    {_CANON.format("coalesce(json_extract_string(body, '$.text'), '')")} || chr(31) || {_CANON.format("coalesce(json_extract_string(body, '$.label'), '')")} || chr(31) ||
    {_CANON.format("coalesce(json_extract_string(body, '$.category'), '')")} || chr(31) || {_CANON.format("coalesce(json_extract_string(body, '$.source'), '')")}
  FROM (SELECT DISTINCT raw_id, body FROM raw_records) WHERE json_valid(body)
), g AS (SELECT *, min(k) OVER (PARTITION BY table_name, c) AS key_a, count(*) OVER (PARTITION BY table_name, c) AS copies FROM rows)
"""

# a tag is a short one, or one of any length whose attributes all have values
_TAG = r"""</?[A-Za-z][^<>]{0,200}>|<[A-Za-z][A-Za-z0-9_:-]*(?:\s+[A-Za-z_:@][A-Za-z0-9_:.@-]*\s*=\s*(?:"[^"<]*"|''[^''<]*''|[^\s"''<>]+))+\s*/?>"""
_WORDS = r"string_split(trim(regexp_replace(regexp_replace(lower(regexp_replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '@TAG@', ' ', 'g')), '[''\"`´‘’‚‛“”„‟«»‹›′″\p{{Cf}}]', '', 'g'), '[\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\s]+', ' ', 'g')), ' ')".replace("@TAG@", _TAG.replace("{", "{{").replace("}", "}}"))

_P7 = f"""
WITH i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"WITH {_P6_ROWS} SELECT table_name, key_a, k AS key_b FROM g WHERE k <> key_a",
        "p6_counts": f"WITH {_P6_ROWS} SELECT table_name, key_a, copies FROM g WHERE k = key_a",
        "p7_found": _P7 + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
        "p7_items": _P7 + ", m AS (SELECT doc_id, item_id, count(*) AS n FROM dg JOIN ig USING (g) GROUP BY 1, 2) SELECT item_id, count(*) AS documents, max(n) AS most_windows FROM m GROUP BY 1",
        "p7_valid": _P7 + "SELECT count(DISTINCT doc_id) AS changed, 0 AS remaining FROM dg JOIN ig USING (g)",
        "p8_valid": "SELECT DISTINCT lower(trim(t.source)) AS source, true AS once, true AS own, true AS within_cap, true AS share_met FROM source_targets t JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source))",
        "p9_valid": "SELECT profile, true AS within_limit, true AS as_stored, true AS covers, true AS overlaps FROM split_limits",
    }
