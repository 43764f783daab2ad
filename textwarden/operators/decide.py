"""Text and policy to decision, as one chain of projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions.spread import spread

TOXIC_ACTIONABLE = ("toxic_hate", "toxic_violence", "toxic_self_harm", "toxic_harassment", "toxic_sexual")


@dataclass(frozen=True)
class Policy:
    """Toggles, thresholds and actions; defaults as documented in the README."""

    detect_pii: bool = True
    detect_injection: bool = True
    detect_finance: bool = True
    detect_toxicity: bool = True
    pii_types: tuple[str, ...] = ()
    pii_threshold: float = 0.8
    injection_threshold: float = 0.8
    pii_action: str = "redact"
    injection_action: str = "block"
    finance_action: str = "allow_with_warning"
    toxic_action: str = "block"
    replacement: str = "[REDACTED]"
    custom_patterns: tuple[tuple[str, str], ...] = ()
    compat: str = "fixed"


#: Column of texts (null: nothing to do) to struct<found: detections, unsure: boolean, error: string>.
Scorer = Callable[[Column], Column]
#: DataFrame with a boolean column ``ask`` to the same with ``judged``: struct<found: detections, status: string>.
Judge = Callable[[DataFrame], DataFrame]


def once(c: Column) -> Column:
    """The same values as an expression that the optimizer neither copies into a filter above it nor into a second use: a pack runs once per row."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def detections(text: str, policy: Policy, low: str) -> dict[str, Column]:
    """A stage whose constant confidence lies below its threshold, or that is switched off, is not in the plan at all."""
    found = D.empty()
    if policy.detect_pii and policy.pii_threshold <= 0.95:
        found = D.pii_all(text, policy.pii_types or None, low=low)
    inj = D.injection(text, low) if policy.detect_injection and policy.injection_threshold <= 0.95 else D.empty()
    fin = D.finance(text, low) if policy.detect_finance else D.empty()
    return {"pii_all": found, "inj": inj, "fin": fin}


def action(found: Column, policy: Policy) -> Column:
    has = lambda f: F.exists(found, f)
    return (
        F.when(has(lambda d: d["category"].isin("prompt_injection", "jailbreak_attempt")), policy.injection_action)
        .when(has(lambda d: d["category"].isin(*TOXIC_ACTIONABLE)), policy.toxic_action)
        .when(has(lambda d: d["category"] == "finance_insider_info"), "block")
        .when(has(lambda d: d["category"].startswith("finance_")), policy.finance_action)
        .when(has(lambda d: d["category"].startswith("pii_")), policy.pii_action)
        .when(F.size(found) > 0, "allow_with_warning")
        .otherwise("allow")
    )


def analyze(df: DataFrame, policy: Policy = Policy(), text: str = "text", scorer: Scorer | None = None, judge: Judge | None = None, learned: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Adds detections, action, categories_found, max_severity, max_confidence, redacted_text, input_hash, toxicity_source, score_error.

    A null text gets no detections and the action ``allow``; its hash and redacted text are null.

    Toxicity in turn, each step only where the one before found nothing: keyword rules, then the
    ``scorer`` on what no rule settles (the other rows are null to its Python stage), then the ``judge`` on
    what the scorer is unsure of, which it confirms or clears, and on what the escalation rules (and ``learned``
    ones: name, pattern) call suspicious. ``toxicity_source`` is keyword, model, judge or none;
    ``score_error`` says why a model gave no answer, so that such a row does not pass for a safe one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    parts = detections("_t", policy, "_low")
    out = spread(df).withColumn("_t", t).withColumn("_low", D.low_text(F.col("_t"))).select("*", *[once(c).alias(f"_{n}") for n, c in parts.items()])
    t = F.col("_t")
    first = D.keep_first(F.col("_pii_all"), lambda x, y: (x["category"] == y["category"]) & (x["matched_text"] == y["matched_text"]))
    out = out.withColumn("_pii", first)
    gate = (F.size("_pii") == 0) & (F.size("_fin") == 0)
    blank = (D.strip(t) == "") | D.gibberish(t) | D.safe_phrase(t)
    models = policy.detect_toxicity and (scorer is not None or judge is not None)
    if models:
        out = out.withColumn("_gate", once(gate)).withColumn("_rest", once(F.col("_gate") & ~blank))
        tox = F.when(F.col("_rest"), D.keyword("_t", "_low")).otherwise(D.empty())
    else:
        tox = F.when(gate & ~blank, D.keyword("_t", "_low")).otherwise(D.empty()) if policy.detect_toxicity else D.empty()
    out = out.withColumn("_tox", once(tox))
    source, error = F.when(F.size("_tox") > 0, "keyword"), F.lit(None).cast("string")
    if models:
        none = F.struct(D.empty().alias("found"), F.lit(False).alias("unsure"), F.lit(None).cast("string").alias("error"))
        out = out.withColumn("_scored", scorer(F.when(F.col("_rest") & (F.size("_tox") == 0), t)) if scorer is not None else none)
        sure = F.coalesce(F.col("_scored.found"), D.empty())
        source, error = source.when(F.size(sure) > 0, "model"), F.col("_scored.error")
        found = F.concat("_tox", sure)
        if judge is not None:
            unsure = F.coalesce(F.col("_scored.unsure"), F.lit(False))
            suspicious = F.when(F.col("_gate") & (F.size(found) == 0), D.escalation("_t", learned, "_low")["escalate"]).otherwise(F.lit(False))
            out = judge(out.withColumn("_found", found).withColumn("ask", unsure | once(suspicious)))
            said = F.coalesce(F.col("judged.found"), D.empty())
            found, source = F.concat("_found", said), source.when(F.size(said) > 0, "judge")
        out = out.withColumn("_all_tox", found)
    custom = [F.when(t.rlike(p), F.array(F.struct(F.lit("custom").alias("category"), F.lit("medium").alias("severity"), F.lit(0.95).alias("confidence"), F.regexp_extract(t, p, 0).alias("matched_text"), F.length(F.get(F.split(t, p, 2), F.lit(0))).alias("start_pos"), (F.length(F.get(F.split(t, p, 2), F.lit(0))) + F.length(F.regexp_extract(t, p, 0))).alias("end_pos"), F.lit(n).alias("explanation"), F.lit("custom").alias("detector")).cast(D.DETECTION[6:-1]))).otherwise(D.empty()) for n, p in policy.custom_patterns if policy.compat == "fixed"]
    out = out.withColumn("detections", F.concat("_pii", "_inj", "_fin", "_all_tox" if models else "_tox", *custom)).withColumn("action", action(F.col("detections"), policy))
    spans = F.col("_pii_all") if policy.compat == "fixed" else F.col("_pii")
    severity = F.array_max(F.transform("detections", lambda d: D.rank(d["severity"])))
    names = F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")])
    return out.select(
        *df.columns, "detections", "action",
        F.array_sort(F.array_distinct(F.transform("detections", lambda d: d["category"]))).alias("categories_found"),
        F.get(names, severity).alias("max_severity"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("max_confidence"),
        F.when((F.col("action") == "redact") & (F.size("_pii") > 0), D.redact(t, spans, policy.replacement, policy.compat)).alias("redacted_text"),
        F.sha2(F.col(text).cast("binary"), 256).alias("input_hash"),
        source.otherwise("none").alias("toxicity_source"),
        error.alias("score_error"),
    )


def exploded(decided: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per detection."""
    return decided.select(*key, F.posexplode("detections").alias("ordinal", "d")).select(*key, "ordinal", "d.*")


def batch(df: DataFrame, key: str, text: str = "text", most: int = 100, policy: Policy = Policy()) -> DataFrame:
    """The first ``most`` non-blank texts by key, decided: position (from 0, the order of the answers), key, action, detections_count."""
    rows = df.where(F.col(text).isNotNull() & (D.strip(F.col(text)) != "")).orderBy(key).limit(most)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(key)) - 1)  # at most ``most`` rows
    return analyze(rows, policy, text).select("position", key, "action", F.size("detections").alias("detections_count"))


def decisions_from_json(value: Column) -> Column:
    """A decision as written by ``to_json``; text that is no such object gives null fields."""
    return F.from_json(value, f"action string, request_id string, timestamp timestamp, processing_time_ms double, input_hash string, categories_found array<string>, max_severity string, max_confidence double, redacted_text string, detections {D.DETECTION}")


POLICY = {"detect_pii": "boolean", "detect_prompt_injection": "boolean", "detect_finance_intent": "boolean", "detect_toxicity": "boolean", "pii_types": "array<string>", "pii_confidence_threshold": "double", "prompt_injection_threshold": "double", "redact_replacement": "string"}


def policy_from_json(text: str) -> Policy:
    """A policy from its JSON object; missing and null fields keep their defaults, unknown ones are ignored."""
    import json

    given = {k: v for k, v in json.loads(text).items() if k in POLICY and v is not None}
    names = {"detect_prompt_injection": "detect_injection", "detect_finance_intent": "detect_finance", "pii_confidence_threshold": "pii_threshold", "prompt_injection_threshold": "injection_threshold", "redact_replacement": "replacement"}
    return Policy(**{names.get(k, k): tuple(v) if k == "pii_types" else v for k, v in given.items()})
