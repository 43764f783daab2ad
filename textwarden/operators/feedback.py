"""Feedback joined to requests, reviewed, and turned into rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .curate import pattern_from_text


def with_request(feedback: DataFrame, requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """Feedback with its request, if one was made at most ``seconds`` before: each feedback once, with the latest such request.

    The side that is looked up is reduced to one row per request first.
    """
    r = requests.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.max_by(F.struct("tenant_id", "action", "input_hash", "confidence", "event_ts"), "event_ts").alias("r"))
    gap = F.unix_timestamp(F.col("feedback_ts").cast("timestamp")) - F.unix_timestamp(F.col("r.event_ts").cast("timestamp"))
    return feedback.join(r, "request_id").where(gap.between(0, seconds)).select(feedback["*"], F.coalesce(feedback["tenant_id"], F.col("r.tenant_id")).alias("tenant"), F.col("r.action").alias("request_action"), F.col("r.event_ts").alias("request_ts"))


def kind(c):
    """The kind of feedback in one spelling: lower case, underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), "[ -]+", "_")


def stats(feedback: DataFrame) -> DataFrame:
    """total, by_type (map), reviewed, pending, in one aggregation by type and one over its few rows."""
    t = feedback.groupBy(F.coalesce(kind(F.col("feedback_type")), F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("reviewed", F.lit(False))).alias("r"))
    return t.agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("by_type"), F.sum("r").alias("reviewed"), (F.sum("n") - F.sum("r")).alias("pending"))


def for_training(feedback: DataFrame, strict: bool = True) -> DataFrame:
    """Approved (strict) or reviewed rows that no training has used yet."""
    flag = "approved" if strict else "reviewed"
    return feedback.where(F.coalesce(flag, F.lit(False)) & ~F.coalesce("included_in_training", F.lit(False)))


def review(feedback: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: feedback_id, approve, reviewer, at. The latest decision of each feedback holds and makes it trainable again."""
    w = Window.partitionBy("feedback_id").orderBy(F.desc("at"), "reviewer")
    d = decisions.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.col("feedback_id").alias("_id"), "approve", "reviewer", "at")
    j = feedback.join(d, feedback["feedback_id"] == d["_id"], "left")
    hit = F.col("_id").isNotNull()
    new = {"reviewed": F.when(hit, True).otherwise(F.col("reviewed")), "approved": F.when(hit, F.col("approve")).otherwise(F.col("approved")), "reviewed_by": F.when(hit, F.col("reviewer")).otherwise(F.col("reviewed_by")), "reviewed_at": F.when(hit, F.col("at")).otherwise(F.col("reviewed_at")), "included_in_training": F.when(hit, False).otherwise(F.col("included_in_training"))}
    return j.withColumns(new).select(feedback.columns)


def learned(feedback: DataFrame, existing: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """pattern, name, category, source_feedback: new rules from missed texts (false_negative with a comment), each pattern once."""
    src = for_training(feedback, strict).where((kind(F.col("feedback_type")) == "false_negative") & (F.trim("comment") != ""))
    regex, name = pattern_from_text(F.col("comment"))
    rows = src.groupBy(regex.alias("pattern"), name.alias("name")).agg(F.min("feedback_id").alias("source_feedback"), F.min_by("corrected_category", "feedback_id").alias("category"))
    return rows.join(existing.select("pattern").distinct(), "pattern", "left_anti") if existing is not None else rows


def training_counts(feedback: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """processed, with_pattern, skipped of one training run."""
    src = for_training(feedback)
    usable = (kind(F.col("feedback_type")) == "false_negative") & (F.trim(F.coalesce("comment", F.lit(""))) != "")
    return src.agg(F.count("*").alias("processed"), F.count_if(usable).alias("with_pattern"), F.count_if(~F.coalesce(usable, F.lit(False))).alias("skipped"))


def mark_trained(feedback: DataFrame, ids: DataFrame, at) -> DataFrame:
    d = ids.select(F.col("feedback_id").alias("_id")).distinct()
    j = feedback.join(d, feedback["feedback_id"] == d["_id"], "left")
    hit = F.col("_id").isNotNull()
    return j.withColumn("included_in_training", hit | F.coalesce("included_in_training", F.lit(False))).withColumn("trained_at", F.when(hit, at).otherwise(F.col("trained_at"))).select(feedback.columns)


def listed(feedback: DataFrame, tenant: str | None = None, pending: bool | None = None, most: int = 1000) -> DataFrame:
    """The newest feedback, of one tenant if given, and only what is (not) reviewed if ``pending`` says so. A list of ``most`` rows is the feature."""
    rows = feedback if tenant is None else feedback.where(F.col("tenant_id") == tenant)
    done = F.coalesce("reviewed", F.lit(False))
    rows = rows if pending is None else rows.where(~done if pending else done)
    return rows.orderBy(F.desc("feedback_ts"), "feedback_id").limit(most)


def request_cache(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """What is kept of each decision for later feedback: its latest row, projected."""
    newest = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct("input_hash", "input_length", F.col("action").alias("decision"), "categories", "confidence", "tenant_id", "event_ts"), F.struct("event_ts", "input_hash")).alias("x"))
    return newest.select(key, "x.*")


#: A request id: a UUID.
REQUEST_ID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def valid(feedback: DataFrame, most: int = 1000, request_id: str = REQUEST_ID) -> DataFrame:
    """Adds reject: the first reason why a feedback is not accepted, null if none."""
    return feedback.withColumn("reject", F.when(~F.coalesce(F.col("request_id").rlike(request_id), F.lit(False)), "request_id").when(~F.coalesce(kind(F.col("feedback_type")).isin("correct", "false_positive", "false_negative", "category_correction"), F.lit(False)), "feedback_type").when(F.length("comment") > most, "comment"))
