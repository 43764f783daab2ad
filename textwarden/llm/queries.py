"""The pN_ queries over the whole tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import abuse, formatting, language, leak, lookalike, mixture, overlap, pieces, pii
from .util import by_key, checkpoint, table


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: whole-row repeats meet by key before anything costly."""
    return by_key(table(spark, d, "gold_v1", "id", "text"), "id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.spans(_gold(spark, d)).select("id", "pii_type").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_gold(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    gold = by_key(table(spark, d, "gold_v1", "id", "text", "labels"), "id")
    return abuse.score(gold, abuse.fit(gold))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("id").distinct()


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "gold_v1", "id", "metadata").dropDuplicates(["id"]).select("id", F.col("metadata.source").alias("source"))
    return abuse.rates(_scored(spark, d).join(source, "id"))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "self_harm_generated", "record_id", "text", "split"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("train_key", "eval_key").alias("record_id_a"), F.greatest("train_key", "eval_key").alias("record_id_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_overlaps(spark, d), table(spark, d, "self_harm_generated", "record_id", "split", "source"))


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, language.PPM]:
    gold = by_key(table(spark, d, "gold_v1", "id", "text", "lang"), "id")
    return gold, language.fit(gold)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong(language.identify(*_languages(spark, d)))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(*_languages(spark, d))


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments_of(*_languages(spark, d))


P5_TABLES = (("gold_v1", "id"), ("hasoc_hindi_raw", "row_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [lookalike.pairs(table(spark, d, t, k, "text"), k).select(F.lit(t).alias("table_name"), "key_a", "key_b") for t, k in P5_TABLES])


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [lookalike.groups(table(spark, d, t, k, "text"), k).withColumn("table_name", F.lit(t)) for t, k in P5_TABLES])


P6_TABLES = (("self_harm_generated", "record_id", "text"), ("hasoc_hindi_raw", "row_id", "text"), ("raw_records", "raw_id", "body"))


def _members(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    out = []
    for t, k, c in P6_TABLES:
        canon = formatting.canonical_json_udf if c == "body" else formatting.canonical_udf
        rows = table(spark, d, t, k, c).dropDuplicates([k]).select(k, canon(F.col(c)).alias("canon"))
        out.append((t, formatting.members(rows, k, "canon")))
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [m.where("k <> key_a").select(F.lit(t).alias("table_name"), "key_a", F.col("k").alias("key_b")) for t, m in _members(spark, d)])


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [formatting.groups(m).withColumn("table_name", F.lit(t)) for t, m in _members(spark, d)])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.find(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leak.find(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("n_windows").alias("most_windows"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leak.clean(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents", "doc_id", "text", "source", "lang"), table(spark, d, "source_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "source_targets")
    return mixture.shares(p8_mixture(spark, d), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "split_limits"), texts=False, only_long=True).where("n_pieces > 1").select("profile", "doc_id").distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "split_limits"), only_long=True)


# What must hold of results that SQL cannot make: the SQL twins count what is to be true of the stored tables.
def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """Documents that cleaning changed, and the passages that are left in them."""
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")
    after = leak.clean(docs, items)
    changed = after.withColumnRenamed("text", "now").join(docs, "doc_id").where("not now <=> text").agg(F.count("*").alias("changed"))
    return changed.crossJoin(leak.find(after, items).agg(F.count("*").alias("remaining")))  # one row each


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per wanted source: no document twice or of another source, no document repeated too often, the share met up to two documents."""
    targets = table(spark, d, "source_targets").select(mixture.canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    mixed = checkpoint(p8_mixture(spark, d))
    own = table(spark, d, "documents", "doc_id", "source").select("doc_id", mixture.canonical_source(F.col("source")).alias("own"))
    size = mixed.agg(F.sum(F.col("tokens") * F.col("repeats")).alias("all"), F.max("tokens").alias("largest"))
    got = mixed.join(own, "doc_id").groupBy("source").agg((F.count("*") == F.countDistinct("doc_id")).alias("once"), F.min(F.col("own") == F.col("source")).alias("own"), F.max("repeats").alias("most"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    x = targets.join(got, "source").crossJoin(size)  # one row
    return x.select("source", "once", "own", (F.col("most") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("tokens") - F.col("target_share") * F.col("all")) <= 2 * F.col("largest")).alias("share_met"))


def p9_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: pieces are within the limit, are the stored text at their place, cover all of it, and overlap as wanted up to a few tokens."""
    docs = table(spark, d, "documents", "doc_id", "text").withColumnRenamed("text", "whole")
    limits = table(spark, d, "split_limits")
    w = Window.partitionBy("profile", "doc_id").orderBy("piece")
    x = p9_pieces(spark, d).withColumn("before", F.lag("end").over(w)).join(docs, "doc_id").join(limits, "profile")
    shared = pieces.size_column(F.substring("whole", F.col("start") + 1, F.col("before") - F.col("start")))
    good = lambda c: F.min(c)
    return x.groupBy("profile").agg(
        good(F.col("tokens") <= F.col("max_tokens")).alias("within_limit"),
        good(F.col("text") == F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start"))).alias("as_stored"),
        good(F.when(F.col("piece") == 0, F.col("start") == 0).otherwise(F.col("start") < F.col("before")) & ((F.col("piece") < F.col("n_pieces") - 1) | (F.col("end") == F.length("whole")))).alias("covers"),
        good((F.col("piece") == 0) | shared.between(F.col("overlap_tokens") - 2, F.col("overlap_tokens") + 8)).alias("overlaps"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_redacted, p2_found, p2_scores, p2_rates, p3_found, p3_report, p4_found, p4_languages, p4_segments, p5_found, p5_groups, p6_found, p6_counts, p7_found, p7_items, p7_cleaned, p7_valid, p8_mixture, p8_shares, p8_valid, p9_found, p9_pieces, p9_valid)
    return {f.__name__: f for f in fs}
