"""Corpus curation: normalise, union, dedupe, relabel, categorise, balance, split, audit. All DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detect import strip, words
from ..rules import fixed_values as V


# ---- projections on labels -------------------------------------------------------------------------
def binary_label(label: Column) -> Column:
    """1 is toxic, anything else (null too) safe."""
    return F.when(label == 1, "toxic").otherwise("safe")


def score_label(*scores: Column, above: float = 0.5) -> Column:
    """toxic if the largest score is above the threshold; a missing score counts as 0."""
    s = [F.coalesce(x, F.lit(0.0)) for x in scores]
    return F.when((F.greatest(*s) if len(s) > 1 else s[0]) > above, "toxic").otherwise("safe")


def class_label(value: Column, toxic: Sequence) -> Column:
    return F.when(value.isin(*toxic), "toxic").otherwise("safe")


def normalize_label(label: Column) -> tuple[Column, Column]:
    """(label, category) of free label text, by the first part that it contains."""
    x = F.lower(label)
    safe = x.isin("safe", "not_hate", "normal")
    category = F.when(safe, "safe").when(x.contains("harassment"), "harassment").when(x.contains("hate"), "hate_speech").when(x.contains("threat") | x.contains("violence"), "violence").when(x.contains("sexual"), "sexual").otherwise("harassment")
    return F.when(safe, "safe").otherwise("toxic"), category


def any_of(text: Column, parts: Sequence[str]) -> Column:
    """Whether the text contains one of the parts, as they are."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def first_of(text: Column, parts: Sequence[str]) -> Column:
    """The first part, in the list's order, that the text contains; null if none."""
    return F.coalesce(*[F.when(text.contains(p), F.lit(p)) for p in parts])


def relabel_first(text: Column, label: Column) -> Column:
    """First pass: a safe text that holds an indicator is toxic."""
    return F.when((label == "safe") & any_of(F.lower(text), V.TOXIC_INDICATORS), "toxic").otherwise(label)


def relabel_second(text: Column, label: Column) -> Column:
    """Second pass: strong_toxic, directed_toxic or null, the reason to make a safe label toxic."""
    low = F.lower(text)
    directed = any_of(low, V.CONTEXT_TOXIC) & any_of(low, V.BAD_CONTEXT) & any_of(low, V.DIRECTED)
    return F.when(label == "safe", F.when(any_of(low, V.STRONG_TOXIC), "strong_toxic").when(directed, "directed_toxic"))


def relabel_third(text: Column, label: Column) -> Column:
    """Third pass: the reason, null if none; texts that discuss such wording are exempt from the second kind."""
    low = F.lower(text)
    always = [F.when(low.contains(w), F.lit(f"contains '{w}'")) for w in V.ALWAYS_TOXIC]
    context = [F.when(low.contains(w) & any_of(low, c) & ~any_of(low, V.DISCUSSION), F.lit(f"'{w}' with violent context")) for w, c in V.CONTEXT_DEPENDENT.items()]
    return F.when(label == "safe", F.coalesce(*always, *context))


def category_scores(text: Column) -> dict[str, Column]:
    return {c: reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in ps]) for c, ps in V.CATEGORY_PATTERNS.items()}


def categorize(text: Column, label: Column) -> Column:
    """The category with the most matching patterns, the first of equals; harassment if none matches; safe stays safe."""
    scores = category_scores(text)
    top = F.greatest(*scores.values())
    pick = F.coalesce(*[F.when(s == top, F.lit(c)) for c, s in scores.items()])
    return F.when(label == "safe", "safe").when(top > 0, pick).otherwise("harassment")


def merge_category(category: Column) -> Column:
    return F.when(category.isin("violence", "dangerous"), "harmful_content").otherwise(category)


def script(text: Column) -> Column:
    deva, latin = text.rlike("[\\u0900-\\u097F]"), text.rlike("[A-Za-z]")
    return F.when(deva & latin, "mixed").when(deva, "devanagari").otherwise("english")


def has_hindi(text: Column, listed: Sequence[str] = tuple(V.HINGLISH)) -> Column:
    """Devanagari, or at least two listed words as parts of the text."""
    low = F.lower(text)
    count = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in listed])
    return text.rlike("[\\u0900-\\u097F]") | (count >= 2)


def toxic_flag(text: Column) -> Column:
    return any_of(F.lower(text), V.TOXIC_WORDS)


def pattern_from_text(text: Column) -> tuple[Column, Column]:
    """(regex, name) learnt from a text: all of it if 3 to 50 characters, else its first four words."""
    low = strip(F.lower(text))
    short = F.array_join(F.slice(words(low), 1, 4), " ")
    body = F.when(F.length(low).between(3, 50), low).otherwise(short)
    escaped = F.regexp_replace(body, r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\$1")
    regex = F.concat(F.lit(r"(?i)\b"), F.regexp_replace(escaped, " +", r"\\s+"), F.lit(r"\b"))
    return regex, F.concat(F.lit("learned_"), F.substring(F.regexp_replace(body, "[^a-z0-9]+", "_"), 1, 20))


#: Most templates of ``generate``.
MOST_TEMPLATES = 10_000


# ---- sets ------------------------------------------------------------------------------------------
def union_sources(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """UNION ALL with a source tag; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("dataset", F.lit(n)) for n, df in sources])


def dedupe(df: DataFrame, key: Column, order: Sequence, within: Sequence[str] = (), drop_empty: bool = True) -> DataFrame:
    """Keeps the first row by ``order`` of each key. Null keys are dropped, as are empty ones unless told otherwise.

    The key's 64-bit hash is what the shuffle sorts by first; equal texts therefore share a
    partition without long keys in the sort.
    """
    src = df.withColumn("_key", key).where(F.col("_key").isNotNull() & ((F.col("_key") != "") if drop_empty else F.lit(True)))
    w = Window.partitionBy(*within, F.xxhash64("_key"), "_key").orderBy(*order)
    return src.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_key", "_rn")


def normalized_key(text: Column, most: int | None = None) -> Column:
    x = strip(text)
    return F.lower(F.substring(x, 1, most) if most else x)


def anti_existing(df: DataFrame, existing: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text does not stand in ``existing``; null texts stay."""
    known = existing.select(F.col(text).alias("_t")).where("_t is not null").distinct()
    return df.join(known, df[text] == known["_t"], "left_anti")


def generate(templates: DataFrame, terms: DataFrame) -> DataFrame:
    """Every template with every term in its place. Templates are written by hand and go to all tasks; terms may be many."""
    few = templates.limit(MOST_TEMPLATES + 1).select(F.col("template"))
    if few.count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return terms.crossJoin(F.broadcast(few)).select("template", "term", F.replace("template", F.lit("{}"), F.col("term")).alias("text"))


# ---- balance, split, sample ------------------------------------------------------------------------
def hash_key(key: Column) -> Column:
    """A reproducible shuffle of integer keys that SQL engines share."""
    return F.pmod(key * F.lit(2654435761), F.lit(4294967296))


BUCKETS = 4096


def positions(df: DataFrame, bucket: Column, order: Sequence, within: Sequence[str] = ()) -> DataFrame:
    """Adds _pos (from 0) and _all (rows of the group): the position of each row of its group by bucket, then order.

    No task sorts a whole group: positions come from counts per bucket, added up, plus the rank inside the bucket.
    """
    src = df.withColumn("_b", bucket)
    per = src.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    total = Window.partitionBy(*within)
    per = per.withColumn("_before", F.sum("_n").over(total.orderBy("_b")) - F.col("_n")).withColumn("_all", F.sum("_n").over(total)).drop("_n")
    on = [src[c].eqNullSafe(per[c]) for c in within] + [src["_b"].eqNullSafe(per["_b"])]
    joined = src.join(per, reduce(lambda a, b: a & b, on)).select(src["*"], "_before", "_all")
    rank = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(*order))
    return joined.withColumn("_pos", F.col("_before") + rank - 1).drop("_b", "_before")


def undersample(df: DataFrame, label: str, ratio: float, key: str) -> DataFrame:
    """All toxic rows and at most ratio x as many safe ones, by hashed key. Null labels count as toxic no more than as safe: they are left out.

    The number of safe rows is a column of one row, not a limit in the plan; which rows are the first comes from counts per
    bucket of the hash.
    """
    toxic, safe = df.where(F.col(label) != "safe"), df.where(F.col(label) == "safe")
    wanted = toxic.agg(F.floor(F.count("*") * ratio).alias("_wanted"))
    h = hash_key(F.col(key))
    first = positions(safe, F.floor(h / (4294967296 // BUCKETS)).cast("int"), [h, key])
    return toxic.unionByName(first.join(F.broadcast(wanted), F.col("_pos") < F.col("_wanted")).select(df.columns))


def split_positions(df: DataFrame, key: str, within: Sequence[str] = (), cuts: Sequence[tuple[str, float]] = (("train", 0.8), ("val", 0.9), ("test", 1.0)), buckets: int = BUCKETS) -> DataFrame:
    """Adds split, by position in hashed order: exact shares per group."""
    h = hash_key(F.col(key))
    at = positions(df, F.floor(h / (4294967296 // buckets)).cast("int"), [h, key], within)
    split = F.lit(cuts[-1][0])
    for name, cut in reversed(cuts[:-1]):
        split = F.when(F.col("_pos") < F.floor(F.col("_all") * F.lit(cut)), name).otherwise(split)
    return at.withColumn("split", split).drop("_pos", "_all")


def shuffled(df: DataFrame, key: str) -> DataFrame:
    """A reproducible shuffle: ordered by hashed key, in ranges over all tasks."""
    return df.orderBy(hash_key(F.col(key)), key)


def annotator_label(label: Column, category: Column) -> Column:
    """One label of an annotator's row: its kind of toxicity by category, safe, or harassment by default."""
    return F.when(category == "hate_speech", "toxic_hate_speech").when(category == "harassment", "toxic_harassment").when(label == "safe", "safe").otherwise("toxic_harassment")


def review_sample(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """k rows of each group, by hashed key (a sampling operator: k is its feature)."""
    w = Window.partitionBy(group).orderBy(hash_key(F.col(key)), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


# ---- audits ----------------------------------------------------------------------------------------
def counts(df: DataFrame, *by: str) -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("pct_floor", F.floor(F.col("n") * 100 / F.sum("n").over(Window.partitionBy())))


def upper_median(df: DataFrame, by: str, value: Column) -> DataFrame:
    """The element at n div 2 of the sorted values: exact, from value counts instead of a collected list."""
    per = df.groupBy(by, value.alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    per = per.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    return per.where(F.col("upto") > F.expr("n div 2")).groupBy(by).agg(F.min("v").alias("median"))


def length_stats(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    n = F.length(text)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.floor(F.sum(n) / F.count(n)).alias("avg_len"), F.round(F.stddev_pop(n), 6).alias("std_len"), F.count_if(n < 20).alias("short"), F.count_if(n > 500).alias("long"))


def duplicates(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """rows, distinct normalised texts and repeats per group; distinct by 128-bit digest, so that no text is shuffled."""
    k = F.md5(normalized_key(F.col(text)).cast("binary"))
    return df.groupBy(by).agg(F.count(text).alias("n"), F.countDistinct(k).alias("unique_texts")).withColumn("duplicates", F.col("n") - F.col("unique_texts"))


def top_k(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    n = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contamination(df: DataFrame, category: str, text: str = "text") -> DataFrame:
    """Normalised texts that stand in more than one category: the key's digest, number of categories, rows."""
    k = F.md5(normalized_key(F.col(text)).cast("binary")).alias("text_key")
    return df.where(F.col(text).isNotNull()).groupBy(k).agg(F.countDistinct(category).alias("categories"), F.count("*").alias("n")).where("categories > 1")


def readiness(df: DataFrame, category: str, text: str = "text", source: str = "source") -> DataFrame:
    """Score of 0 to 100 and grade per category: size, repeats, spread of lengths, sources, 25 points each."""
    d = duplicates(df, category, text)
    s = df.groupBy(category).agg(F.stddev_pop(F.length(text)).alias("sd"), F.countDistinct(source).alias("sources"))
    x = d.join(s, category)
    pct = F.col("duplicates") * 100 / F.col("n")
    score = F.when(F.col("n") >= 1000, 25).when(F.col("n") >= 500, 15).otherwise(5) + F.when(pct < 5, 25).when(pct < 15, 15).otherwise(5) + F.when(F.col("sd") > 50, 25).when(F.col("sd") > 20, 15).otherwise(5) + F.when(F.col("sources") >= 3, 25).when(F.col("sources") == 2, 15).otherwise(5)
    return x.select(category, score.alias("score"), F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").otherwise("D").alias("grade"))


def majority(df: DataFrame, item: str, vote: str, order: str) -> DataFrame:
    """Most frequent vote per item, equal counts by the earliest; agreement is its share."""
    v = df.where(F.col(vote).isNotNull()).groupBy(item, vote).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    w = Window.partitionBy(item)
    return v.withColumn("rn", F.row_number().over(w.orderBy(F.desc("c"), "first", vote))).withColumn("votes", F.sum("c").over(w)).where("rn = 1").select(item, F.col(vote).alias("winner"), "votes", (F.col("c") / F.col("votes")).alias("agreement"))
