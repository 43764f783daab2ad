"""Problem 5: texts that look the same brought to one form (confusables skeleton)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fold import load_table, skeleton
from .util import checkpoint, opened


#: Forms of one skeleton that are paired with the others in one task.
FORMS = 1_000


@F.pandas_udf(T.StringType())
def skeleton_udf(text: pd.Series) -> pd.Series:
    return text.map(skeleton, na_action="ignore")


def skeleton_column(col: str) -> F.Column:
    """Texts of plain ASCII are their own skeleton; Python gets a null in their place."""
    c = F.col(col)
    return F.coalesce(skeleton_udf(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def with_skeleton(df: DataFrame, text: str = "text", to: str = "skeleton", table: str | None = None) -> DataFrame:
    """Adds the one form of ``text``. Null stays null, the empty text empty; other columns stay as they are.

    A column already named as ``to`` is replaced. ``table``: a confusables file (``fold.load_table``) whose entries are added.
    """
    if table is None:
        return df.withColumn(to, skeleton_column(text))
    sent = df.sparkSession.sparkContext.broadcast(load_table(table))  # a few thousand entries

    @F.pandas_udf(T.StringType())
    def own(t: pd.Series) -> pd.Series:
        return t.map(lambda x: skeleton(x, sent.value), na_action="ignore")

    return df.withColumn(to, own(F.col(text)))


def groups(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per skeleton with more than one stored form: skeleton, n_forms, n_records, first_key.

    Forms are counted before records meet, so a form with very many records is one row per task.
    """
    forms = df.select(key, text).where(F.col(text).isNotNull()).groupBy(text).agg(F.countDistinct(key).alias("n"), F.min(key).alias("k"))
    return forms.groupBy(skeleton_column(text).alias("skeleton")).agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_records"), F.min("k").alias("first_key")).where("n_forms > 1")


def pairs(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, of records whose stored texts differ but share a skeleton.

    Null texts match nothing. Only skeletons with two or more stored forms take part; the
    forms are paired first (as 128-bit hashes) and then opened to records, so records that
    share one stored text never meet each other. The pairs of a skeleton with many forms are
    made in blocks of FORMS, each by a task of its own.
    """
    # one row per record: a key that occurs in several rows counts once per stored form
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").distinct()
    digest = lambda c: F.unhex(F.md5(c))
    records = checkpoint(rows.select("k", digest(F.col("t").cast("binary")).alias("form"), digest(skeleton_column("t").cast("binary")).alias("s")))
    forms = records.select("form", "s").distinct()
    parts = F.ceil(F.col("n") / FORMS).cast("int")
    several = forms.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s", parts.alias("parts"))
    forms = forms.join(several, "s")
    a = forms.select("s", F.col("form").alias("fa"), F.pmod(F.xxhash64("form"), F.col("parts")).cast("int").alias("part"))
    b = forms.select("s", F.col("form").alias("fb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    form_pairs = a.join(b, ["s", "part"]).where("fa < fb").select("fa", "fb")
    members = records.join(several.select("s"), "s", "left_semi").select(F.col("form").alias("c"), "k")
    out = opened(opened(form_pairs, "fa", members, "k", "ka"), "fb", members, "k", "kb")
    return out.where("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
