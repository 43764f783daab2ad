"""Sinks: JSON lines, one folder per category or split, append without repeats, upserts, exposition text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .readers import exists


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def by_category(df: DataFrame, path: str, column: str = "category") -> None:
    """One folder per category; rows of one category may come from many tasks."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def named_jsonl(df: DataFrame, path: str, column: str = "category") -> None:
    """One file per value of ``column``, named after it: for the small sets that tools read by file name. Values are written one after
    the other by their own jobs; more than 1,000 of them are refused."""
    spark = df.sparkSession
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(1_001).collect()]
    if len(values) > 1_000:
        raise ValueError("more than 1,000 values")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for v in sorted(map(str, values)):
        part = f"{path}/_{v}"
        df.where(F.col(column).cast("string") == v).drop(column).coalesce(1).write.mode("overwrite").json(part)
        fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        (found,) = [x.getPath() for x in fs.globStatus(fs_path(part + "/part-*"))]
        fs.delete(fs_path(f"{path}/{v}.jsonl"), False)
        fs.rename(found, fs_path(f"{path}/{v}.jsonl"))
        fs.delete(fs_path(part), True)


def by_split(df: DataFrame, path: str, column: str = "split") -> None:
    """One folder per split below ``splits``, and all rows below ``all``."""
    df.write.mode("overwrite").partitionBy(column).json(path + "/splits")
    df.write.mode("overwrite").json(path + "/all")


def json_document(rules: DataFrame, path: str, now: str) -> None:
    """One JSON document {patterns: [...], metadata: {created, last_updated, total_patterns}} with its counts refreshed.

    Learned rules are reviewed by hand, so they are few: more than 100,000 are refused.
    """
    n = rules.limit(100_001).count()
    if n > 100_000:
        raise ValueError("more than 100,000 rules")
    fields = ("pattern", "name", "category", "source_feedback", "added_at")
    one = F.struct(*[(F.col(c) if c in rules.columns else F.lit(None)).cast("string").alias(c) for c in fields])
    doc = rules.agg(F.array_sort(F.collect_list(one)).alias("patterns"), F.count("*").cast("int").alias("n"))
    doc.select("patterns", F.struct(F.lit(now).alias("created"), F.lit(now).alias("last_updated"), F.col("n").alias("total_patterns")).alias("metadata")).coalesce(1).write.mode("overwrite").json(path)


def router(df: DataFrame) -> DataFrame:
    """text and its category as label."""
    return df.select("text", F.col("category").alias("label"))


def append_new(df: DataFrame, path: str, key: str = "text") -> None:
    """Appends the rows whose key is not there yet, each key once."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    if exists(spark, path):
        old = spark.read.schema(df.schema).json(path).select(key).distinct()
        new = new.join(old, key, "left_anti")
    new.write.mode("append").json(path)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version of each key, a change before the current row of the same time."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def live(df: DataFrame, stored: str, now, seconds: int = 3600) -> DataFrame:
    """Rows whose time to live has not passed."""
    return df.where(F.unix_timestamp(now) - F.unix_timestamp(F.col(stored)) <= seconds)


def audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("event_type").json(path)


def exposition(df: DataFrame, metric: str, value: str, *labels: str) -> DataFrame:
    """One line of metrics text per row."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(metric + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
