"""What the operators of this folder share."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spread import spread  # noqa: F401
from ..sources.storage import shared_folder, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table, with only the columns that are needed; they reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder in ``spark.checkpoint.dir`` and cuts its lineage.

    Only where that setting is empty (tests on one machine) a local folder stands in.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def by_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key. Repeats meet within their own task before the shuffle, so a key that has a third of all rows is one row per task;
    the shuffle spreads the rows over all cores for the Python stages that follow."""
    return df.dropDuplicates([key])


#: Members of one class that one task opens for a pair of classes.
HOT = 2_000


def opened(pairs: DataFrame, by: str, members: DataFrame, key: str, name: str) -> DataFrame:
    """Each pair once for every member of its class ``by``: members (c, key), the member's key as ``name``.

    Classes of more than HOT members are cut into parts, and the pairs go to each part.
    """
    hot = stored(members.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("c").alias("_c"), F.ceil(F.col("n") / HOT).cast("int").alias("_parts")))
    own = members.select(F.col("c").alias("_own"), F.col(key).alias(name))
    if hot.isEmpty():
        return pairs.join(own, F.col(by) == F.col("_own")).drop("_own")
    parts = F.coalesce("_parts", F.lit(1))
    m = own.join(hot, F.col("_own") == F.col("_c"), "left").select("_own", name, F.pmod(F.xxhash64(name), parts).cast("int").alias("_part"))
    p = pairs.join(hot, F.col(by) == F.col("_c"), "left").withColumn("_at", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_c", "_parts")
    return p.join(m, (F.col(by) == F.col("_own")) & (F.col("_at") == F.col("_part"))).drop("_own", "_at", "_part")


def package_path(*parts: str) -> str:
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), *parts)
