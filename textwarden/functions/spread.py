"""Enough tasks for costly projections over small files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Redistributes a plain scan that has fewer parts than the cluster has cores.

    A file of a few MB is one part, and one task would do all the work on it. Inputs with
    enough parts, which is every large one, stay as they are: no shuffle. So does a frame
    that a shuffle has already distributed.
    """
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    # the adaptive node stands on top of every plan with a shuffle; without it, shuffles stand in the plan themselves
    if plan.nodeName() == "AdaptiveSparkPlan" or "Exchange" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if execution.toRdd().getNumPartitions() < cores else df
