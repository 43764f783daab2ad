"""Requests, usage, latency, limits and service levels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATENCY_BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)
PRICE_IN, PRICE_OUT = 0.25, 1.25  # per million tokens


def latest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def histogram(df: DataFrame, value: Column, bounds: Sequence[float] = LATENCY_BOUNDS, *by: str) -> DataFrame:
    """Cumulative buckets (le, n), the last one unbounded; one pass of conditional counts."""
    aggs = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias("inf")]
    one = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n")))
    return one.select(*by, F.explode(rows).alias("x")).select(*by, "x.le", "x.n")


def histogram_quantile(hist: DataFrame, q: float, *by: str) -> DataFrame:
    """Linear interpolation inside the bucket that holds the quantile; in the last bucket, its lower bound."""
    w = Window.partitionBy(*by)
    x = hist.withColumn("total", F.max("n").over(w)).withColumn("lo", F.lag("le", 1, 0.0).over(w.orderBy("le"))).withColumn("before", F.lag("n", 1, 0).over(w.orderBy("le")))
    x = x.withColumn("rank", F.col("total") * q).where("n >= rank and before < rank")
    value = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (F.col("rank") - F.col("before")) / (F.col("n") - F.col("before")))
    return x.groupBy(*by).agg(F.round(F.min(value), 6).alias("value"))


def rate_limit(df: DataFrame, client: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """Requests per client and second, with the seconds of the window that are in use and whether a further call passes.

    Calls of one second are one entry; rejected calls count too.
    """
    s = df.where(F.col(client).isNotNull()).groupBy(client, F.unix_timestamp(F.col(ts).cast("timestamp")).alias("sec")).agg(F.count("*").alias("calls"))
    w = Window.partitionBy(client).orderBy("sec").rangeBetween(-(seconds - 1), 0)
    used = F.count("*").over(w) - 1
    return s.select(client, "sec", "calls", used.alias("used"), (used < limit).alias("allowed"), F.greatest(F.lit(0), F.lit(limit) - used).alias("remaining"))


def usage_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in * PRICE_IN / 1e6 + tokens_out * PRICE_OUT / 1e6


def grouped_totals(df: DataFrame, sets: Sequence[Sequence[str]], **aggs: Column) -> DataFrame:
    """Several groupings in one pass; level tells them apart."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    return out.agg(F.grouping_id().cast("int").alias("level"), *[a.alias(n) for n, a in aggs.items()])


def running(df: DataFrame, by: Sequence[str], ts: str, order: Sequence[str], delta: Column, seconds: int = 3600) -> DataFrame:
    """In-flight gauge: the running sum of +1 and -1 events, as column in_flight. Rows without a time come before all others.

    One key's history is never one task's: sums per stretch of time are added up first, then each stretch runs by itself.
    """
    at = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    src = df.withColumn("_d", delta).withColumn("_b", at)
    per = src.groupBy(*by, "_b").agg(F.sum("_d").alias("_n"))
    per = per.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    on = [src[c].eqNullSafe(per[c]) for c in (*by, "_b")]
    joined = src.join(per, reduce(lambda a, b: a & b, on)).select(src["*"], "_before")
    w = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("in_flight", F.col("_before") + F.sum("_d").over(w)).drop("_d", "_b", "_before")


def percentiles(df: DataFrame, by: str, value: str, named: dict[str, float], width: float = 1.0) -> DataFrame:
    """Exact percentiles (the smallest value with at least that share of the rows at or below it) and n, per group.

    Counts per group and bucket of ``width`` say in which bucket each rank lies; only there are values put in order, as counts of
    distinct values. Null values do not count.
    """
    src = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_b"))
    w = Window.partitionBy(by)
    per = src.groupBy(by, "_b").agg(F.count("*").alias("_n"))
    per = per.withColumn("_upto", F.sum("_n").over(w.orderBy("_b"))).withColumn("n", F.sum("_n").over(w)).withColumn("_before", F.col("_upto") - F.col("_n"))
    ranks = F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.ceil(F.col("n") * q), F.lit(1)).alias("rank")) for k, q in named.items()])
    want = per.withColumn("_r", F.explode(ranks)).where((F.col("_r.rank") > F.col("_before")) & (F.col("_r.rank") <= F.col("_upto"))).select(by, "_b", "_before", "n", F.col("_r.name").alias("name"), F.col("_r.rank").alias("rank"))
    counts = src.groupBy(by, "_b", "_v").agg(F.count("*").alias("_c"))
    held = counts.alias("c").join(want.alias("w"), F.col(f"c.{by}").eqNullSafe(F.col(f"w.{by}")) & (F.col("c._b") == F.col("w._b"))).select(F.col(f"w.{by}").alias(by), "w._before", "w.n", "w.name", "w.rank", "c._v", "c._c")
    at = held.withColumn("_at", F.col("_before") + F.sum("_c").over(Window.partitionBy(by, "name").orderBy("_v")))
    one = at.where(F.col("_at") >= F.col("rank")).groupBy(by, "n", "name").agg(F.min("_v").alias("v"))
    return one.groupBy(by, "n").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in named]).select(by, *named, "n")


def status_of(ms: Column) -> Column:
    """Status class of a request: one that has no time has failed."""
    return F.when(ms == -1, "5xx").otherwise("2xx")


def promotion(stats: DataFrame, least: int = 1000, slower: float = 0.1) -> DataFrame:
    """stats: arm (live, shadow), n, fp_rate, fn_rate, mean_ms. Whether the shadow model may take over, and each criterion; one row."""
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    x = stats.agg(*[pick(a, c).alias(f"{a}_{c}") for a in ("live", "shadow") for c in ("n", "fp_rate", "fn_rate", "mean_ms")])
    enough = F.coalesce(F.col("shadow_n") >= least, F.lit(False))
    fp, fn = F.coalesce(F.col("shadow_fp_rate") <= F.col("live_fp_rate"), F.lit(False)), F.coalesce(F.col("shadow_fn_rate") < F.col("live_fn_rate"), F.lit(False))
    fast = F.coalesce(F.col("shadow_mean_ms") <= F.col("live_mean_ms") * (1 + slower), F.lit(False))
    return x.select(enough.alias("enough"), fp.alias("fp_ok"), fn.alias("fn_ok"), fast.alias("latency_ok"), (enough & fp & fn & fast).alias("promote"))
