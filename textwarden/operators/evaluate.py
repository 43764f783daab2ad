"""Evaluation: confusion counts, precision and recall, thresholds, class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: Column, predicted: Column, *by: str) -> DataFrame:
    """tp, fp, tn, fn; rows with a null on either side are left out."""
    x = df.select(*by, truth.cast("int").alias("y"), predicted.cast("int").alias("p")).where("y is not null and p is not null")
    return x.groupBy(*by).agg(F.count_if(F.expr("y = 1 and p = 1")).alias("tp"), F.count_if(F.expr("y = 0 and p = 1")).alias("fp"), F.count_if(F.expr("y = 0 and p = 0")).alias("tn"), F.count_if(F.expr("y = 1 and p = 0")).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def metrics(conf: DataFrame, *by: str) -> DataFrame:
    """accuracy, precision, recall, f1; a division by zero gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return conf.select(*by, F.round(ratio(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1, from one table of (truth, predicted) counts."""
    pairs = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    long = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.lit(0).cast("long").alias("pred"), F.col("n").alias("sup")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("sup")))).alias("x")).select("x.*")
    s = long.groupBy("class").agg(F.sum("hit").alias("h"), F.sum("pred").alias("q"), F.sum("sup").alias("support"))
    p, r = ratio(F.col("h"), F.col("q")), ratio(F.col("h"), F.col("support"))
    return s.select("class", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def sweep(df: DataFrame, truth: Column, score: Column, thresholds: Sequence[float]) -> DataFrame:
    """Metrics at every threshold, in one pass: conditional counts, not one copy of the rows per threshold."""
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col("s") >= t
        aggs += [F.count_if((F.col("y") == 1) & hit).alias(f"tp{i}"), F.count_if((F.col("y") == 0) & hit).alias(f"fp{i}"), F.count_if((F.col("y") == 0) & ~hit).alias(f"tn{i}"), F.count_if((F.col("y") == 1) & ~hit).alias(f"fn{i}")]
    one = df.select(truth.cast("int").alias("y"), score.alias("s")).where("y is not null and s is not null").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")]) for i, t in enumerate(thresholds)])
    return metrics(one.select(F.explode(rows).alias("x")).select("x.*"), "threshold")


def best_recall(swept: DataFrame) -> DataFrame:
    """The threshold of the highest recall, the lowest of equals."""
    return swept.orderBy(F.desc("recall"), "threshold").limit(1)


def best_balanced(swept: DataFrame, recall: float = 0.93, precision: float = 0.75, default: float = 0.5) -> DataFrame:
    """The threshold with recall + precision / 2 highest among those good enough; the default if none is."""
    good = swept.where((F.col("recall") >= recall) & (F.col("precision") >= precision))
    pick = good.agg(F.max_by("threshold", F.struct(F.col("recall") + 0.5 * F.col("precision"), -F.col("threshold"))).alias("t"))
    return pick.select(F.coalesce("t", F.lit(default)).alias("threshold"))


def class_weights(df: DataFrame, label: str, boost: dict[str, float] | None = None) -> DataFrame:
    """n / (k * n_c), times the class's boost."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    b = F.lit(1.0)
    for k, v in (boost or {}).items():
        b = F.when(F.col(label) == k, v).otherwise(b)
    return n.select(label, "n", F.round(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")) * b, 6).alias("weight"))


def label_index(df: DataFrame, label: str) -> DataFrame:
    """label, label_id: position among the sorted distinct labels."""
    return df.where(F.col(label).isNotNull()).select(label).distinct().withColumn("label_id", F.row_number().over(Window.orderBy(label)) - 1)


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores; the largest is taken off first, so that no exponential overflows."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(F.transform(scores, lambda y: F.exp(y - top)), F.lit(0.0), lambda a, y: a + y))


def argmax(scores: Column) -> Column:
    """Place (from 0) of the largest score, the first of equals; null for an empty array."""
    return F.when(F.size(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def weighted_f1(report: DataFrame) -> DataFrame:
    """Support-weighted means of a per-class report; one row."""
    n = F.sum("support")
    return report.agg(*[F.round(F.sum(F.col(c) * F.col("support")) / n, 6).alias(c) for c in ("precision", "recall", "f1")])


def expert_set(df: DataFrame, category: str, key: str, ratio: float = 1.5, column: str = "category") -> DataFrame:
    """key, target (1 of the category, 0 safe), split: all rows of one category, up to ratio x as many safe ones by hashed key, 90/10 within each side."""
    from .curate import split_positions, undersample

    rows = df.where(F.col(column).isin(category, "safe")).select(key, F.when(F.col(column) == category, 1).otherwise(0).alias("target"), F.when(F.col(column) == category, "toxic").otherwise("safe").alias("_side"))
    return split_positions(undersample(rows, "_side", ratio, key), key, ["target"], (("train", 0.9), ("val", 1.0))).select(key, "target", "split")


def baseline_scorer(df: DataFrame, text: str, label: str, weights: DataFrame | None = None, features: int = 1 << 16):
    """A fitted pipeline (hashed words, logistic regression with class weights): the plain model to compare others with.

    ``label``: 0.0 or 1.0; ``weights``: label, weight. Null texts and labels are left out of the fit.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("_text"), F.col(label).cast("double").alias("_label"))
    if weights is not None:
        rows = rows.join(F.broadcast(weights.select(F.col(label).cast("double").alias("_label"), F.col("weight").alias("_weight"))), "_label")
    else:
        rows = rows.withColumn("_weight", F.lit(1.0))
    steps = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{M}\p{N}]+"), HashingTF(inputCol="_words", outputCol="_features", numFeatures=features), LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=30, regParam=1e-4)]
    return Pipeline(stages=steps).fit(rows)


def first_words(text: Column, most: int = 256) -> Column:
    """A model's input: the first words of a text, one space between."""
    from ..functions.detect import words

    return F.array_join(F.slice(words(text), 1, most), " ")
