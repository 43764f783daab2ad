"""Models and outside judges for the rows that rules leave open."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import detect as D
from ..sources.storage import stored

# Label of the second stage -> category and severity; any other label is harassment, high.
LABELS = {"harassment": ("toxic_harassment", "high"), "harmful_content": ("toxic_violence", "critical"), "hate_speech": ("toxic_hate", "critical"), "hindi_abuse": ("toxic_harassment", "high"), "self_harm": ("toxic_self_harm", "critical"), "sexual": ("toxic_sexual", "high")}
# Answer of an outside judge -> category and severity; any other answer is harassment, medium.
ANSWERS = {"violence": ("toxic_violence", "critical"), "threat": ("toxic_violence", "high"), "hate_speech": ("toxic_hate", "critical"), "hate": ("toxic_hate", "critical"), "harassment": ("toxic_harassment", "high"), "self_harm": ("toxic_self_harm", "critical"), "sexual": ("toxic_sexual", "high"), "grooming": ("toxic_sexual", "critical"), "radicalization": ("toxic_violence", "critical"), "manipulation": ("toxic_harassment", "high")}


RESULT = f"struct<found:{D.DETECTION},unsure:boolean,error:string>"


def null_scorer(text: Column) -> Column:
    """Finds nothing, as when no model is there."""
    return F.struct(D.empty().alias("found"), F.lit(False).alias("unsure"), F.lit(None).cast("string").alias("error"))


def model_scorer(predict, base: float = 0.7, high: float = 0.85, low: float = 0.6, on_error: str = "mark"):
    """A scorer from ``predict(list of texts) -> list of (label, score)``.

    ``predict`` is pickled once per task and sees the texts of an Arrow batch that are to be scored. A text
    counts at a score of ``high`` or its length-dependent threshold; from ``low`` on it is unsure. An error
    fails the job (``on_error="raise"``) or is noted in the batch's rows (``"mark"``), which then have no detections.
    """
    if on_error not in ("mark", "raise"):
        raise ValueError("on_error is mark or raise")

    @F.pandas_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())]))
    def run(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"label": pd.Series([None] * len(s), dtype=object), "score": float("nan"), "error": pd.Series([None] * len(s), dtype=object)})
        at = s.notna().to_numpy()
        if at.any():
            try:
                got = predict(s[at].tolist())
                out.loc[at, "label"], out.loc[at, "score"] = [x for x, _ in got], [float(x) for _, x in got]
            except Exception as e:
                if on_error == "raise":
                    raise
                out.loc[at, "error"] = f"{type(e).__name__}: {e}"[:200]
        return out

    def score(text: Column) -> Column:
        def of(p: Column) -> Column:
            toxic = F.coalesce(p["label"] != "safe", F.lit(False))
            hit = toxic & ((p["score"] >= high) | (p["score"] >= D.dynamic_threshold(text, base)))
            cat, sev = label_map(p["label"], LABELS, ("toxic_harassment", "high"))
            one = F.struct(cat.alias("category"), sev.alias("severity"), p["score"].alias("confidence"), F.substring(text, 1, 100).alias("matched_text"), F.lit(0).alias("start_pos"), F.length(text).alias("end_pos"), F.concat(F.lit("[MODEL] "), p["label"]).alias("explanation"), F.lit("model").alias("detector"))
            return F.struct(F.when(hit, F.array(one).cast(D.DETECTION)).otherwise(D.empty()).alias("found"), (toxic & ~hit & (p["score"] >= low)).alias("unsure"), p["error"].alias("error")).cast(RESULT)

        return of(run(text))

    return score


def _judged(answer: Column, text: Column) -> Column:
    """Detections of a judge's answer."""
    a = parse_answer(answer)
    one = F.struct(a["category"].alias("category"), a["severity"].alias("severity"), a["confidence"].alias("confidence"), F.substring(text, 1, 100).alias("matched_text"), F.lit(0).alias("start_pos"), F.length(text).alias("end_pos"), F.concat(F.lit("[JUDGE] "), a["reason"]).alias("explanation"), F.lit("judge").alias("detector"))
    return F.when(a["category"].isNotNull(), F.array(one).cast(D.DETECTION)).otherwise(D.empty())


def judge(answer):
    """A judge from ``answer(list of prompts) -> list of answers``; texts are sanitised first. Without gates, for answers that cost nothing."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        out, at = pd.Series([None] * len(s), dtype=object), s.notna().to_numpy()
        if at.any():
            out[at] = answer(s[at].tolist())
        return out

    def ask(df: DataFrame) -> DataFrame:
        t = F.col("_t")
        said = df.withColumn("_answer", run(F.when(F.col("ask"), prompt(D.sanitize(t)["text"]))))
        status = F.when(F.col("ask"), "called").otherwise("not_asked")
        return said.withColumn("judged", F.struct(F.coalesce(_judged(F.col("_answer"), t), D.empty()).alias("found"), status.alias("status"))).drop("_answer")

    return ask


CALLS = "key string, client string, ts timestamp, prompt string"


def gated_judge(answer, key: str, client: str, ts: str, rpm: int = 30, daily_cost: float = 10.0, cost_of=None, most_failures: int = 5, wait: float = 30.0, needed: int = 3, retries: int = 3):
    """A judge behind its gates, in the order of the calls of each client: a budget of calls a minute and of cost a day, then a sanitised
    prompt, then a circuit breaker, then the call, tried up to ``retries`` times. A row that a gate stops has no detection and says so in its status:
    not_asked, rate_limited, cost_cap, breaker_open, failed or called.

    ``answer(prompt) -> str`` may raise; ``cost_of(prompt, answer)`` is the price of a call. ``key`` tells the rows apart; rows of equal time go by key.
    """
    from ..streaming.stateful import by_ranges, gated_step

    def ask(df: DataFrame) -> DataFrame:
        held = stored(df)
        calls = held.where("ask").select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(client).cast("string"), F.lit("")).alias("client"), F.col(ts).cast("timestamp").alias("ts"), prompt(D.sanitize(F.col("_t"))["text"]).alias("prompt"))

        def run(state, row):
            return gated_step(state, row.ts.timestamp(), row.prompt, answer, rpm, daily_cost, cost_of, most_failures, wait, needed, retries)

        said = by_ranges(calls, run, "status string, answer string").select(F.col("key").alias("_key"), "status", "answer")
        out = held.join(said, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")
        return out.withColumn("judged", F.struct(F.coalesce(_judged(F.col("answer"), F.col("_t")), D.empty()).alias("found"), F.coalesce("status", F.lit("not_asked")).alias("status"))).drop("status", "answer")

    return ask


def label_map(label, table: dict, default: tuple[str, str]):
    """(category, severity) columns of a label, with the default for unknown ones."""
    cat, sev = F.lit(default[0]), F.lit(default[1])
    for k, (c, s) in table.items():
        cat, sev = F.when(label == k, c).otherwise(cat), F.when(label == k, s).otherwise(sev)
    return cat, sev


def two_stage(first_label, first_score, second_label, second_score):
    """struct<toxic, label, confidence>: safe with a score above one half ends it; else the product of both scores."""
    safe = (first_label == "safe") & (first_score > 0.5)
    return F.struct((~safe).alias("toxic"), F.when(safe, "safe").otherwise(second_label).alias("label"), F.when(safe, first_score).otherwise(F.bround(first_score * second_score, 4)).alias("confidence"))


def prompt(text):
    """The question that an outside judge gets."""
    return F.format_string("Classify the text by one category.\nText: \"%s\"\nCLASSIFICATION: one of safe, %s\nCONFIDENCE: high, medium or low\nREASON: one line", text, F.lit(", ".join(ANSWERS)))


def parse_answer(answer):
    """struct<classification, confidence, reason, category, severity> of lines CLASSIFICATION:, CONFIDENCE:, REASON:."""
    line = lambda k: F.trim(F.regexp_extract(answer, rf"(?m)^\s*{k}:(.*)$", 1))
    c, level = F.lower(line("CLASSIFICATION")), F.lower(line("CONFIDENCE"))
    key = F.replace(c, F.lit(" "), F.lit("_"))
    cat, sev = label_map(key, ANSWERS, ("toxic_harassment", "medium"))
    hit = (c != "") & (c != "safe")
    conf = F.when(~answer.rlike(r"(?m)^\s*CONFIDENCE:"), 0.9).when(level == "high", 0.95).when(level == "medium", 0.8).when(level == "low", 0.65).otherwise(0.8)
    return F.struct(c.alias("classification"), conf.alias("confidence"), line("REASON").alias("reason"), F.when(hit, cat).alias("category"), F.when(hit, sev).alias("severity"))
