"""Problem 1: personal information in free text, found by the tagger of ``bilstm_crf`` and replaced by typed placeholders."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import KINDS, Tagger
from .fold import fold_chars
from .util import package_path, spread

MODEL = package_path("models", "pii_bilstm.npz")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[NAME]"}
#: Texts that are tagged at once; long ones fill it by their characters.
CHUNK_CHARS = 60_000
_DIGIT_WORD = re.compile(r"\b(?:zero|one|two|three|four|five|six|seven|eight|nine)\b", re.I)


def plausible(kind: str, value: str) -> bool:
    """The exact check after the tagger: what a value of this kind must hold."""
    v = fold_chars(value).replace("​", "")
    digits = sum(c.isdigit() for c in v)
    if kind == "email":
        return bool(re.search(r"\w\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[\w-]{2,}\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?\w{2,}", v, re.I))
    if kind == "phone":
        return 7 <= digits + len(_DIGIT_WORD.findall(v)) <= 15
    if kind == "id_number":
        return digits >= 4 and len(v) >= 6 and not re.search(r"[@$!]", v)
    if kind == "address":
        return digits >= 1 and len(re.findall(r"[^\W\d_]", v)) >= 3
    return len(v) >= 3 and not digits


def decode(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text; white space and sentence marks at their edges cut off."""
    out: list = [[] for _ in texts]
    part: list[int] = []
    size = 0

    def flush() -> None:
        for k, found in zip(part, tagger.decode([texts[i] for i in part]), strict=True):
            t = texts[k]
            for a, b, kind in found:
                while b > a and t[b - 1] in " \t\r\n.,;:!?<>।":
                    b -= 1
                while a < b and t[a] in " \t\r\n.,;:!?<>।":
                    a += 1
                if b > a and plausible(kind, t[a:b]):
                    out[k].append((a, b, kind))

    for k in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if size + len(texts[k]) > CHUNK_CHARS and part:
            flush()
            part, size = [], 0
        part.append(k)
        size += len(texts[k])
    if part:
        flush()
    return out


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    for a, b, kind in sorted(spans, reverse=True):
        text = text[:a] + PLACEHOLDER[kind] + text[b:]
    return text


def _run(df: DataFrame, key: str, text: str, schema: str, rows, model: str) -> DataFrame:
    with open(model, "rb") as f:
        weights = df.sparkSession.sparkContext.broadcast(f.read())  # a few hundred kB

    def run(batches):
        import io

        tagger = Tagger.load(io.BytesIO(weights.value))
        for pdf in batches:
            texts = [t or "" for t in pdf["t"]]
            yield rows(pdf, texts, decode(tagger, texts))

    return spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(run, schema)


def spans(df: DataFrame, key: str = "id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row per span: id, pii_type, start, end (characters, end excluded), value. Null and empty texts have none; repeated rows give repeated rows."""

    def rows(pdf, texts, found):
        out = [(k, kind, a, b, t[a:b]) for k, t, f in zip(pdf["k"], texts, found, strict=True) for a, b, kind in f]
        return pd.DataFrame(out, columns=["id", "pii_type", "start", "end", "value"])

    return _run(df, key, text, f"id {dict(df.dtypes)[key]}, pii_type string, start int, end int, value string", rows, model)


def redact(df: DataFrame, key: str = "id", text: str = "text", model: str = MODEL) -> DataFrame:
    """id, text with typed placeholders (everything else unchanged), kinds (sorted, distinct); one row per row. A null text stays null."""

    def rows(pdf, texts, found):
        return pd.DataFrame({"id": pdf["k"], "text": [redact_text(t, f) if t0 is not None else None for t0, t, f in zip(pdf["t"], texts, found, strict=True)], "kinds": [sorted({k for *_, k in f}) for f in found]})

    return _run(df, key, text, f"id {dict(df.dtypes)[key]}, text string, kinds array<string>", rows, model)


__all__ = ["KINDS", "PLACEHOLDER", "redact", "spans"]
