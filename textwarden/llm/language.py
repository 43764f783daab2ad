"""Problem 4: the language of each text and of each segment of a mixed one.

One byte-level PPM model per language is trained on a bounded sample of labelled rows and
then frozen; a segment's language is the one with the shortest exact code, and its
confidence the posterior under equal priors at ``BITS`` bits a unit.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import plain
from .ppm import PPM
from .util import spread

LANGS = ("en", "es", "hi", "hinglish", "mr")
OTHER = "other"
#: Labelled rows per language that the models are trained on at most.
SAMPLE = 2_000
ROUNDS = 2
MIN_LETTERS = 14  # a segment with fewer letters, or fewer words, is no whole sentence
MIN_WORDS = 4
#: A language of a mixed text needs this many bits less than the main language on some whole sentence.
MARGIN = 25.0
#: ... and so many bits a letter: names and addresses alone, which are of no language, give less.
MARGIN_LETTER = 1.5
_END = re.compile(r"(?<=[.!?।…])[\"')\]]*\s+|\n+")
# Words by which digits are spelled out.
_DIGITS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple"
# placeholders, addresses and handles (also with at and dot spelled out), links, numbers, four or more spelled digits, codes
_NOISE = re.compile(rf"<[^<>\s]{{1,80}}>|\S*@\S*|\S*[(\[](?:at|dot)[)\]]\S*|\S+ at \w+ dot \w+(?: dot \w+)*|#\S+|https?://\S+|\S*\w[+_]\w\S*|\S*[^\W\d]\.[a-z]{{2,8}}(?![a-z])\S*|\S*\d\S*|\b(?:{_DIGITS})(?:[ -](?:{_DIGITS})){{3,}}\b|\b[A-Z]{{2,5}}\b(?=[ :])")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f]")
_LETTERS = re.compile(r"[^\W\d_]|[ऀ-ॿ]")
_WORD = re.compile(r"[^\W\d_][\w'’ऀ-ॿ-]*")


def canonical_label(lang: F.Column) -> F.Column:
    """Lower case without region suffix and white space; empty is null."""
    x = F.regexp_extract(F.lower(F.trim(lang)), "^[a-z]+", 0)
    return F.when(x != "", x)


def segments(text: str | None) -> list[str]:
    """Sentences and lines, folded, without handles, addresses of any kind and numbers; where the script changes within one, see ``by_script``."""
    out = []
    for s in _END.split(plain_case(text)):
        s = unnamed(re.sub(r"\s+", " ", _NOISE.sub(" ", s)).strip())
        if s:
            out += by_script(s) if _DEVANAGARI.search(s) and _LATIN.search(s) else [s]
    return out


def unnamed(s: str) -> str:
    """Without capitalised words behind the first one, which are names more often than not; a sentence with most of its words capitalised stays as it is."""
    w = s.split(" ")
    keep = [x for i, x in enumerate(w) if not i or not x.lstrip("\"'(¿¡«“")[:1].isupper()]
    return " ".join(keep) if 2 * len(keep) >= len(w) else s


def by_script(s: str) -> list[str]:
    """A sentence in two scripts as its runs of one script that are whole sentences themselves. Shorter runs are borrowed words
    and names and are left out; if no run is whole, the words of the script that has more of them stay."""
    runs: list[tuple[bool, list[str]]] = []
    for w in s.split(" "):
        deva, latin = bool(_DEVANAGARI.search(w)), bool(_LATIN.search(w))
        if runs and (deva == latin or deva == runs[-1][0]):
            runs[-1][1].append(w)
        elif deva != latin or not runs:
            runs.append((deva, [w]))
    good = [" ".join(w) for _, w in runs if whole(" ".join(w))]
    if good:
        return good
    most = sum(len(w) if deva else -len(w) for deva, w in runs) >= 0
    return [" ".join(x for deva, w in runs if deva == most for x in w)]


def plain_case(text: str | None) -> str:
    from .fold import skeleton

    return skeleton(text) or ""


def whole(s: str) -> bool:
    return len(_LETTERS.findall(s)) >= MIN_LETTERS and len(_WORD.findall(s)) >= MIN_WORDS


def train(rows: list[tuple[str, str]]) -> PPM:
    """Models from (label, text). Labels may be wrong: each half of the texts is judged by models of the other half,
    and only sentences that agree with their label, in texts that do, are learnt."""
    docs = [(lab, [x.lower() for x in segments(t) if whole(x)]) for lab, t in rows]
    docs = [(lab, s) for lab, s in docs if s]
    keep = [list(s) for _, s in docs]
    for _ in range(ROUNDS):
        better: list = [None] * len(docs)
        for half in (0, 1):  # each half is judged by models of the other
            by = {c: [""] + [x for k, (lab, _) in enumerate(docs) if lab == c and k % 2 != half for x in keep[k]] for c in LANGS}
            model = PPM(by)
            own = [(k, x) for k in range(half, len(docs), 2) for x in docs[k][1]]
            bits = model.score([x for _, x in own])
            total = np.zeros((len(docs), len(LANGS)))
            np.add.at(total, [k for k, _ in own], bits)
            best = bits.argmin(1)
            for k in range(half, len(docs), 2):
                better[k] = []
            for (k, x), j in zip(own, best, strict=True):
                c = docs[k][0]
                if model.classes[j] == c and model.classes[int(total[k].argmin())] == c:
                    better[k].append(x)
        keep = better
    return PPM({c: [""] + [x for (lab, _), s in zip(docs, keep, strict=True) if lab == c for x in s] for c in LANGS})


class Judge:
    """``model``: one PPM of every language. A sentence whose shortest code is longer than its bytes themselves is in none of them: OTHER."""

    def __init__(self, model: PPM):
        self.model = model
        self.names = [*model.classes, OTHER]

    def __call__(self, texts: list[str | None], every: bool = False) -> list[list[tuple[str, str, float, int, np.ndarray]]]:
        """Per text: (segment, language, confidence, letters, bits under every name) of its whole sentences, or of the whole text if it has none.
        With ``every``, of each segment that has a letter. Equal segments are coded once."""
        parts = []
        for t in texts:
            own = segments(t)
            parts.append([s for s in own if _LETTERS.search(s)] if every else [s for s in own if whole(s)] or ([" ".join(own)] if own else []))
        place = {s: i for i, s in enumerate(dict.fromkeys(s for p in parts for s in p))}
        if not place:
            return [[] for _ in texts]
        size = np.array([len(s.lower().encode("utf-8", "surrogatepass")) + 2 for s in place], float)
        bits = np.concatenate([self.model.score([s.lower() for s in place]), 8 * size[:, None]], 1)
        best = bits.argmin(1)
        p = np.exp2(-(bits - bits.min(1)[:, None]) / np.maximum(1.0, size / 16)[:, None])  # tempered: bytes are not independent
        p = p.max(1) / p.sum(1)
        return [[(s, self.names[best[i]], float(p[i]), len(s), bits[i]) for s in part for i in [place[s]]] for part in parts]


def languages(found: list, names: list[str] = [*sorted(LANGS), "other"]) -> list[tuple[str, float, int]]:
    """(language, confidence, letters) really used: the main one, and each that a whole sentence shows clearly."""
    if not found:
        return []
    total: dict[str, list] = {}
    for _, lang, conf, n, _b in found:
        x = total.setdefault(lang, [0.0, 0])
        x[0] += conf * n
        x[1] += n
    main = max(total, key=lambda c: (total[c][1], c))
    keep = {main}
    for _, lang, _c, n, b in found:
        if lang != main and b[names.index(main)] - b[names.index(lang)] >= max(MARGIN, MARGIN_LETTER * n):
            keep.add(lang)
    return sorted((c, total[c][0] / total[c][1], total[c][1]) for c in keep)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "id", most: int = SAMPLE) -> PPM:
    """Models from at most ``most`` labelled rows per language (those whose hashed key is smallest), in one pass: each part of the
    table keeps its own first rows before they meet."""
    src = df.select(F.col(key).alias("k"), canonical_label(F.col(lang)).alias("c"), F.col(text).alias("t")).where(F.col("t").isNotNull() & F.col("c").isin(*LANGS))
    first = F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("k"), "k", "t"))
    rows = src.withColumn("rn", first).where(F.col("rn") <= most).orderBy("c", "rn").select("c", "t").collect()
    return train([(r.c, r.t) for r in rows])


def identify(df: DataFrame, model: PPM, key: str = "id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per record and language really used: id, lang (as stored), true_lang, confidence, share, mixed.

    A null or empty text, or one without a letter, has no row; a text in none of the languages has the row ``other``. Repeated rows of one record give repeated rows.
    """
    judge = df.sparkSession.sparkContext.broadcast(Judge(model))  # its size is bounded by the sample

    def run(batches):
        for pdf in batches:
            rows = []
            for k, lab, found in zip(pdf["k"], pdf["lang"], judge.value(pdf["t"].tolist()), strict=True):
                used = languages(found)
                size = sum(n for *_, n in used) or 1
                rows += [(k, lab, c, conf, n / size, len(used) > 1) for c, conf, n in used]
            yield pd.DataFrame(rows, columns=["id", "lang", "true_lang", "confidence", "share", "mixed"])

    src = spread(df.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t")))
    return src.mapInPandas(run, f"id {dict(df.dtypes)[key]}, lang string, true_lang string, confidence double, share double, mixed boolean")


def segments_of(df: DataFrame, model: PPM, key: str = "id", text: str = "text") -> DataFrame:
    """One row per segment, however short: id, segment (from 0), text, true_lang, confidence. One without a letter has no language and no row."""
    judge = df.sparkSession.sparkContext.broadcast(Judge(model))

    def run(batches):
        for pdf in batches:
            rows = []
            for k, found in zip(pdf["k"], judge.value(pdf["t"].tolist(), every=True), strict=True):
                rows += [(k, i, s, c, conf) for i, (s, c, conf, *_) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["id", "segment", "text", "true_lang", "confidence"])

    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return src.mapInPandas(run, f"id {dict(df.dtypes)[key]}, segment int, text string, true_lang string, confidence double")


def wrong(found: DataFrame) -> DataFrame:
    """(id, true_lang) of the records whose label is missing or wrong, and of all mixed records."""
    label = canonical_label(F.col("lang"))
    return found.where(label.isNull() | F.col("mixed") | (label != F.col("true_lang"))).select("id", "true_lang").distinct()


__all__ = ["fit", "identify", "plain", "segments_of", "wrong"]
