"""A rule that matches always finds one of its words, in the text as the operators fold it."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.functions import detect as D
from textwarden.rules import fixed_values as V
from textwarden.rules.literals import needs
from textwarden.rules.packs import FINANCE, INJECTION, PII, TOXIC

PATTERNS = [r.pattern for r in (*INJECTION, *FINANCE, *TOXIC, *PII) if r.pattern.startswith("(?i)")] + [p for _, p in V.SUSPICIOUS] + list(V.CLEARLY_SAFE)
FOLDS = {"s": "sSſ", "i": "iIıİ", "k": "kK\u212a"}


@st.composite
def cases(draw):
    """A pattern and a text that it matches, with letters in their other forms."""
    p = draw(st.sampled_from(PATTERNS))
    text = draw(st.from_regex(re.compile(p, re.ASCII)))
    return p, "".join(draw(st.sampled_from(FOLDS[c.lower()])) if c.lower() in FOLDS and c.isascii() else c for c in text)


def test_every_match_holds_a_word(spark):
    """Found by the engine's own matcher and its own folding: what a pattern matches passes its gate."""
    seen: list[tuple[str, str]] = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(cases())
    def collect(case):
        seen.append(case)

    collect()
    df = spark.createDataFrame([(t, p) for p, t in seen], "text string, pattern string").repartition(1)
    for p in {p for p, _ in seen}:
        words = needs(p)
        if not words:
            continue
        part = df.where(df.pattern == p)
        low = D.low_text(part.text)
        gate = low.contains(words[0])
        for w in words[1:]:
            gate = gate | low.contains(w)
        assert part.where(part.text.rlike(D.java(p)) & ~gate).count() == 0, p


@pytest.mark.parametrize("text", ["commit ſuicide", "commit suıcide", "COMMİT SUİCİDE", "\u212aill yourself"])
def test_letters_that_fold_to_ascii(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    hits = [r for r in TOXIC if df.where(df.text.rlike(r.java)).count()]
    found = df.select(D.keyword("text").alias("k")).collect()[0].k
    assert [d.category for d in found] == [r.category for r in hits[:1]] and hits


def test_most_rules_have_words():
    assert sum(bool(needs(p)) for p in PATTERNS) > 0.9 * len(PATTERNS)
