"""The operators on small tables: brute force, nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textwarden.llm import abuse, formatting, language, leak, lookalike, mixture, overlap, pieces, pii, util
from textwarden.llm.fold import skeleton
from textwarden.llm.leak import words
from textwarden.llm.pii_training import FIRST  # noqa: F401
from textwarden.llm.tokens import encode

from .test_models import lcs

ODD = "id string, text string, lang string, k string, t string, c string, w string"  # names that the operators use inside


def odd(spark, texts):
    return spark.createDataFrame([(f"r{i}", t, None, "x", "y", "z", "v") for i, t in enumerate(texts)], ODD)


@pytest.mark.parametrize("forms", [2, 1000])
def test_lookalike_pairs_by_brute_force(spark, monkeypatch, forms):
    monkeypatch.setattr(lookalike, "FORMS", forms)
    texts = ["Hi there", "Hi thеre", "Hi​ there", "Hi there", "hi there", None, "", "​", "x"]
    df = odd(spark, texts)
    want = sorted(tuple(sorted((f"r{i}", f"r{j}"))) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if a is not None and b is not None and a != b and skeleton(a) == skeleton(b))
    assert sorted((r.key_a, r.key_b) for r in lookalike.pairs(df).collect()) == want
    assert sorted((r.key_a, r.key_b) for r in lookalike.pairs(df.unionByName(df)).collect()) == want
    assert lookalike.pairs(df.limit(0)).count() == 0
    assert lookalike.groups(df).where("n_forms = 3").collect()[0].n_records == 4
    assert lookalike.with_skeleton(df).where("text is null and skeleton is null").count() == 1


@pytest.mark.parametrize("limit", [3, 10_000])
def test_formatting_members_by_brute_force(spark, limit):
    r = random.Random(9)
    base = ["same start " + "".join(r.choices("abc", k=3)) for _ in range(40)] + ["hot text"] * 30 + ["", "same start "]
    rows = [(f"k{i:03d}", r.choice([str.upper, str.lower, str.title])(t).replace(" ", r.choice([" ", "  ", "\n"])) + r.choice(["", "!", "."])) for i, t in enumerate(base)] + [("null", None)]
    df = spark.createDataFrame(rows, "k string, t string").select("k", formatting.canonical_udf("t").alias("canon"))
    by: dict = {}
    for k, t in rows:
        if t is not None:
            by.setdefault(formatting.canonical(t), []).append(k)
    want = sorted((min(v), k, len(v)) for v in by.values() for k in v)
    if limit == 3:  # buckets too long, not too many
        assert sorted((x.key_a, x.k, x.copies) for x in formatting.members(df, "k", "canon", 10_000, 40).collect()) == want
    assert sorted((x.key_a, x.k, x.copies) for x in formatting.members(df, "k", "canon", limit).collect()) == want
    assert formatting.members(df.limit(0), "k", "canon", limit).count() == 0


def test_overlaps_by_brute_force(spark):
    r = random.Random(4)
    vocab = [f"word{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(30)] for _ in range(12)]

    def change(w, n):
        w = list(w)
        for i in r.sample(range(len(w)), n):
            w[i] = f"new{r.randint(0, 10**9)}"
        return w

    rows = [(f"t{i:02d}", " ".join(w), "Train ") for i, w in enumerate(base)]
    rows += [(f"e{i:02d}{n}", ", ".join(change(w, n)).upper(), r.choice(["val", "TEST"])) for i, w in enumerate(base) for n in (0, 3, 12)]
    rows += [("null", None, "train"), ("empty", "", "val"), ("nosplit", " ".join(base[0]), None), ("half", " ".join(base[0][:15] + base[1][15:]), "val"), ("tiny1", "ok fine", "train"), ("tiny2", "OK, fine", "test")]
    df = spark.createDataFrame([(*x, "s", 1, 2) for x in rows + rows[:3]], "record_id string, text string, split string, source string, c int, w int")

    want = set()
    for (ka, a, sa), (kb, b, sb) in itertools.product(rows, rows):
        if (sa or "").strip().lower() == "train" and (sb or "").strip().lower() in ("val", "test") and a and b:
            wa, wb = words(a), words(b)
            if (max(len(wa), len(wb)) - lcs(wa, wb)) <= max(len(wa), len(wb)) / 6:
                want.add((ka, kb))
    found = overlap.overlaps(df)
    assert {(x.train_key, x.eval_key) for x in found.collect()} == want and ("t00", "e003") in want and ("tiny1", "tiny2") in want
    assert sum(x.overlapping for x in overlap.report(found, df).collect()) == len({e for _, e in want})
    assert overlap.overlaps(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [3, 2_000])
def test_copies_of_hot_classes_are_opened_in_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(util, "HOT", hot)
    text = "one two three four five six seven eight"
    rows = [(f"t{i:02d}", text, "train") for i in range(20)] + [(f"e{i:02d}", text.upper() if i % 2 else text.replace("four", "for"), "test") for i in range(15)] + [("x", "other words of no one else", "val")]
    found = overlap.overlaps(spark.createDataFrame(rows, "record_id string, text string, split string"))
    assert {(x.train_key, x.eval_key) for x in found.collect()} == {(f"t{i:02d}", f"e{j:02d}") for i in range(20) for j in range(15)}
    same = odd(spark, ["Hi"] * 9 + ["H\u0456"] * 8)
    assert lookalike.pairs(same).count() == 72


def test_overlaps_through_further_words(spark, monkeypatch):
    """With room for hardly any pair per word, the second and third words must find the same."""
    r = random.Random(8)
    common = ["the", "only", "thing", "that", "helps", "is", "this"]
    rows = []
    for i in range(20):
        w = [*common, *[f"a{r.randint(0, 9)}" for _ in range(10)], *common, *[f"b{r.randint(0, 9)}" for _ in range(10)]]
        rows += [(f"t{i:02d}", " ".join(w), "train"), (f"e{i:02d}", " ".join(w[:5] + ["odd"] + w[6:]), "val")]
    df = spark.createDataFrame(rows, "record_id string, text string, split string")
    full = {(x.train_key, x.eval_key) for x in overlap.overlaps(df).collect()}
    monkeypatch.setattr(overlap, "MOST_PAIRS", 2)
    assert {(f"t{i:02d}", f"e{i:02d}") for i in range(20)} <= full
    assert {(x.train_key, x.eval_key) for x in overlap.overlaps(df).collect()} == full


def test_skeleton_with_a_table_from_a_file(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# source ; target ; class\n0251 ;\t0061 ;\tMA\t# comment\n1D00 ; 0251 ; MA\n0031 ; 006C ; MA\n13C0 ; 1D00 ; MA\n", encoding="utf-8")
    df = odd(spark, ["\u13c0b1", "ab1", None, "\u0430b1"])
    got = [x.s for x in lookalike.with_skeleton(df, to="s", table=str(tmp_path / "c.txt")).collect()]
    assert got == ["ab1", "ab1", None, "ab1"]


def test_leak_find_and_clean(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"before {item} after", "a"), (2, "nothing", "b"), (3, None, "c"), (4, "", "d"), (1, f"before {item} after", "a"), (5, " ".join(f"<b>W{i}</b>,\n" for i in range(12)), "e")], "doc_id long, text string, n string")
    items = spark.createDataFrame([(10, item), (11, "short item"), (12, None)], "item_id long, text string")
    want = [(1, 10, 9), (5, 10, 1)]
    assert sorted(tuple(r) for r in leak.find(docs, items).collect()) == want
    monkeypatch.setattr(leak, "MAX_NGRAMS", 4)
    assert sorted(tuple(r) for r in leak.find(docs, items).collect()) == want
    got = {r.doc_id: r.text for r in leak.clean(docs, items).collect()}
    assert got[1] == "before after" and got[2] == "nothing" and got[3] is None and got[4] == ""
    assert sorted({r.doc_id for r in leak.clean(docs, items, mode="documents").collect()}) == [2, 3, 4]
    assert leak.find(docs, items.limit(0)).count() == 0


def test_leak_through_long_tags_and_cut_by_characters():
    w = [f"w{i}" for i in range(14)]
    index = leak.Index([(7, " ".join(w))])
    for size in (20, 260, 5_000):
        tag = f'<a class="x" href="https://x.example/{"q" * size}" data-k=\'{"v" * size}\'>'
        text = "Before, <b>it</b> stays. " + " ".join(w[:6]) + f" {tag}" + " ".join(w[6:]).upper() + "</a>, and\n\nAfter!"
        assert len(index.hits(text)) == 3
        assert leak.cut_words(text, [i for i, _ in index.hits(text)], 12) == "Before, <b>it</b> stays. </a>, and\n\nAfter!"
    noted = "<!-- " + "note " * 900 + "-->"
    assert index.hits(" ".join(w[:5]) + noted + " ".join(w[5:])) and not index.hits(" ".join(w[:5]) + " <!-- " + " ".join(w[5:]).replace("w9", "x"))
    assert leak.words("a <b and " + "c " * 300 + "> d")[2] == "and"  # no tag: what looks like one has no values and is long


def test_word_spans_are_the_words():
    r = random.Random(12)
    bits = ["Cafe\u0301", "ＡＢ", "a&amp;b", "&lt;x&gt;", "&nbsp;", "“q”", "<i>", "</i>", "it's", "नमस्ते", "İz", " ", "\n", "\u200b", "&#233;t", "&eacute;", "x-y", "😀", "ﬁ", "한글", "&notanentity", "&", "<", ">"]
    for _ in range(400):
        t = "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 20)))
        spans = leak.word_spans(t)
        assert [x for x, *_ in spans] == leak.words(t), t
        assert all(a < b for _, a, b in spans) and all(b <= c for (_, _, b), (_, c, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("most", [3, 1_000_000])
def test_leak_clean_cuts_overlapping_passages_of_several_indexes(spark, monkeypatch, most):
    w = [f"w{i}" for i in range(24)]
    docs = spark.createDataFrame([(1, " ".join(["before", *w[:22], "after"]), "a"), (2, None, "b"), (3, "Kept, as it is.", None), (4, " ".join([*w[:6], *w[:14], *w[6:12]]), "d")], "doc_id long, text string, _hits string")
    items = spark.createDataFrame([(10, " ".join(w[:14])), (11, " ".join(w[8:22])), (12, "other " * 20)], "item_id long, text string")
    monkeypatch.setattr(leak, "MAX_NGRAMS", most)
    assert len(leak._indexes(items, "item_id", "text", 12)) == (5 if most == 3 else 1)
    got = {r.doc_id: (r.text, r._hits) for r in leak.clean(docs, items).collect()}
    # the words around a removed passage are no passage themselves
    assert got == {1: ("before after", "a"), 2: (None, "b"), 3: ("Kept, as it is.", None), 4: (" ".join(w[:12]), "d")}
    assert sorted(r.doc_id for r in leak.clean(docs, items, mode="documents").collect()) == [2, 3]


def test_mixture_shares_and_caps(spark):
    r = random.Random(3)
    rows = [(i, "word " * r.randint(20, 60), s, r.choice(["en", "hi", None])) for i, s in enumerate(["a"] * 600 + [" B "] * 150 + ["c"] * 100 + [None] * 20 + ["other"] * 30)]
    docs = spark.createDataFrame([*rows, (9999, None, "a", "en")], "doc_id long, text string, source string, lang string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(docs, targets)
    got = {x.source: x for x in mixture.shares(mixed, targets).collect()}
    assert all(abs(x.actual_share - x.target_share) < 0.01 for x in got.values())
    assert got["a"].most_repeats <= 1 and got["b"].most_repeats <= 3
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixture.mix(docs, targets).collect()))
    assert mixture.mix(docs.limit(0), targets).count() == 0


def test_topics_are_fitted_on_all_documents_and_all_their_tokens(spark, monkeypatch):
    r = random.Random(5)
    groups = [[f" {w}" for w in x.split()] for x in ("parcel courier delivery late order", "bank loan interest account paid", "match goal team player score")]
    rows = [(i, "".join(r.choices(groups[i % 2], k=12))) for i in range(2_600)] + [(2_600, ""), (2_601, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("a")).withColumn("lang", F.lit("en"))
    # the third group stands only in documents whose hashed id is beyond the first 2,000
    late = [x.doc_id for x in docs.where("doc_id < 2600").orderBy(F.xxhash64("doc_id")).collect()[2_200:]]
    texts = {i: "".join(r.choices(groups[2], k=12)) if i in set(late) else t for i, t in rows}
    # tokens that occur once beside 500 that occur twice
    many = [f" {a}{b}" for a in "bcdfghjklmnpqrstvwxz" for b in range(10, 35)]
    texts |= {i: "".join(many) * 2 + "".join(groups[2]) for i in late[:3]}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").withColumn("source", F.lit("a")).withColumn("lang", F.lit("en"))
    found = mixture.topics(df, k=3)
    whole = [(h, *np.unique(encode(t), return_counts=True)) for h, t in sorted(map(tuple, df.where("text is not null").select(F.xxhash64("doc_id"), "text").collect()))]
    local = mixture.Topics([(i, n) for _, i, n in whole], len(found.idf), 3)
    assert np.array_equal(found.idf, local.idf) and np.array_equal(found.centres, local.centres)
    names = [{found.of(encode(texts[i])) for i in some} for some in (set(range(0, 2_600, 2)) - set(late), set(range(1, 2_600, 2)) - set(late), late[3:])]
    assert all(len(x) == 1 for x in names) and len(set.union(*names)) == 3
    # neither the parts that the documents come in nor the size of blocks changes anything
    monkeypatch.setattr(mixture, "BLOCK", 7)
    other = mixture.topics(df.repartition(7, "text"), k=3)
    assert np.array_equal(found.centres, other.centres) and np.array_equal(found.centres, mixture.Topics([(i, n) for _, i, n in whole], len(found.idf), 3).centres)
    got = {x.doc_id: (x.topic, x.tokens) for x in mixture.sized(mixture.counted(df), found).collect()}
    assert got == {i: (found.of(encode(t)), len(encode(t))) for i, t in texts.items() if t is not None}
    assert mixture.topics(df.limit(0)).of([1]) == "t0"


def test_pieces_operator(spark):
    docs = spark.createDataFrame([(1, "word " * 400, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x")], "doc_id long, text string, piece string")
    limits = spark.createDataFrame([("p", 100, 10), ("q", 1000, 10)], "profile string, max_tokens int, overlap_tokens int")
    out = pieces.split(docs, limits).collect()
    assert {(x.profile, x.doc_id) for x in out if x.n_pieces > 1} == {("p", 1)}
    assert {x.doc_id for x in out} == {1, 2, 4} and all(x.tokens <= 100 for x in out if x.profile == "p")
    long_ = pieces.split(docs, limits, only_long=True).collect()
    assert sorted((x.profile, x.doc_id, x.piece, x.text) for x in long_) == sorted((x.profile, x.doc_id, x.piece, x.text) for x in out if x.n_pieces > 1)


def test_pii_operator(spark):
    df = odd(spark, ["My name is Karan Dolmaya. Call me on 9876543210 after six.", None, "", "order no 6636-3358 abhi tak khula hai.", "क" * 3000])
    got = {(x.id, x.pii_type) for x in pii.spans(df).collect()}
    assert got == {("r0", "person_name"), ("r0", "phone")}
    red = {x.id: x.text for x in pii.redact(df).collect()}
    assert red["r0"] == "My name is [NAME]. Call me on [PHONE] after six." and red["r1"] is None and red["r2"] == "" and len(red["r4"]) == 3000
    assert pii.spans(df.limit(0)).count() == 0


def test_language_and_abuse_operators(spark):
    en = [f"the {a} was {b} in the town on {c} and nobody knew why" for a in ("parcel", "refund", "loan") for b in ("late", "wrong", "lost") for c in ("Monday", "Friday")]
    hi = [f"मेरा {a} {b} था और मुझे अच्छा नहीं लगा" for a in ("पार्सल", "फ़ोन", "खाना") for b in ("ख़राब", "ग़ायब", "पुराना")]
    rows = [(f"e{i}", t, "en" if i else "EN-in", ("safe",)) for i, t in enumerate(en)] + [(f"h{i}", t, "hi" if i > 1 else [None, "en"][i], ("harassment",)) for i, t in enumerate(hi)] + [("n", None, "en", (None,)), ("z", "", None, ("safe",))]
    df = spark.createDataFrame(rows, "id string, text string, lang string, labels struct<category:string>")
    found = language.wrong(language.identify(df, language.fit(df)))
    assert sorted(map(tuple, found.collect())) == [("h0", "hi"), ("h1", "hi")]
    assert language.segments_of(df, language.fit(df)).count() == len(en) + len(hi)
    index = abuse.fit(df)
    s = {x.id: x.score for x in abuse.score(df, index).collect()}
    assert all(s[f"h{i}"] > 0.5 for i in range(len(hi))) and all(s[f"e{i}"] < 0.5 for i in range(len(en))) and s["n"] == 0.0 and s["z"] == 0.0
    empty = df.limit(0)
    assert language.identify(empty, language.fit(empty)).count() == 0 and abuse.score(empty, abuse.fit(empty)).count() == 0
    assert abuse.rates(abuse.score(df, index).selectExpr("score", "cast(null as string) source")).collect()[0].records == len(rows)


def test_segments_keep_short_sentences(spark):
    texts = {"en": "the parcel was late in the town on Friday. Version 4.11.5 fixed it. 12:30! Why?", "hi": "मेरा फ़ोन ख़राब था और मुझे अच्छा नहीं लगा। ठीक है।"}
    df = spark.createDataFrame([(c, t, c) for c, t in texts.items()], "id string, text string, lang string")
    model = language.train([(c, t) for c, t in texts.items()] * 2)
    got = sorted((x.id, x.segment, x.text) for x in language.segments_of(df, model).collect())
    assert [x[:2] for x in got] == [("en", 0), ("en", 1), ("en", 2), ("hi", 0), ("hi", 1)]
    assert [x[2] for x in got[1:3]] == ["Version fixed it.", "Why?"]


def test_json_records(spark):
    a = json.dumps({"text": "A b", "label": "x", "category": "y", "source": None})
    b = json.dumps({"source": None, "category": "Y", "label": "x", "text": "a, B!"}, indent=2)
    df = spark.createDataFrame([("1", a), ("2", b), ("3", a[:-3]), ("4", None)], "k string, body string").select("k", formatting.canonical_json_udf("body").alias("canon"))
    assert sorted((x.key_a, x.k) for x in formatting.members(df, "k", "canon").collect()) == [("1", "1"), ("1", "2")]


def near_by_brute_force(rows):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(zip(b, row, row[1:], strict=False), lambda left, t: t[1] + 1 if t[0] == x else max(left, t[2]), initial=0)][1:]
        return row[-1]

    out = set()
    for (ka, a, sa), (kb, b, sb) in itertools.product(rows, rows):
        if sa == "train" and sb == "val":
            wa, wb = a.split(" "), b.split(" ")
            size = max(len(wa), len(wb))
            if size - lcs(wa, wb) <= size / 6:
                out.add((ka, kb))
    return out


@pytest.mark.parametrize("most", [2, 100, 20_000])
def test_overlaps_of_many_reworded_copies(spark, monkeypatch, most):
    """Every word of the text is hot, and the changes leave runs of two to five words."""
    r = random.Random(21)
    base = [f"w{i}" for i in range(72)]
    rows = []
    for k in range(160):
        w, first = list(base), r.randrange(6)
        for i in range(first, 72, 6 if k % 2 else 12):
            w[i] = f"odd{r.randint(0, 30)}"
        if k % 3 == 0:  # a moved word breaks the run in two places
            for _ in range(r.randint(1, 8)):
                w.insert(r.randrange(72), w.pop(r.randrange(72)))
        rows.append((f"{k:03d}", " ".join(w), "train" if k % 5 else "val"))
    monkeypatch.setattr(overlap, "MOST_PAIRS", most)
    found = overlap.overlaps(spark.createDataFrame(rows, "record_id string, text string, split string")).collect()
    want = near_by_brute_force(rows)
    assert {(x.train_key, x.eval_key) for x in found} == want and len(want) > 500


def test_overlaps_of_short_texts_by_brute_force(spark):
    r = random.Random(22)
    rows = [("a0", "one two three four five six seven eight", "train"), ("b0", "one two three fuor five six seven eight", "val")]
    for n in range(5, 26):
        for k in range(4):
            w = [f"{n}w{r.randint(0, 3 * n)}" for _ in range(n)]
            rows.append((f"t{n:02d}{k}", " ".join(w), "train"))
            for e in range(n // 6 + 2):
                x = list(w)
                for i in range(e):  # evenly spread, so that the shared runs are short
                    x[(2 * i + 1) * n // (2 * e)] = f"new{r.randint(0, 10**9)}"
                rows.append((f"e{n:02d}{k}{e}", " ".join(x), "val"))
            x = list(w)
            x.insert(r.randrange(n), x.pop(r.randrange(n)))
            rows.append((f"m{n:02d}{k}", " ".join(x), "val"))
    found = overlap.overlaps(spark.createDataFrame(rows, "record_id string, text string, split string")).collect()
    want = near_by_brute_force(rows)
    assert {(x.train_key, x.eval_key) for x in found} == want and ("a0", "b0") in want and ("t183", "e1833") in want
