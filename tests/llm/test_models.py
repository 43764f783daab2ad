"""The models without Spark: folding, tagger, index, PPM, alignment, cutting, raking."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from textwarden.llm import abuse, bilstm_crf, language, leak, overlap, pieces, pii, pii_training
from textwarden.llm.fold import fold_chars, skeleton
from textwarden.llm.formatting import Trie, canonical, canonical_json
from textwarden.llm.mixture import Topics, rake
from textwarden.llm.ppm import PPM, Table
from textwarden.llm.tokens import encode


@pytest.mark.parametrize(("a", "b"), [("Ｈｉ", "Hi"), ("café", "café"), ("о", "o"), ("a​b", "ab"), ("a b", "a b"), ("ﬁt", "fit"), ("क़", "क़"), ("आ", "अा")])
def test_skeleton_joins_what_looks_alike(a, b):
    assert skeleton(a) == skeleton(b) and skeleton(skeleton(a)) == skeleton(a)


@pytest.mark.parametrize(("a", "b"), [("cafe", "café"), ("A", "a"), ("a  b", "a b"), ("a\tb", "a b"), ("कि", "की"), ("x²", "x2"), ("a,b", "ab"), ("rn", "m"), ("l", "1")])
def test_skeleton_keeps_what_is_visible(a, b):
    assert skeleton(a) != skeleton(b)


def test_fold_is_aligned():
    t = "Ｍy​ nаme ﬁ é नमस्ते 😀"
    assert len(fold_chars(t)) == len(t) and skeleton(None) is None and skeleton("") == ""


def test_window_overlap_does_not_change_a_short_text_and_long_texts_are_whole():
    tagger = bilstm_crf.Tagger.load(pii.MODEL)
    one = "My name is Meera Torvane. Mail me at meera.torvane@mailbox.example."
    filler = "We tested the video call with several sellers in Wexpumere during the power cut. " * 40
    for text in (one, filler + one + " " + filler):
        found = pii.decode(tagger, [text])[0]
        assert {text[a:b] for a, b, _ in found} == {"Meera Torvane", "meera.torvane@mailbox.example"}
    assert pii.decode(tagger, ["", " "]) == [[], []]


def test_tagger_on_held_out_sentences():
    """Sentences of the generator with another seed: values and names that training never saw."""
    tagger = bilstm_crf.Tagger.load(pii.MODEL)
    r = random.Random(12345)
    rows = [pii_training.sentence(r, r.random() < 0.25) for _ in range(400)]
    got = pii.decode(tagger, [t for t, _ in rows])
    hit = sum(bool({k for *_, k in f} & {k for *_, k in sp}) for (_, sp), f in zip(rows, got, strict=True) if sp)
    wrong = sum(bool(f) for (_, sp), f in zip(rows, got, strict=True) if not sp)
    assert hit >= 0.93 * sum(bool(sp) for _, sp in rows) and wrong <= 0.08 * sum(not sp for _, sp in rows)


def test_crf_gradient_by_difference():
    g = np.random.default_rng(1)
    h, e, k = 4, 3, len(bilstm_crf.TAGS)
    w = {"emb": g.normal(0, 1, (bilstm_crf.N_CHARS, e)), "wx": g.normal(0, 1, (2, e + 1, 4 * h)), "wh": g.normal(0, 0.5, (2, h, 4 * h)), "b": g.normal(0, 1, (2, 4 * h)), "wo": g.normal(0, 1, (2 * h, k)), "bo": g.normal(0, 1, k), "trans": g.normal(0, 1, (k, k))}
    ids = bilstm_crf.encode("abc de")[None]
    tags, mask = np.array([[1, 2, 2, 0, 3, 4]], np.int8), np.ones((1, 6))
    allowed = bilstm_crf.transitions_allowed()
    loss, grad = pii_training._loss(w, ids, tags, mask, allowed, h)
    for name, at in (("wo", (1, 2)), ("trans", (1, 2)), ("wx", (1, 2, 5)), ("wh", (0, 1, 3)), ("b", (1, 2))):
        w[name][at] += 1e-5
        up, _ = pii_training._loss(w, ids, tags, mask, allowed, h)
        w[name][at] -= 1e-5
        assert abs((up - loss) / 1e-5 - grad[name][at]) < 2e-3, name


def cosines(index, examples, query):
    """TF-IDF cosines over all terms of both texts, by dictionaries."""
    n, df = len(examples), Counter(t for e in examples for t in abuse.terms(abuse.tokens(e)))

    def vector(s):
        v = {t: (1 + np.log(c)) * np.log(1 + n / max(1, df[t])) for t, c in abuse.terms(abuse.tokens(s)).items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    q = vector(query)
    return sorted((sum(x * q.get(t, 0) for t, x in vector(e).items()) for e in examples), reverse=True)


def test_nearest_is_exact():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    common = words[:30]
    rows = [(" ".join(r.choices(common, k=5) + r.choices(words, k=4)), [(i, i % 2)]) for i in range(900)]
    index = abuse.Index(rows)
    queries = [" ".join(r.choices(common, k=5) + r.choices([*words, "unseen", "strangeword"], k=4)) for _ in range(40)]
    found = index.nearest([abuse.tokens(q) for q in queries])
    for q, (_, scores) in zip(queries, found, strict=True):
        assert np.allclose(scores, cosines(index, [x[0] for x in rows], q)[: abuse.K], atol=1e-5)
    assert len(index.nearest([["zzz"]])[0][0]) == 0 and abuse.Index([]).nearest([["a"]])[0][0].size == 0


def test_a_text_never_votes_on_itself():
    r = random.Random(31)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, k=7)) + ". " + " ".join(r.choices(words[:12], k=3)) + "." for _ in range(120)] + ["w1 w2 w3."] * 4
    rows = [(f"k{i}", t, r.randint(0, 1)) for i, t in enumerate(texts)]
    index = abuse.build(rows, (3.0, 2.0))
    for i in range(0, len(rows), 7):
        k, t, y = rows[i]
        other = abuse.build(rows[:i] + [(k, t, 1 - y)] + rows[i + 1 :], (3.0, 2.0))
        mine, flipped = (x.text_votes([t], [k])[0] for x in (index, other))
        assert abs(mine[0] - flipped[0]) < 1e-9 and abs(mine[2] - flipped[2]) < 1e-9
        assert abs(index.text_votes([t], ["unknown"])[0][0] - index.text_votes([t])[0][0]) < 1e-12


def test_abuse_votes_and_spelling():
    bad = [f"shut up you {x}, nobody in {p} wants to hear an {y} whine" for x in ("idiot", "moron", "loser") for y in ("idiot", "creep") for p in ("Wexa", "Kelo", "Tora")]
    good = [f"we tested the {x} with several sellers in {p} during the {y} cut" for x in ("parcel", "refund", "chat") for y in ("power", "price") for p in ("Wexa", "Kelo", "Tora")]
    index = abuse.build([(i, t, int(i < len(bad))) for i, t in enumerate(bad + good)])
    found = index.text_votes(["Shut up you m0r0n, nobody in Zana wants to hear an i-d-i-o-t whine", "We tested the app with several sellers in Zana", None, ""])
    assert index.probability(found[0][0]) > 0.5 > index.probability(found[1][0]) and found[2][0] == found[3][0] == 0.0
    assert abuse.build([]).text_votes(["x"]) == [(0.0, -1, 0.0)]


def test_ppm_code_lengths_by_hand():
    """Order 1 on 'abab': scored byte by byte with plain dictionaries."""
    texts = {"x": ["abab", "abba"], "y": ["zz"]}
    m = PPM(texts, order=1)

    def slow(cls, s):
        data = ("\n".join(["", *texts[cls], ""])).encode()
        total = 0.0
        t = ("\n" + s + "\n").encode()
        for i, b in enumerate(t):
            for k in (1, 0):
                ctx = t[i - k : i] if i >= k else b"\0"
                seen = [data[j] for j in range(k, len(data)) if data[j - k : j] == ctx] if k else list(data)
                if not seen:
                    continue
                n, d = seen.count(b), len(set(seen))
                if n:
                    total += -np.log2(n / (len(seen) + d))
                    break
                total += -np.log2(d / (len(seen) + d))
            else:
                total += 8
        return total

    for s in ("ab", "ba", "zq", "b"):
        # the first byte's context lies in the text before it when several are scored at once
        assert np.allclose(m.score([s])[0], [slow("x", s), slow("y", s)], atol=1e-3), s


@pytest.mark.parametrize("order", [0, 1, 4])
def test_ppm_code_length_of_a_segment_depends_on_nothing_but_the_segment(order):
    m = PPM({"x": ["abab", "abba", "b"], "y": ["zz", "zaz"]}, order=order)
    segments = ["ab", "zz", "", "q", "bab", "zaza", "a"]
    alone = np.concatenate([m.score([s]) for s in segments])
    assert (m.score(segments) == alone).all() and (m.score(segments[::-1])[::-1] == alone).all()


def test_open_addressing_finds_all_and_only():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**62, 5000).astype(np.uint64))
    t = Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_languages_of_mixed_texts():
    en = [f"the {a} was {b} in the town on {c} and nobody knew why" for a in ("parcel", "refund", "loan") for b in ("late", "wrong", "lost") for c in ("Monday", "Friday")]
    hi = [f"मेरा {a} {b} था और मुझे अच्छा नहीं लगा" for a in ("पार्सल", "फ़ोन", "खाना") for b in ("ख़राब", "ग़ायब", "पुराना")]
    model = language.train([("en", t) for t in en] + [("hi", t) for t in hi])
    judge = language.Judge(model)
    used = [sorted(c for c, *_ in language.languages(f)) for f in judge(["the loan was late in the town on Friday and nobody knew why", "मेरा फ़ोन ख़राब था और मुझे अच्छा नहीं लगा", "the loan was late in the town on Friday. मेरा फ़ोन ख़राब था और मुझे अच्छा नहीं लगा", None, "", "123"])]
    assert used == [["en"], ["hi"], ["en", "hi"], [], [], []]


def test_scripts_names_addresses_and_other_languages():
    assert language.segments("मेरा ईमेल divya(at)inbox(dot)test है।") == ["मेरा ईमेल है।"]
    assert language.segments("मेरा नंबर seven five five five zero one है।") == ["मेरा नंबर है।"]
    hi, en = "मेरा सामान अभी तक नहीं मिला मुझे", "the rider never came to my house again"
    assert language.by_script(f"{hi} and {en}") == [hi, f"and {en}"]
    assert language.by_script("है order late") == ["order late"] and language.by_script("order ठीक है बहुत अच्छा") == ["ठीक है बहुत अच्छा"]
    assert language.by_script(hi + " order late") == [hi]
    assert language.unnamed("We met Anna Lindqvist in Rome today") == "We met in today" and language.unnamed("Anna Maria Lindqvist") == "Anna Maria Lindqvist"
    en = [f"the {a} was {b} in the town on {c} and nobody knew why" for a in ("parcel", "refund", "loan") for b in ("late", "wrong", "lost") for c in ("Monday", "Friday")]
    judge = language.Judge(language.train([("en", t) for t in en]))
    got = [language.languages(f)[0][0] for f in judge([en[0], "நேற்று நான் சந்தைக்குச் சென்று காய்கறிகள் வாங்கினேன்", "eilen kävin torilla ostamassa vihanneksia ja tapasin ystävän"])]
    assert got == ["en", "other", "other"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_equals_the_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(60):
        a = [str(r.randint(0, 60)) for _ in range(40)]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            i = r.randrange(len(b))
            r.choice([lambda: b.pop(i), lambda: b.insert(i, "x"), lambda: b.__setitem__(i, "y")])()
        assert overlap.align(a, b) == lcs(a, b)
    assert overlap.align(["a"], ["b"]) == 0


def test_alignment_is_exact_with_repeated_phrases():
    r = random.Random(15)
    for _ in range(400):
        phrase = [str(r.randint(0, 3)) for _ in range(6)]
        a = [str(r.randint(0, 3)) for _ in range(10)]
        for _ in range(3):
            a += [*phrase, *[str(r.randint(0, 40)) for _ in range(8)]]
        b = list(a)
        for _ in range(r.randint(4, 13)):
            i = r.randrange(len(b))
            r.choice([lambda: b.pop(i), lambda: b.insert(i, "x"), lambda: b.__setitem__(i, "y"), lambda: b.insert(r.randrange(len(b)), b.pop(i))])()
        assert overlap.align(a, b) == lcs(a, b)
    assert overlap.align([], ["a"]) == overlap.align(["a"], []) == 0


def winnowed(w, k, window):
    """The least hash of each window of k-grams."""
    h = [hash(tuple(w[i : i + k])) for i in range(max(1, len(w) - k + 1))]
    return {min(h[i : i + window]) for i in range(max(1, len(h) - window + 1))}


@pytest.mark.parametrize("n", [8, 12, 18, 30, 72])
def test_windows_of_fingerprints_lose_pairs_that_the_rarest_words_keep(n):
    r = random.Random(n)
    rarity = np.random.default_rng(0).integers(1, 50, (2, overlap.SKETCH))
    kept, lost, trials = overlap._Hash(), 0, 200
    for _ in range(trials):
        a = [f"w{r.random()}" for _ in range(n)]
        b, e = list(a), n // 6
        for i in range(e):
            b[(i + 1) * n // (e + 1)] = f"x{r.random()}"  # the shared runs are as short as can be
        lost += not winnowed(a, 3, 3) & winnowed(b, 3, 3)
        prefix = [set(overlap._rarest(overlap.hashes(w, kept), rarity, e + 1)[0].tolist()) for w in (a, b)]
        assert prefix[0] & prefix[1]
    assert lost > 0 if n <= 18 else lost < trials


def test_trie_counts():
    r = random.Random(1)
    rows = ["".join(r.choices("ab", k=r.randint(0, 5))) for _ in range(500)]
    trie = Trie()
    for s in rows:
        trie.add(s)[0] += 1
    assert all(trie.add(s)[0] == rows.count(s) for s in set(rows))
    assert canonical("A, b\tC!") == "abc" and canonical(None) is None
    assert canonical_json('{"text": "A b", "label": "x", "source": null, "category": "y"}') == canonical_json('{"category":"Y","source":null,"label":"x","text":"a, B"}')
    assert canonical_json('{"text": "a"') is None and canonical_json("[1]") is None and canonical_json(None) is None


def test_leak_index_by_brute_force():
    r = random.Random(2)
    item = [f"w{i}" for i in range(30)]
    index = leak.Index([(7, " ".join(item)), (8, "too short")])
    for n in range(8, 16):
        doc = [r.choice("xyz") for _ in range(5)] + item[4 : 4 + n] + ["q"] * 3
        assert bool(index.hits("“" + " , ".join(doc).upper() + "”")) == (n >= 12)
    assert index.hits(None) == [] and index.hits("") == []


def test_pieces_cover_overlap_and_fit():
    para = "The parcel was late, so the sellers asked again. नमस्ते दोस्त, यह ठीक है। " * 6
    for text in ("\n\n".join([para] * 12), "x" * 9000, "word " * 3000, "😀" * 1500):
        out = pieces.cut(text, 500, 50)
        assert out[0][0] == 0 and out[-1][1] == len(text) and all(n <= 500 for *_, n in out)
        for (_, b, _), (c, _, _) in zip(out, out[1:], strict=False):
            assert 48 <= len(encode(text[c:b])) <= 60
    assert pieces.cut("", 500, 50) == [] and len(pieces.cut("short", 500, 50)) == 1
    text = "\n\n".join(["The parcel was late, so the sellers asked again. " * 6] * 16)
    assert all(text[:b].endswith("\n\n") for _, b, _ in pieces.cut(text, 500, 50)[:-1])
    with pytest.raises(ValueError):
        pieces.cut("a b", 10, 5)


def test_long_runs_have_the_plain_tokens_and_pieces_stay_within_the_limit():
    r = random.Random(11)
    run = "".join(r.choices("abcdefghijklmnop=-", k=10_000))
    text = "The parcel was late. " * 200 + run + " again and again. " * 300
    assert encode(text) == pieces.encoding().encode_ordinary(text)
    for most, over in ((8, 3), (12, 0), (64, 20), (500, 50)):
        for t in (text, "👩‍👩‍👧" * 60, "ॐ" * 500, run):
            out = pieces.cut(t, most, over)
            assert out[0][0] == 0 and out[-1][1] == len(t) and all(len(encode(t[a:b])) == n <= most for a, b, n in out)
            assert all(a < c <= b < d for (a, b, _), (c, d, _) in zip(out, out[1:], strict=False))
    assert pieces._greedy(text, 64, 20, pieces.DEFAULT)[-1][1] == len(text)


def test_pieces_have_the_least_sum_over_all_boundaries():
    r = random.Random(7)
    most, overlap_ = 40, 4
    texts = ["".join(r.choice(["parcel", "late", "seller", "again", "town", "xqzvkjw"]) + r.choice([" ", " ", " ", ", ", ", ", ". ", "\n", "; "]) for _ in range(r.randint(60, 160))) for _ in range(8)]
    texts += ["".join("late" + (", " if i % 11 == 10 else " ") for i in range(n)) for n in range(60, 76)]  # one cut at a word or two at clauses
    for text in texts:
        ids = encode(text)
        n = len(ids)
        starts = [0, *np.cumsum([len(b) for b in pieces.encoding(pieces.DEFAULT).decode_tokens_bytes(ids)]).tolist()]
        penalty = [pieces.INSIDE] * (n + 1)
        for cost, pattern in pieces.LEVELS:
            for m in pattern.finditer(text):
                i = next((starts.index(c) for c in (m.end(), m.end() - 1, m.start()) if c in starts and 0 < starts.index(c) < n), None)
                if i is not None:
                    penalty[i] = min(penalty[i], cost)
        k = max(2, -(-(n - overlap_) // (most - overlap_)))
        ideal = (n + (k - 1) * overlap_) / k

        def piece(i, j):
            return pieces.IMBALANCE * ((j - max(0, i - overlap_) - ideal) / ideal) ** 2 + (penalty[j] if j < n else 0)

        best = [0.0] + [np.inf] * n
        for j in range(1, n + 1):
            best[j] = min((best[i] + piece(i, j) for i in range(j) if j - max(0, i - overlap_) <= most), default=np.inf)
        ends = [0] + [starts.index(b) for _, b, _ in pieces._plan(text, ids, most, overlap_, pieces.DEFAULT)]
        assert abs(sum(piece(i, j) for i, j in zip(ends, ends[1:], strict=False)) - best[n]) < 1e-9


def test_rake_meets_the_source_marginal():
    g = np.random.default_rng(4)
    x = pd.DataFrame([(s, lang, t, int(g.integers(1, 1000))) for s in "abc" for lang in ("en", "hi") for t in ("p", "q")], columns=["source", "lang", "topic", "tokens"])
    share, cap = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0, "b": 2.0, "c": 4.0}
    w, total = rake(x, share, cap)
    got = (w.weight * w.tokens).groupby(w.source).sum() / total
    assert all(abs(got[s] - share[s]) < 1e-6 for s in share) and all(w.weight <= w.source.map(cap) + 1e-9)
    assert rake(x.iloc[:0], share, cap)[1] == 0.0
    w, total = rake(x, share, {s: 50.0 for s in share}, 500.0, langs={"en": 0.3, "hi": 0.7}, subjects={"p": 0.6})
    got = w.weight * w.tokens / total
    assert abs(got[w.lang == "en"].sum() - 0.3) < 1e-3 and abs(got[w.topic == "p"].sum() - 0.6) < 1e-3 and abs(got[w.source == "a"].sum() - 0.5) < 1e-6


def test_topics_follow_the_words():
    r = random.Random(9)
    groups = [[f" {w}" for w in x.split()] for x in ("parcel courier delivery late order", "bank loan interest account paid", "match goal team player score")]
    texts = [(g, "".join(r.choices(groups[g], k=30)) + " the of and" * 5) for g in (0, 1, 2) for _ in range(20)]
    ids = [encode(t) for _, t in texts]
    docs = [tuple(np.unique(i, return_counts=True)) for i in ids]
    found = Topics([(a, n.astype(np.float32)) for a, n in docs], 50_256, 3)
    names = [found.of(i) for i in ids]
    assert len({(g, n) for (g, _), n in zip(texts, names, strict=True)}) == 3 == len(set(names))
    assert found.of([]) == "t0" and Topics([], 10).of([1]) == "t0"
