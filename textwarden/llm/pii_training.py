"""Trains the tagger of ``pii`` from labelled spans and writes its weights.

    python -m textwarden.llm.pii_training GOLD.parquet OUT.npz [STEPS] [SEED] [WEIGHTS TO GO ON FROM]

The same arguments on the same table give the same weights: nothing depends on time.

Labelled spans come from two sides. ``label`` marks the spans of a bounded sample of
given texts by the formats in which such data is written (training only; the operator
never runs it). ``sentence`` writes new sentences around invented values, among them
names, streets and places that stand in no table, and look-alikes that are no personal
information (order, ticket and transaction numbers, amounts, dates, handles, bare streets).
"""

from __future__ import annotations

import random
import re
import sys
import time

import numpy as np

from .bilstm_crf import KINDS, N_CHARS, TAGS, Tagger, encode, transitions_allowed
from .fold import fold_chars

SAMPLE = 20_000  # most labelled rows that are read
FIRST = "Karan Daniel Imran Manoj Nisha Emma Rahul Fatima Farhan Divya Anita Gopal Priya Amit Meera James Deepa Ayesha Rohan Kavita Sunita Suresh Oliver Arjun Vikram Grace Leela Tara Neha Pooja Maria Lucia Carlos Ravi Anil Sara John Peter Asha Kiran".split()
SURNAMES = "Chalvani Purwethi Ambrotti Ruskeval Oskarwal Dolmaya Torvane Kelmati Wintrescue Brevanti Saroveli Mavelkar Vantrani Hexworthington Tessingdale Zindhari Bhandolkar Yavendra-Moll Nirgodkar Quillaparthi".split()
HI_FIRST = "कविता प्रिया सुरेश सुनीता अर्जुन नेहा विक्रम अनीता रोहन राहुल करण अमित दिव्या मीरा पूजा दीपा गोपाल फ़ातिमा इमरान".split()
HI_SURNAMES = "ज़िंधारी रुस्केवाल वंतरानी मावेलकर पुरवेठी तोरवणे केलमाटी ब्रेवंती ओस्करवाल डोलमाया".split()
STREETS = "Salt Pan Road|Tannery Street|Banyan Cross|Copperkettle Marg|Old Mill Road|Lantern Avenue|Juniper Close|Weavers Court|Peacock Gali|Rosefield Lane".split("|")
STREET_KINDS = "Road Street Cross Marg Avenue Close Court Gali Lane Nagar Colony".split()
HI_STREETS = "मोची मार्ग|पुरानी सड़क|बाज़ार गली|नीम मार्ग|मंदिर मार्ग".split("|")
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
_TLD = r"(?:example|invalid|test|com|org|net|in)"
_STREET = "|".join(map(re.escape, STREETS))
_PLACE = r"[^\W\d_][^\W\d_\u0900-\u097f\u200b]*[\u0900-\u0963\u0970-\u097f]*(?:[^\W\d_]|[\u0900-\u0963\u0970-\u097f])*(?: \d{6}\b)?"
_DOT = r"\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?"
RULES = {
    "email": rf"<?(?P<x>[\w.+-]+(?:\s?(?:@|\(at\)|\[at\])\s?|\sat\s)[a-z0-9]+(?:{_DOT}[a-z]+)*{_DOT}{_TLD}\b)",
    "id_number": r"(?:aadh?aa?r(?: no\.)?:?|uid|आधार(?: नंबर)?|pan(?: card| no\.?)?:?|पैन|passport(?: no\.)?|पासपोर्ट|voter id|वोटर आईडी|वोटर कार्ड|driving licence|लाइसेंस)\s(?P<x>\d{4}[ -]?\d{4}[ -]?\d{4}|[a-z]{5}\d{4}[a-z]|[a-z]\d{7}|[a-z]{3}\d{7}|[a-z]{2}\d\d \d{11})\b",
    "phone": r"(?<![\w/])(?<!ref )(?P<x>(?:tel:)?(?:\+\d\d[ -]?\d{10}|\+\d\d \d{5} \d{5}|\+\d\d \d\d \d{4} \d{4}|\+1[ -]\(?\d{3}\)?[ -]\d{3}-\d{4}|\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{4}\.\d{3}\.\d{3}|\d{5} \d{5}|[0०]?\d{10}|\d(?: \d){9}|(?:(?:zero|one|two|three|four|five|six|seven|eight|nine)\b ?){9,11}(?<! )))(?![\w/])",
    "address": rf"(?P<x>h\.no\. ?\d+/\d+, sector \d+, {_PLACE}|plot no \d+, \d\w\w cross, (?:{_STREET}), {_PLACE}|flat \d+[a-z], \d+ (?:{_STREET}), {_PLACE}|\d+,? (?:{_STREET}),? ?(?:apt \d+, )?[\n]?{_PLACE}|house \d+ (?:{_STREET}),? {_PLACE}|मकान नंबर \d+, गली \d+, {_PLACE}|फ़्लैट \d+, सेक्टर \d+, {_PLACE}|फ़्लैट \d+, सेक्टर \d+, {_PLACE}|\d+ (?:{'|'.join(HI_STREETS)}), {_PLACE})",
}
_S = "|".join([*SURNAMES, *HI_SURNAMES])
_F = "|".join([*FIRST, *HI_FIRST])
RULES["person_name"] = rf"(?<![\w.@+])(?P<x>(?:(?:dr|mr|mrs|ms|smt|shri)\.? )?(?:(?:{_F}) )?(?:[a-z]\. )?(?:{_S})(?:, (?:{_F})(?:\s[a-z]\.)?)?)(?![\w@+]|\.\w|\s?\(at\)|\s?\[at\]|\sat\s\w+\s?dot)"
RULES = {k: re.compile(v, re.I) for k, v in RULES.items()}
BARE_ID = re.compile(r"(?<![\w/])(\d{4}[ -]\d{4}[ -]\d{4}|\d{12}|[A-Z]{5}\d{4}[A-Z]|[A-Z]\d{7}|[A-Z]{3}\d{7}|[A-Z]{2}\d\d \d{11})(?!\w)", re.I)


def label(text: str) -> list[tuple[int, int, str]]:
    """Spans of a text, by format. Text is folded, with invisible characters skipped."""
    kept = [i for i, c in enumerate(fold_chars(text)) if c != "​"]
    folded = fold_chars(text)
    s = "".join(folded[i] for i in kept)
    found = []
    for kind in ("email", "id_number", "address", "person_name", "phone"):
        for m in RULES[kind].finditer(s):
            found.append((m.start("x"), m.end("x"), kind))
    values = {re.sub(r"\W", "", s[a:b]).lower() for a, b, k in found if k == "id_number"}
    for m in BARE_ID.finditer(s):
        if re.sub(r"\W", "", m[1]).lower() in values or re.search(r"[A-Za-z]", m[1]):
            found.append((m.start(), m.end(), "id_number"))
    out, taken = [], np.zeros(len(s) + 1, bool)
    for a, b, k in found:
        if not taken[a:b].any() and not re.search(r"(?:ref|txn|order|ऑर्डर|order no|transaction) ?(?:no|नंबर|id)? ?$", s[max(0, a - 16) : a].lower()):
            taken[a:b] = True
            out.append((kept[a], kept[b - 1] + 1, k))
    return sorted(out)


def invented(r: random.Random) -> str:
    c = "b bh br ch d dh dr f g gr h j k kl l m n p pr r s sh st t th tr v w y z".split()
    v = "a e i o u aa ee ai ou".split()
    return "".join(r.choice(c) + r.choice(v) for _ in range(r.randint(1, 3))).capitalize() + r.choice("n r l sh m nd rt ll ni kar wal son ton ya rez ti x di gar".split())


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def value(r: random.Random, kind: str, hindi: bool) -> str:
    d = lambda n: digits(r, n)
    place = invented(r) + r.choice("ville pur nagar ganj bad ford stead wick dale ton mere ra".split())
    if kind == "email":
        f, s = r.choice(FIRST + [invented(r)]).lower(), r.choice([*SURNAMES, invented(r), invented(r)]).lower().replace("-", "")
        local = r.choice([f + s, f"{f}.{s}", f"{f}_{d(3)}", f"{s}+{f}", f[0] + s + d(2), f + d(4), f"{f}-{s}"])
        host = r.choice(["mailbox.example", "webmail.invalid", "box.test", "post.example", "letters.example.com", "homepost.example.org", "inbox.test", invented(r).lower() + r.choice([".example", ".test", ".com", ".org", ".in"])])
        at, dot = r.choice([("@", ".")] * 5 + [("(at)", "(dot)"), (" [at] ", "."), (" at ", " dot "), (" @ ", "."), ("(at)", ".")])
        return r.choice([str, str, str, str.upper])(local + at + host.replace(".", dot))
    if kind == "phone":
        a = d(3)
        return r.choice([r.choice("6789") + d(9), d(10), "0" + d(10), f"{d(5)} {d(5)}", f"+91 {d(5)} {d(5)}", f"+91-{d(10)}", f"+91 {d(2)} {d(4)} {d(4)}", f"({a}) {d(3)}-{d(4)}", f"{a}-{d(3)}-{d(4)}", f"{d(4)}.{d(3)}.{d(3)}", "tel:" + d(10), " ".join(d(10)), " ".join(DIGIT_WORDS[int(x)] for x in d(10)), " ".join(DIGIT_WORDS[int(x)] for x in d(10)), f"+1 {a} {d(3)} {d(4)}", f"+91{d(10)}", f"{a} {d(3)} {d(4)}"])
    if kind == "id_number":
        cap = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        aadhaar = r.choice([d(12), f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}"])
        pairs = [(r.choice(["aadhaar", "aadhar:", "Aadhaar no.", "UID"]), aadhaar)] * 3 + [(r.choice(["PAN", "PAN card", "pan no."]), cap(5) + d(4) + cap(1)), (r.choice(["passport", "passport no."]), cap(1) + d(7)), (r.choice(["voter id", "voter card"]), cap(3) + d(7)), (r.choice(["driving licence", "licence no."]), f"{cap(2)}{d(2)} {d(11)}"), ("SSN", f"{d(3)}-{d(2)}-{d(4)}")]
        if hindi:
            pairs = [("आधार नंबर", aadhaar), ("पासपोर्ट", cap(1) + d(7)), ("पैन", cap(5) + d(4) + cap(1)), ("वोटर आईडी", cap(3) + d(7)), ("लाइसेंस", f"{cap(2)}{d(2)} {d(11)}")]
        k, v = r.choice(pairs)
        return k + " {" + r.choice([str, str, str, str.lower])(v) + "}" if r.random() < 0.75 else "{" + v + "}"
    if kind == "address":
        street = r.choice(STREETS + [f"{invented(r)} {r.choice(STREET_KINDS)}", f"{invented(r)} {invented(r)} {r.choice(STREET_KINDS)}"])
        n = str(r.randint(1, 400))
        if hindi:
            return r.choice([f"मकान नंबर {n}, गली {d(1)}, {{p}}", f"फ़्लैट {n}, सेक्टर {d(2)}, {{p}}", f"{n} {r.choice(HI_STREETS)}, {{p}}"]).replace("{p}", r.choice(["बेलरीडेल", "तमदूकोट", "नोररीपुर", "यूलमोगंज", "रामनगर", "कावागढ़"]))
        return r.choice([str, str, str, str, str.lower])(r.choice([f"H.No. {n}/{d(1)}, Sector {d(2)}, {place}", f"{n} {street}, Apt {d(2)}, {place}", f"plot no {n}, {r.choice(['1st', '2nd', '3rd', '5th'])} cross, {street}, {place}", f"Flat {d(1)}{r.choice('ABCD')}, {n} {street}, {place} {d(6)}", f"{n}, {street}\n{place}", f"house {n} {street} {place}", f"{n} {street} {place}", f"Flat {n}, Sector {d(2)}, {place}"]))
    if hindi:
        return f"{r.choice(HI_FIRST)} {r.choice(HI_SURNAMES + ['सरोवेली', 'भंडोलकर', 'चलवानी', 'निरगोडकर', 'गुप्तेवाल', 'रामठेकर'])}"
    f, s = r.choice(FIRST), r.choice(SURNAMES + [invented(r)] * 30)
    return r.choice([str] * 5 + [str.upper, str.lower])(r.choice([f"{f} {s}", f"{f} {s}", f"{f} {r.choice('ABKRSM')}. {s}", f"{s}, {f}", f"{r.choice(['Mr', 'Mrs', 'Ms', 'Dr'])} {s}"]))


CARRIERS = {
    "email": ("Mail me at {}.|reach out on {} please.|cc {}|Contact: {}|My login was {} until today.|{}.|write to <{}> please|meri mail id {} hai.|{} pe bhej dena.|mujhe {} par mail karo.|meri mail id <{}> hai.|email: {}", "मेरा ईमेल {} है।|{} पर लिखिए।|<{}> पर लिखिए।"),
    "phone": ("Call me on {} after six.|My number is {}.|Text {} when done.|ring {}, thanks.|whatsapp {}|whatsapp karo {}|{} par call karna.|mera number {} hai.|{}.|Phone: {}|reach my cell {} tonight", "{} पर कॉल करें।|मेरा नंबर {} है।"),
    "id_number": ("KYC failed for {}.|I already sent my {}.|Here it is: {}.|{} is what the form shows.|{} se KYC nahi hua.|mera {} hai, dekh lo.|{}.|mera {} hai.|my {} was rejected", "मेरा {} है।|{} से केवाईसी नहीं हुआ।"),
    "address": ("Deliver it to {}.|The rider never came to {}.|I live at {}.|pickup from {} please.|ghar ka pata {} hai.|{} par bhej do.|{}.|send the bill to {} please|we moved to {} last week", "मेरा पता {} है।|{} पर भेज दीजिए।|{} पर भेज दो।|{}।"),
    "person_name": ("My name is {}.|please ask {} to reply.|I spoke with {} yesterday.|The agent {} hung up on me.|Regards, {}|mera naam {} hai.|{} se baat hui thi.|{}.|{} called twice about it|signed by {} at noon", "मेरा नाम {} है।|{} से बात हुई थी।"),
}
NEGATIVES = (
    "kul {n} rupaye lage.|order no {4}-{4} abhi tak khula hai.|OTP {6} kaam nahi kiya.|Follow us @{w}_help for news.|{4}-{4}-{2} is still open.|Transaction ref {12} shows as failed.|Transaction ref {10} shows as failed.|Use coupon SAVE{4} at checkout.|Ticket TKT-{6} was closed.|It happened on {2}/{2}/{4} at {1}:{2}.|The {W} office near {S} is closed.|My login was {F}.|Order {4}-{4}-{2} is still open.|Update to version {1}.{2}.{3} failed.|the {W} branch in {W} merged {2} old complaints|{F} from {W} said so.|Order no {10} is late.|tracking id {12} not found|{W} Bazaar is open.|txn id {10} pending|Total {n} rupees were charged.|My nurse {F} assists.|They moved {S} traffic.|login was {f}_{3}.|ticket {6} band hua.|See page {3}, section {2}.|invoice INV{7} is due.|Code {8} expired.|user {f}{4} blocked me.|I was billed Rs {5} twice.|get {5} rupees on {W}",
    "टिकट {6} बंद हुआ।|ऑर्डर नंबर {4} {4} खुला है।|कुल {n} रुपये लगे।|ओटीपी {6} काम नहीं किया।|{2}/{2}/{4} को हुआ।|ट्रांज़ैक्शन {12} असफल दिख रहा है।",
)


def sentence(r: random.Random, hindi: bool) -> tuple[str, list[tuple[int, int, str]]]:
    if r.random() < 0.4:
        t = r.choice(NEGATIVES[hindi].split("|"))
        t = re.sub(r"\{(\d+)\}", lambda m: digits(r, int(m[1])), t).replace("{n}", r.choice(["{:,}".format(r.randint(20, 99999)), str(r.randint(20, 9999))]))
        for k, f in (("{w}", lambda: invented(r).lower()), ("{W}", lambda: invented(r)), ("{S}", lambda: r.choice([*STREETS, f"{invented(r)} {r.choice(STREET_KINDS)}"])), ("{F}", lambda: r.choice([str, str.upper])(r.choice(FIRST))), ("{f}", lambda: r.choice(FIRST).lower())):
            while k in t:
                t = t.replace(k, f(), 1)
        return t, []
    kind = r.choice(KINDS)
    v = value(r, kind, hindi)
    c = r.choice(CARRIERS[kind][hindi].split("|"))
    a = c.index("{}")
    t = c.replace("{}", v)
    lo, hi = (t.index("{"), t.index("}")) if "{" in v else (a, a + len(v))
    t = t.replace("{", "").replace("}", "")
    return t, [(lo, hi - ("{" in v), kind)]


def example(r: random.Random, rows: list[tuple[str, list]], clean: list[str], clean_hi: list[str]) -> tuple[str, list]:
    if r.random() < 0.45:
        text, sp = r.choice(rows)
        if r.random() < 0.5:  # other names in the same places
            for a, b, k in sorted(sp, reverse=True):
                if k == "person_name" and text[a:b].isascii():
                    new = value(r, k, False)
                    text = text[:a] + new + text[b:]
                    sp = [(x + (len(new) - b + a) * (x >= b), y + (len(new) - b + a) * (y >= b), z) for x, y, z in sp]
    else:
        hindi = r.random() < 0.25
        text, sp = "", []
        for _ in range(r.randint(1, 4)):
            s, more = sentence(r, hindi) if r.random() < 0.65 else (r.choice(clean_hi if hindi else clean), [])
            if text:
                text += r.choice([" ", " ", " ", "  ", "\n"])
            sp += [(a + len(text), b + len(text), k) for a, b, k in more]
            text += s
    if r.random() < 0.12:
        text = r.choice([str.upper, str.lower])(text) if len(text.upper()) == len(text) == len(text.lower()) else text
    if r.random() < 0.04:
        text = text.translate({48 + i: 0x966 + i for i in range(10)})
    if r.random() < 0.08:
        at = sorted(r.sample(range(len(text)), min(len(text), r.randint(1, 6))), reverse=True)
        for i in at:
            text = text[:i] + "​" + text[i:]
            sp = [(a + (a >= i), b + (b > i), k) for a, b, k in sp]
    return text, sp


def train(rows: list[str], out: str, steps: int = 4000, hidden: int = 48, emb: int = 24, seed: int = 7, init: str = "") -> None:
    r, g = random.Random(seed), np.random.default_rng(seed)
    r.shuffle(rows)
    rows = rows[:SAMPLE]
    labelled = [(t, label(t)) for t in rows]
    sentences = [s for t, sp in labelled if not sp for s in re.split(r"(?<=[.!?।])\s+", t) if not re.search(r"\d{4}|@", s)]
    clean, clean_hi = [s for s in sentences if not re.search("[ऀ-ॿ]", s)], [s for s in sentences if re.search("[ऀ-ॿ]", s)]
    e1, k = emb + 1, len(TAGS)
    w = {"emb": g.normal(0, 0.3, (N_CHARS, emb)), "wx": g.normal(0, e1**-0.5, (2, e1, 4 * hidden)), "wh": g.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)), "b": np.zeros((2, 4 * hidden)), "wo": g.normal(0, 0.1, (2 * hidden, k)), "bo": np.zeros(k), "trans": np.zeros((k, k))}
    w = {n: x.astype(np.float32) for n, x in w.items()}
    w["b"][:, hidden : 2 * hidden] = 1
    if init:  # go on from earlier weights, in smaller steps
        with np.load(init) as z:
            w = {n: z[n].astype(np.float32) for n in w}
    allowed = transitions_allowed()
    m1, m2 = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}
    length, batch, began, loss_avg = 112, 64, time.time(), 0.0
    for step in range(steps):
        ids, tags, mask = np.zeros((batch, length), np.int32), np.zeros((batch, length), np.int8), np.zeros((batch, length), np.float32)
        for i in range(batch):
            text, sp = example(r, labelled, clean, clean_hi)
            lo = 0
            if len(text) > length:
                lo = r.randint(0, len(text) - length)
                if sp and r.random() < 0.8:
                    lo = max(0, min(len(text) - length, sp[r.randrange(len(sp))][0] - r.randint(0, length // 2)))
            y = np.zeros(len(text), np.int8)
            for a, b, kind in sp:
                y[a:b] = TAGS.index(f"I-{kind}")
                y[a] = TAGS.index(f"B-{kind}")
            x, y = encode(text)[lo : lo + length], y[lo : lo + length]
            if len(y) and TAGS[y[0]][0] == "I":  # a span that begins before the crop
                y[0] -= 1
            ids[i, : len(x)], tags[i, : len(y)], mask[i, : len(x)] = x, y, 1
        loss, grad = _loss(w, ids, tags, mask, allowed, hidden)
        norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
        lr = (1.5e-3 if init else 3e-3) * min(1, (step + 1) / 100) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.01)
        for n in w:
            x = grad[n] * min(1, 5 / (norm + 1e-9))
            m1[n] = 0.9 * m1[n] + 0.1 * x
            m2[n] = 0.99 * m2[n] + 0.01 * x * x
            w[n] -= (lr * (m1[n] / (1 - 0.9 ** (step + 1))) / (np.sqrt(m2[n] / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)
        loss_avg = loss if not step else 0.98 * loss_avg + 0.02 * loss
        if step % 100 == 0:
            print(step, round(loss_avg, 4), round(time.time() - began), flush=True)
            np.savez(out, **{n: x.astype(np.float16) for n, x in w.items()})
    np.savez(out, **{n: x.astype(np.float16) for n, x in w.items()})


def _loss(w, ids, tags, mask, allowed, hidden):
    """CRF negative log likelihood per character and its gradients."""
    n, length = ids.shape
    ch, cap = ids // 2, (ids % 2).astype(np.float32)
    x = np.concatenate([w["emb"][ch], cap[..., None]], -1)  # n, L, e
    xs = np.stack([x, x[:, ::-1]])  # 2, n, L, e
    zx = np.einsum("dnle,deh->ldnh", xs, w["wx"], optimize=True) + w["b"][None, :, None]
    h, c = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
    hs, cs, gates, tcs = [h], [c], [], []
    for t in range(length):
        z = zx[t] + h @ w["wh"]
        s, g = 0.5 * np.tanh(0.5 * z[..., : 3 * hidden]) + 0.5, np.tanh(z[..., 3 * hidden :])
        c = s[..., hidden : 2 * hidden] * c + s[..., :hidden] * g
        tc = np.tanh(c)
        h = s[..., 2 * hidden :] * tc
        real = (ids[:, length - 1 - t] > 0)[:, None]  # as in the tagger: padding leaves no trace
        h[1] *= real
        c[1] *= real
        hs.append(h), cs.append(c), gates.append((s, g)), tcs.append(tc)
    seq = np.stack(hs[1:])  # L, 2, n, h
    both = np.concatenate([seq[:, 0], seq[::-1, 1]], -1)  # L, n, 2h
    emit = both @ w["wo"] + w["bo"]
    trans = np.where(allowed, w["trans"], np.float32(-1e4))
    start = np.array([0 if t[0] != "I" else -1e4 for t in TAGS], np.float32)
    y, m = tags.T.astype(int), mask.T
    alpha = np.zeros_like(emit)
    alpha[0] = emit[0] + start

    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    for t in range(1, length):
        new = lse(alpha[t - 1][:, :, None] + trans, 1) + emit[t]
        alpha[t] = np.where(m[t][:, None] > 0, new, alpha[t - 1])
    beta = np.zeros_like(emit)
    for t in range(length - 2, -1, -1):
        new = lse(trans[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(m[t + 1][:, None] > 0, new, beta[t + 1])
    logz = lse(alpha[-1], 1)
    rows = np.arange(n)
    gold = np.stack([emit[t][rows, y[t]] * m[t] for t in range(length)]).sum(0) + sum(trans[y[t - 1], y[t]] * m[t] for t in range(1, length))
    total = m.sum()
    loss = float((logz - gold).sum() / total)
    d_emit = np.exp(alpha + beta - logz[None, :, None]) * m[..., None]
    for t in range(length):
        d_emit[t][rows, y[t]] -= m[t]
    d_trans = np.zeros_like(trans)
    for t in range(1, length):
        p = np.exp(alpha[t - 1][:, :, None] + trans + (emit[t] + beta[t])[:, None, :] - logz[:, None, None]) * m[t][:, None, None]
        d_trans += p.sum(0)
        np.subtract.at(d_trans, (y[t - 1], y[t]), m[t])
    d_emit /= total
    grad = {"trans": np.where(allowed, d_trans / total, 0).astype(np.float32), "wo": both.reshape(-1, 2 * hidden).T @ d_emit.reshape(-1, emit.shape[-1]), "bo": d_emit.sum((0, 1))}
    d_both = d_emit @ w["wo"].T
    d_seq = np.stack([d_both[..., :hidden], d_both[::-1, :, hidden:]], 1)
    dz_all = np.zeros_like(zx)
    dh, dc = np.zeros_like(h), np.zeros_like(c)
    grad["wh"] = np.zeros_like(w["wh"])
    for t in range(length - 1, -1, -1):
        (s, g), tc = gates[t], tcs[t]
        dh = dh + d_seq[t]
        real = (ids[:, length - 1 - t] > 0)[:, None]
        dh[1] *= real
        dc[1] *= real
        i, f, o = s[..., :hidden], s[..., hidden : 2 * hidden], s[..., 2 * hidden :]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cs[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], -1)
        dz_all[t] = dz
        grad["wh"] += hs[t].transpose(0, 2, 1) @ dz
        dh, dc = dz @ w["wh"].transpose(0, 2, 1), dc * f
    grad["wx"] = np.einsum("dnle,ldnh->deh", xs, dz_all, optimize=True)
    grad["b"] = dz_all.sum((0, 2))
    dx = np.einsum("ldnh,deh->dnle", dz_all, w["wx"], optimize=True)
    d = dx[0] + dx[1][:, ::-1]
    grad["emb"] = np.zeros_like(w["emb"])
    np.add.at(grad["emb"], ch, d[..., :-1])
    return loss, grad


def main(path: str, out: str, steps: str = "4000", seed: str = "7", init: str = "") -> None:
    import pyarrow.parquet as pq

    t = pq.read_table(path, columns=["id", "text"]).to_pandas().drop_duplicates("id")
    train(t.text.dropna().tolist(), out, int(steps), seed=int(seed), init=init)


if __name__ == "__main__":
    main(*sys.argv[1:])


__all__ = ["Tagger", "label", "train"]
