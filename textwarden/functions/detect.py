"""Detections as Catalyst expressions: no UDF, spans in code points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import fixed_values as V
from ..rules.literals import needs
from ..rules.packs import FINANCE, INJECTION, PII, SEVERITIES, TOXIC, Rule

DETECTION = "array<struct<category:string,severity:string,confidence:double,matched_text:string,start_pos:int,end_pos:int,explanation:string,detector:string>>"


def empty() -> Column:
    return F.array().cast(DETECTION)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda, whatever is not bound is computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<m, s, e>>: every match (its group), and the whole match's code-point offsets, end excluded.

    One pass over the gaps between the matches; the last gap has no match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wanted = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("g"), whole.alias("w"), wanted.alias("m"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["w"])
        return F.when(x["w"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))).alias("out")))

    return F.aggregate(parts, state, step, lambda acc: acc["out"])


# The packs are built as SQL text: one call for a pack instead of one for each of its thousands of nodes.
_EMPTY = f"cast(array() AS {DETECTION})"


def quote(x: str) -> str:
    """A SQL string literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def java(pattern: str) -> str:
    return "(?iU)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern


def _contains_sql(low: str, parts: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {quote(p)})" for p in parts) + ")"


def hit_sql(text: str, low: str, pattern: str) -> str:
    """Whether an ignore-case pattern matches; the pattern runs only where one of its words stands."""
    words_ = needs(pattern) if pattern.startswith("(?i)") else ()
    found = f"rlike({text}, {quote(java(pattern))})"
    return f"({_contains_sql(low, words_)} AND {found})" if words_ else found


def hit_expr(text: str, low: str, pattern: str) -> Column:
    """As ``hit_sql``."""
    return F.expr(hit_sql(text, low, pattern))


def spans_sql(text: str, pattern: str, group: int = 0) -> str:
    """As ``spans``."""
    p = quote(pattern)
    zipped = f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}))"
    state = "named_struct('at', 0, 'out', cast(array() AS array<struct<m:string,s:int,e:int>>))"
    s, e = "acc.at + length(x.`0`)", "acc.at + length(x.`0`) + length(x.`1`)"
    return f"aggregate({zipped}, {state}, (acc, x) -> if(x.`1` IS NULL, acc, named_struct('at', {e}, 'out', concat(acc.out, array(named_struct('m', x.`2`, 's', {s}, 'e', {e}))))), acc -> acc.out)"


def _detection_sql(rule: Rule, m: str, s: str, e: str, explanation: str | None = None) -> str:
    return f"named_struct('category', {quote(rule.category)}, 'severity', {quote(rule.severity)}, 'confidence', {rule.confidence}D, 'matched_text', {m}, 'start_pos', cast({s} AS int), 'end_pos', cast({e} AS int), 'explanation', {quote(explanation or rule.explanation)}, 'detector', {quote(rule.detector)})"


def _keep_first_sql(found: str, same: str) -> str:
    return f"aggregate({found}, {_EMPTY}, (acc, x) -> if(exists(acc, y -> {same}), acc, concat(acc, array(x))))"


# What every match of the case-sensitive rules holds, as cheap tests on the text.
_GATES = {
    "pii_phone": r"(?U)\d[\d\s().-]{7,}\d", "pii_credit_card": r"(?U)\d[\d\s-]{12,}\d", "pii_ssn": r"(?U)\d[\d\s-]{7,}\d", "pii_aadhaar": r"(?U)\d[\d\s-]{10,}\d",
    "pii_bank_account": r"(?U)\d{9}", "pii_pan": "[A-Z]{5}", "pii_ifsc": "[A-Z]{4}0", "pii_gst": "[A-Z]{5}", "pii_demat": "IN[A-Z0-9]{6}", "pii_ip_address": r"(?U)\d\.\d{1,3}\.\d",
}
_WORDS = ("sk-", "AKIA", "ghp_", "gsk_", "rzp_")


def pii_hit_sql(text: str, low: str, rule: Rule) -> str:
    found = f"rlike({text}, {quote(rule.java)})"
    if rule.category in ("pii_email", "pii_upi"):  # no left boundary: would try every position
        return f"(contains({text}, '@') AND {found})"
    if rule.category in _GATES:
        return f"(rlike({text}, {quote(_GATES[rule.category])}) AND {hit_sql(text, low, rule.pattern)})"
    word = next((w for w in _WORDS if w in rule.pattern), None)
    return f"(contains({text}, {quote(word)}) AND {found})" if word else hit_sql(text, low, rule.pattern)


_FOLDED, _TO = "ſıİ\u212a", "siik"


def low_sql(text: str) -> str:
    """Lower case as ignore-case patterns see it: the letters that fold to an ASCII letter are that letter. Few texts hold one, and only
    those are translated letter by letter."""
    return f"lower(if({_contains_sql(text, _FOLDED)}, translate({text}, '{_FOLDED}', '{_TO}'), {text}))"


def low_text(text: Column) -> Column:
    """The text in which the rules' words are searched; callers that run several packs keep it as a column. As ``low_sql``."""
    return F.lower(F.when(_contains_any(text, _FOLDED), F.translate(text, _FOLDED, _TO)).otherwise(text))


def keep_first(found: Column, same) -> Column:
    """Drops what repeats an earlier entry (``same(x, y)``)."""
    return F.aggregate(found, empty(), lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


_UPI = next(r for r in PII if r.category == "pii_upi")


def pii_all(text: str, categories: Sequence[str] | None = None, rules: Sequence[Rule] = PII, low: str | None = None) -> Column:
    """Every match of the personal-data rules in rule order, repeats included; phones inside a payment handle left out.

    ``text`` and ``low`` (the lower-case text) name columns.
    """
    low = low or low_sql(text)
    handles = f"if(contains({text}, '@'), {spans_sql(text, _UPI.java)}, cast(array() AS array<struct<m:string,s:int,e:int>>))"
    parts = []
    for r in rules:
        if categories and r.category not in categories:
            continue
        found = f"filter({spans_sql(text, r.java, r.group)}, x -> length(x.m) >= 4)"
        if r.category == "pii_phone":  # the handles are computed once, not per match
            found = f"get(transform(array({handles}), h -> filter({found}, x -> NOT exists(h, u -> x.s >= u.s AND x.e <= u.e))), 0)"
        if r.category == "pii_bank_account":
            found = f"filter({found}, x -> NOT (length(x.m) = 10 AND rlike(x.m, '^[6-9]')))"
        parts.append(f"if({pii_hit_sql(text, low, r)}, transform({found}, x -> {_detection_sql(r, 'x.m', 'x.s', 'x.e')}), {_EMPTY})")
    return F.expr(f"flatten(array({', '.join(parts)}))") if parts else empty()


def pii(text: str, categories: Sequence[str] | None = None) -> Column:
    """``pii_all`` without repeats of one (category, matched text)."""
    return keep_first(pii_all(text, categories), lambda x, y: (x["category"] == y["category"]) & (x["matched_text"] == y["matched_text"]))


def first_per_category(text: str, rules: Sequence[Rule], low: str | None = None) -> Column:
    """The first match of each rule, in the order that the pack prescribes, then the first entry of each category."""
    low = low or low_sql(text)
    parts = []
    for r in rules:
        p = quote(r.java)
        start, m = f"length(get(split({text}, {p}, 2), 0))", f"regexp_extract({text}, {p}, 0)"
        parts.append(f"if({hit_sql(text, low, r.pattern)}, array({_detection_sql(r, m, start, f'{start} + length({m})')}), {_EMPTY})")
    return F.expr(_keep_first_sql(f"flatten(array({', '.join(parts)}))", "x.category = y.category"))


def injection(text: str, low: str | None = None) -> Column:
    return first_per_category(text, INJECTION, low)


def finance(text: str, low: str | None = None) -> Column:
    """Ordered by the severity's name from z to a; equal names keep the rules' order."""
    return first_per_category(text, sorted(FINANCE, key=lambda r: r.severity, reverse=True), low)


def keyword(text: str, low: str | None = None) -> Column:
    """The first toxic rule that matches anywhere decides; its span is the whole text."""
    low = low or low_sql(text)
    whens = " ".join(f"WHEN {hit_sql(text, low, r.pattern)} THEN array({_detection_sql(r, f'substring({text}, 1, 100)', '0', f'length({text})', '[KEYWORD] ' + r.explanation)})" for r in TOXIC)
    return F.expr(f"CASE {whens} ELSE {_EMPTY} END")


def _contains_any(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def safe_phrase(text: Column) -> Column:
    low = strip(F.lower(text))
    return _contains_any(low, V.SAFE_PHRASES_EN) | (_contains_any(low, V.SAFE_PHRASES_HI) & ~_contains_any(low, V.SLURS_HI))


def safe_hindi(text: Column) -> Column:
    low = strip(F.lower(text))
    return _contains_any(low, V.SAFE_PHRASES_HI) & ~_contains_any(low, V.SLURS_HI_CHECK)


def gibberish(text: Column) -> Column:
    """Fewer than two characters, or one word without enough vowels, with a tripled character or four consonants in a row."""
    low = strip(F.lower(text))
    w = F.get(words(low), F.lit(0))
    vowels = F.length(F.regexp_replace(w, "[^aeiou]", "")) / F.greatest(F.length(w), F.lit(1))
    odd = (F.size(words(low)) == 1) & (F.length(w) > 3) & ((vowels < 0.15) | w.rlike(r"(.)\1\1") | w.rlike(r"[\p{L}&&[^aeiou]]{4}"))
    return (F.length(low) < 2) | F.coalesce(odd, F.lit(False))


def dynamic_threshold(text: Column, base: float = 0.7) -> Column:
    """Short texts need a higher score."""
    n = F.size(words(text))
    return F.when(n <= 3, 0.85).when(n <= 6, 0.80).when(n <= 12, 0.75).otherwise(base)


def escalation(text: str, learned: Sequence[tuple[str, str]] = (), low: str | None = None) -> Column:
    """struct<escalate, reason, confidence, names>: whether a text needs the slow check."""
    low = low or low_sql(text)
    found = "array_compact(array(" + ", ".join(f"if({hit_sql(text, low, p)}, {quote(n)}, NULL)" for n, p in [*V.SUSPICIOUS, *learned]) + "))"
    result = lambda e, r, c, n="cast(array() AS array<string>)": f"named_struct('escalate', {e}, 'reason', '{r}', 'confidence', {c}, 'names', {n})"
    count = f"size(filter(split({text}, {quote('(?U)' + chr(92) + 's+')}), w -> w <> ''))"
    open_ = f"get(transform(array({found}), f -> CASE WHEN size(f) > 0 THEN {result('true', 'suspicious', 'least(0.95D, 0.6D + 0.1D * size(f))', 'array_sort(array_distinct(f))')} WHEN {count} < 5 THEN {result('false', 'short_text', '0.8D')} ELSE {result('false', 'no_indicators', '0.7D')} END), 0)"
    return F.expr(f"if({' OR '.join(hit_sql(text, low, p) for p in V.CLEARLY_SAFE)}, {result('false', 'clearly_safe', '0.95D')}, {open_})")


def merged(found: Column) -> Column:
    """array<struct<s, e>>: spans by start, those that overlap joined."""
    by_start = F.array_sort(F.transform(found, lambda d: F.struct(d["start_pos"].alias("s"), d["end_pos"].alias("e"))))
    kind = "array<struct<s:int,e:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] < last["e"], joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(by_start, F.array().cast(kind), step)


def redact(text: Column, found: Column, replacement: str = "[REDACTED]", compat: str = "fixed") -> Column:
    """The text with each found span replaced.

    ``fixed``: overlapping spans are joined first. ``strict``: spans are spliced from the
    last to the first with their own offsets, even if they overlap.
    """
    rep = F.lit(replacement)
    if compat == "strict":
        order = F.array_sort(F.transform(found, lambda d, i: F.struct((-d["start_pos"]).alias("k"), i.alias("i"), d["start_pos"].alias("s"), d["end_pos"].alias("e"))))
        return F.aggregate(order, text, lambda acc, d: F.concat(F.substring(acc, F.lit(1), d["s"]), rep, F.substring(acc, d["e"] + 1, F.length(acc))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(merged(found), state, lambda acc, d: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, d["s"] - acc["at"]), rep).alias("out"), d["e"].alias("at")))
    return let(done, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))


def sanitize(text: Column, most: int = 10_000) -> Column:
    """struct<text, removed>: truncated, without control characters, markers neutralised, long runs collapsed."""
    clean = lambda t: F.translate(t, "".join(V.SANITIZE_CHARS), "")
    cut = F.substring(text, 1, most)
    first = F.array_compact(F.array(F.when(F.length(text) > most, F.lit("truncated")), F.when(clean(cut) != cut, F.lit("suspicious_chars"))))
    state = F.struct(clean(cut).alias("t"), first.alias("r"))
    for p, rep in V.SANITIZE:
        state = let(state, _neutralise("(?iU)" + p[4:] if p.startswith("(?i)") else p, rep))
    done = lambda s: F.struct(F.regexp_replace(F.regexp_replace(s["t"], "\n{4,}", "\n\n\n"), " {4,}", "   ").alias("text"), F.array_sort(F.array_distinct(s["r"])).alias("removed"))
    return let(state, done)


def _neutralise(pattern: str, replacement: str):
    return lambda s: F.struct(F.regexp_replace(s["t"], pattern, replacement).alias("t"), F.when(s["t"].rlike(pattern), F.concat(s["r"], F.array(F.lit(replacement)))).otherwise(s["r"]).alias("r"))


def sanitize_flags(text: Column) -> Column:
    """Which markers a text holds, as they are (sorted, distinct)."""
    parts = [F.when(text.rlike("(?iU)" + p[4:] if p.startswith("(?i)") else p), F.lit(rep)) for p, rep in V.SANITIZE]
    parts += [F.when(text.contains(c), F.lit(f"char_{ord(c):04x}")) for c in V.SANITIZE_CHARS]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*parts))))


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def mask(value: Column) -> Column:
    """First and last two characters kept; short values hidden."""
    n = F.length(value)
    return F.when(n <= 4, F.lit("***")).otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2))))


def mask_ip(ip: Column) -> Column:
    """Two octets kept; anything else cut to ten characters."""
    p = F.split(ip, r"\.")
    return F.when(F.size(p) == 4, F.concat(F.get(p, F.lit(0)), F.lit("."), F.get(p, F.lit(1)), F.lit(".*.*"))).when(F.length(ip) > 10, F.concat(F.substring(ip, 1, 10), F.lit("..."))).otherwise(ip)
