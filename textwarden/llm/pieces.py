"""Problem 9: texts above a token limit cut at natural boundaries.

Dynamic programming over all whole characters at which a token begins: the sum of cut penalties and of squared
deviations from an even piece size is least, no piece exceeds the limit, and each piece
begins the wanted number of tokens before the end of the one before.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import DEFAULT, byte_sizes, encode, encoding  # noqa: F401

#: Penalty of a cut after: a paragraph, a line, a sentence, a clause, a word, anything else.
LEVELS = ((0.0, re.compile(r"\n[ \t]*\n\s*")), (0.5, re.compile(r"\n\s*")), (1.0, re.compile(r"[.!?।…]+[\"'”’)\]]*\s+")), (4.0, re.compile(r"[,;:–—]\s+")), (8.0, re.compile(r"\s+")))
INSIDE = 30.0
IMBALANCE = 6.0


@F.pandas_udf(T.LongType())
def _size_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(encode(t)), na_action="ignore")


def size_column(text: F.Column) -> F.Column:
    """Tokens of a text."""
    return _size_udf(text)


def cut(text: str, most: int, overlap: int, path: str = DEFAULT) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) in characters; [] for the empty text, one piece if it fits.

    No piece, read by itself, has more than ``most`` tokens. The overlap is ``overlap`` tokens, or the
    few more that it takes to begin at a whole character. Raises ValueError unless 0 <= overlap < most / 2
    and most >= 8 (one character may take four tokens).
    """
    if not 0 <= overlap < most / 2 or most < 8:
        raise ValueError("the overlap must be less than half of the limit, and the limit at least 8")
    ids = encode(text, path)
    if not ids:
        return []
    if len(ids) <= most:
        return [(0, len(text), len(ids))]
    spare = 0  # a piece read by itself may take some tokens more than inside the text
    while most - spare > 2 * overlap + 4:
        out = _plan(text, ids, most - spare, overlap, path)
        sizes = [len(encode(text[a:b], path)) for a, b, _ in out]
        if max(sizes) <= most:
            return [(a, b, n) for (a, b, _), n in zip(out, sizes, strict=True)]
        spare = max(2 * spare, max(sizes) - most)
    return _greedy(text, most, overlap, path)


def _greedy(text: str, most: int, overlap: int, path: str) -> list[tuple[int, int, int]]:
    """Where no plan fits, because the text's tokens change at every cut: each piece as long as it may be, measured by itself."""
    size = lambda a, b: len(encode(text[a:b], path))
    out, a, done = [], 0, 0
    while True:
        low, high = done + 1, min(len(text), a + 64 * most)  # low: at most overlap + 4 tokens
        while low < high:
            b = (low + high + 1) // 2
            low, high = (b, high) if size(a, b) <= most else (low, b - 1)
        while low > done + 1 and size(a, low) > most:
            low -= 1
        out.append((a, low, size(a, low)))
        if low == len(text):
            return out
        done, a = low, low - 1
        while overlap and a > 0 and size(a, done) < overlap:
            a -= 1
        a = a if overlap else done


def _reach(penalty: np.ndarray, window: int) -> np.ndarray:
    """For each position, what the cuts before it cost at least: any ``window`` positions in a row hold a cut."""
    n = len(penalty)
    least = penalty.copy()  # over the ``width`` positions from here on
    width = 1
    while width < window:
        step = min(width, window - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    out = np.zeros(n)
    for a in range(window, n, window):
        b = min(n, a + window)
        out[a:b] = out[a - window : b - window] + least[a - window : b - window]
    return out


def _plan(text: str, ids: list[int], most: int, overlap: int, path: str) -> list[tuple[int, int, int]]:
    """The least sum over all whole characters at which a token begins.

    Positions are left out of the programme only if no plan through them can be the least: the cuts
    before and after cost at least what each run of ``most`` positions costs at its cheapest one, and
    a plan over the positions of low bounds says what the least sum is at most.
    """
    n = len(ids)
    ends = np.cumsum(byte_sizes(path)[ids])  # byte at which each token ends
    # byte -> character, -1 inside a character
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    first = np.append((raw & 0xC0) != 0x80, True)
    char_at = np.where(first, np.cumsum(first) - 1, -1)
    token_char = np.concatenate([[0], char_at[ends]])  # character at which token i begins; -1 inside a character
    whole = token_char >= 0
    token_of = np.full(len(text) + 2, -1)
    token_of[token_char[whole]] = np.flatnonzero(whole)
    penalty = np.full(n + 1, INSIDE)
    penalty[~whole] = np.inf
    for cost, pattern in LEVELS:
        found = np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)
        if not len(found):
            continue
        i = np.full(len(found), -1)
        for c in (found[:, 1], found[:, 1] - 1, found[:, 0]):  # a token may hold the space before its word
            at = token_of[c]
            i = np.where((i < 0) & (at > 0) & (at < n), at, i)
        np.minimum.at(penalty, i[i > 0], cost)
    penalty[[0, n]] = 0
    bound = penalty + _reach(penalty, most) + _reach(penalty[::-1], most)[::-1]
    back = np.maximum.accumulate(np.where(whole, np.arange(n + 1), 0))  # nearest whole character before
    k = max(2, -(-(n - overlap) // (most - overlap)))
    ideal = (n + (k - 1) * overlap) / k
    ceiling = max(bound[0], bound[n]) + 1 + k / 8
    bound[[0, n]] = 0
    while True:
        at = np.flatnonzero(whole & (bound <= ceiling))
        cuts, total = _best(at, back, penalty, most, overlap, ideal)
        if total <= ceiling:
            break
        ceiling = total + 1e-9 if cuts else 2 * ceiling + INSIDE
        if not cuts and len(at) == whole.sum():
            raise ValueError(f"no cut fits {most} tokens")
    return [(int(token_char[b]), int(token_char[e]), int(e - b)) for b, e in cuts]


def _best(at: np.ndarray, back: np.ndarray, penalty: np.ndarray, most: int, overlap: int, ideal: float) -> tuple[list[tuple[int, int]], float]:
    """Dynamic programming over the positions ``at``: (begin, end) of the pieces and their sum; no pieces and infinity if none fit."""
    begin = np.where(at > 0, back[np.maximum(0, at - overlap)], 0)  # where a piece after the cut begins
    # the deviation of a piece, c (x - y)^2 with x where it ends and y its begin + ideal, is c y^2 - 2 c x y + c x^2
    c = IMBALANCE / ideal**2
    y = begin + ideal
    still = c * y**2
    lows = np.minimum(np.searchsorted(begin, at - most, "left"), np.arange(len(at)))
    base, prev = np.full(len(at), np.inf), np.full(len(at), -1)
    base[0] = still[0]
    for j in range(1, len(at)):
        lo, x = lows[j], at[j]
        if lo < j:
            cost = y[lo:j] * (-2 * c * x)
            cost += base[lo:j]
            i = int(cost.argmin())
            base[j] = cost[i] + c * x * x + penalty[x] + still[j]
            prev[j] = lo + i
    j = len(at) - 1
    total = base[j] - still[j]
    if not np.isfinite(total):
        return [], np.inf
    cuts = []
    while j > 0:
        i = int(prev[j])
        cuts.append((int(begin[i]), int(at[j])))
        j = i
    return cuts[::-1], float(total)


def split(docs: DataFrame, limits: DataFrame, doc: str = "doc_id", text: str = "text", path: str = DEFAULT, texts: bool = True, only_long: bool = False) -> DataFrame:
    """One row per profile and piece: profile, doc_id, piece (from 0), n_pieces, start, end, tokens, text.

    ``limits``: one row per profile (profile, max_tokens, overlap_tokens); at most 1,000 rows. A text within
    the limit is one piece, an empty one a piece of no tokens, a null text has none. ``only_long`` leaves out what is within its limit; then
    a text of no more bytes than the least limit never reaches Python, as no token has less than one byte.
    """
    rows = limits.select("profile", "max_tokens", "overlap_tokens").distinct().limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("more than 1,000 profiles")
    profiles = [tuple(r) for r in rows if r.max_tokens is not None]
    src = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    if only_long:
        src = src.where(F.octet_length("text") > (min(p[1] for p in profiles) if profiles else 0))
    # long texts are few and each takes long: spread them before the Python stage
    src = src.repartition(max(src.sparkSession.sparkContext.defaultParallelism * 3, 24)) if only_long else src

    def run(batches):
        for pdf in batches:
            out = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                n = None
                for name, most, overlap in profiles:
                    if only_long and len(t.encode("utf-8", "surrogatepass")) <= most:
                        continue
                    if only_long:
                        n = len(encode(t, path)) if n is None else n
                        if n <= most:
                            continue
                    parts = cut(t, most, overlap or 0, path) or [(0, 0, 0)]
                    out += [(name, d, i, len(parts), a, b, k, t[a:b] if texts else None) for i, (a, b, k) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["profile", "doc_id", "piece", "n_pieces", "start", "end", "tokens", "text"])

    kind = dict(docs.dtypes)[doc]
    return src.mapInPandas(run, f"profile string, doc_id {kind}, piece int, n_pieces int, start int, end int, tokens int, text string")
