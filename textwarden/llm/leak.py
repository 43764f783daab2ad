"""Problem 7: held-out evaluation texts inside the corpus.

The normalised n-grams of the test items are hashed and sent to every task; each
document's token windows are hashed by the same rolling hash, hits are verified word by
word, and the spans or the documents can be removed.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

N_WORDS = 12
#: Most n-grams that are sent to the tasks at once: 20 bytes each, and about 150 for each distinct word. More are scanned for in several passes.
MAX_NGRAMS = 1_000_000
_QUOTES = "'\"`´‘’‚‛“”„‟«»‹›′″"
# a tag is a short one, or one of any length whose attributes all have values
_TAG = re.compile(r"""</?[A-Za-z][^<>]{0,200}>|<[A-Za-z][\w:-]*(?:\s+[A-Za-z_:@][\w:.@-]*\s*=\s*(?:"[^"<]*"|'[^'<]*'|[^\s"'<>]+))+\s*/?>""", re.A)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?", re.A)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Word(dict):
    """Code point -> lower-case letter, space for punctuation and symbols, nothing for quotes and invisible characters."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.category(c)
        self[code] = "" if c in _QUOTES or kind == "Cf" else " " if kind[0] in "PSZC" else c
        return self[code]


_WORD = _Word()


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def untagged(text: str) -> str:
    """The text with spaces in the place of tags and comments, so every other character keeps its place."""
    if "<" not in text:
        return text
    end = text.rfind("-->") + 3  # behind the last one no comment ends, and none is looked for
    if "<!--" in text and end > 2:
        text = _COMMENT.sub(_blank, text[:end]) + text[end:]
    return _TAG.sub(_blank, text)


def words(text: str | None) -> list[str]:
    """Words without letter case, punctuation, quote marks, mark-up and line breaks; null has none."""
    if not text:
        return []
    text = untagged(text)
    if "&" in text:
        text = html.unescape(text)
    return unicodedata.normalize("NFC", text).lower().translate(_WORD).split()


def _characters(text: str) -> Iterator[tuple[str, int, int]]:
    """Pieces of the text that become characters of words independently: entities, and letters with their marks; with their places."""
    text, i = untagged(text), 0
    while i < len(text):
        m = _ENTITY.match(text, i) if text[i] == "&" else None
        out = html.unescape(m.group()) if m else text[i]
        j = m.end() if m and out != m.group() else i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or 0x1160 <= ord(text[j]) <= 0x11FF or unicodedata.category(text[j])[0] == "M"):
            j += 1
        yield unicodedata.normalize("NFC", html.unescape(text[i:j]) if m else text[i:j]), i, j
        i = j


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end): the words of ``words``, with their places in the stored text."""
    out: list[tuple[str, int, int]] = []
    word, start, end = "", 0, 0
    for s, a, b in _characters(text):
        for c in s.lower().translate(_WORD):
            if c.isspace():
                if word:
                    out.append((word, start, end))
                word = ""
            else:
                start, end = (start, b) if word else (a, b)
                word += c
    return [*out, (word, start, end)] if word else out


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        h = h * _BASE + ids[j : len(ids) - n + 1 + j]
    return h


class Index:
    """Hash set of the items' n-grams, and the words to verify hits with: arrays, 20 bytes an n-gram."""

    def __init__(self, items: list[tuple[int, list[str] | str | None]], n: int = N_WORDS):
        """items: (item, its words or text)."""
        self.n, self.ids = n, {}
        self.items: list = []
        parts, hashes, places, owners, size = [], [], [], [], 0
        for item, w in items:
            w = words(w) if w is None or isinstance(w, str) else w
            if len(w) < n:
                continue
            ids = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.uint64)
            h = window_hashes(ids, n)
            hashes.append(h)
            places.append(np.arange(len(h), dtype=np.int32) + size)
            owners.append(np.full(len(h), len(self.items), np.int32))
            self.items.append(item)
            parts.append(ids.astype(np.uint32))
            size += len(ids)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.words, h = join(parts, np.uint32), join(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.places, self.owners = h[order], join(places, np.int32)[order], join(owners, np.int32)[order]

    def hits(self, text: str | None, w: list[str] | None = None) -> list[tuple[int, int]]:
        """(word position, item) of every verified window; a window that an item has twice comes once."""
        w = words(text) if w is None else w
        if len(w) < self.n or not len(self.hashes):
            return []
        get = self.ids.get
        ids = np.array([get(x, 0) for x in w], np.uint64)
        h = window_hashes(ids, self.n)
        low = np.searchsorted(self.hashes, h)
        seen = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == h)
        out = []
        for i in seen.tolist():
            k, found = int(low[i]), set()
            while k < len(self.hashes) and self.hashes[k] == h[i]:
                if (self.words[self.places[k] : self.places[k] + self.n] == ids[i : i + self.n]).all():
                    found.add(int(self.owners[k]))
                k += 1
            out += [(i, item) for item in dict.fromkeys(self.items[x] for x in sorted(found))]
        return out


def _indexes(items: DataFrame, item: str, text: str, n: int) -> list[Index]:
    """One index, or several if the items' n-grams exceed MAX_NGRAMS; an item with more is cut into parts that share n - 1 words.
    Items come to the driver one by one."""
    out, block, size = [], [], 0
    for row in items.select(item, text).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        w = words(row[1])
        for at in range(0, max(0, len(w) - n + 1), MAX_NGRAMS):
            part = w[at : at + MAX_NGRAMS + n - 1]
            block.append((row[0], part))
            size += len(part) - n + 1
            if size >= MAX_NGRAMS:
                out.append(Index(block, n))
                block, size = [], 0
    if block or not out:
        out.append(Index(block, n))
    return out


def find(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N_WORDS) -> DataFrame:
    """Rows (doc_id, item_id, n_windows): the document has that many n-word windows of the item.

    Null and empty texts and items shorter than n words match nothing. Repeated rows of a document give one row.
    """
    context = docs.sparkSession.sparkContext
    kind = dict(docs.dtypes)[doc]
    item_kind = dict(items.dtypes)[item]
    parts = []
    for index in _indexes(items, item, item_text, n):
        sent = context.broadcast(index)

        def run(batches, sent=sent):
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["d"], pdf["t"], strict=True):
                    seen: dict = {}
                    for _, i in sent.value.hits(t):
                        seen[i] = seen.get(i, 0) + 1
                    rows += [(d, i, k) for i, k in seen.items()]
                yield pd.DataFrame(rows, columns=["d", "i", "n"])

        parts.append(docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null").mapInPandas(run, f"d {kind}, i {item_kind}, n long"))
    # an item that was cut has windows in several indexes; repeated rows of a document have the same ones
    one = reduce(DataFrame.unionByName, [p.groupBy("d", "i").agg(F.max("n").alias("n")) for p in parts])
    return one.groupBy(F.col("d").alias("doc_id"), F.col("i").alias("item_id")).agg(F.sum("n").alias("n_windows"))


def cut_words(text: str, at: list[int], n: int) -> str:
    """The text without the n-word passages that begin at the word positions ``at``: from the first character of
    their first word to the last one of their last, and one white space of two that meet. Everything else stays as it is."""
    spans = word_spans(text)
    if [w for w, *_ in spans] != words(text):  # letters that only join across an entity: only the words are known
        gone = {j for i in at for j in range(i, i + n)}
        return " ".join(x for j, x in enumerate(words(text)) if j not in gone)
    runs: list[list[int]] = []
    for i in at:
        if runs and i <= runs[-1][1]:
            runs[-1][1] = i + n
        else:
            runs.append([i, i + n])
    out, done = [], 0
    for a, b in runs:
        start, end = spans[a][1], spans[b - 1][2]
        if end < len(text) and text[end].isspace() and (start == 0 or text[start - 1].isspace()):
            end += 1
        out.append(text[done:start])
        done = end
    return "".join(out) + text[done:]


def clean(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N_WORDS, mode: str = "spans") -> DataFrame:
    """The corpus without the leaked text: ``documents`` drops what has a hit, ``spans`` cuts the passages.

    ``spans`` keeps every row and column; a text with a hit loses the passages' characters (tags and marks between
    their words too) and keeps all others, see ``cut_words``.
    """
    context = docs.sparkSession.sparkContext
    indexes = _indexes(items, item, item_text, n)
    held = "_hits"  # of the indexes so far; every index reads the stored text, and the last one cuts
    while held in docs.columns:
        held += "_"
    more = StructType([*docs.schema.fields, StructField(held, ArrayType(IntegerType()))])
    out = docs
    for k, index in enumerate(indexes):
        sent, first, last = context.broadcast(index), k == 0, k == len(indexes) - 1

        def run(batches, sent=sent, first=first, last=last):
            for pdf in batches:
                before = [()] * len(pdf) if first else pdf.pop(held)
                hits = [sorted({*b, *(i for i, _ in sent.value.hits(t))}) for b, t in zip(before, pdf[text], strict=True)]
                if not last:
                    yield pdf.assign(**{held: hits})
                elif mode == "documents":
                    yield pdf[np.array([not at for at in hits], bool)]
                else:
                    yield pdf.assign(**{text: [cut_words(t, at, sent.value.n) if at else t for t, at in zip(pdf[text], hits, strict=True)]})

        out = out.mapInPandas(run, docs.schema if last else more)
    return out
