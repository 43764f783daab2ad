"""Problem 2: abusive, hateful or sexual content by its nearest labelled examples.

Sentences of a bounded labelled sample stand in block-max inverted indexes: for each term
the blocks of examples that hold it, each with its largest weight there and its postings.
Queries are taken in groups: these bounds add up to one per query and block; the best blocks
are scored first, then every block whose bound could still beat the k-th best, so the
neighbours are those of the exact TF-IDF cosine. Distance-weighted votes of the k nearest are
calibrated on the sample itself and come with the nearest example as evidence. A labelled
text never votes on itself: its own label is taken out of the examples that it stands for.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import plain
from .util import spread

#: Labelled rows that the index is fitted on at most, for each of the two sides (those whose hashed key is smallest).
SAMPLE = 5_000
POSITIVE = ("harassment", "hate_speech", "sexual", "threat")
K, BLOCK, FIRST = 15, 32, 6  # neighbours; examples of a block; blocks that are scored before bounds are compared
GROUP = 64  # queries that are answered at once
#: Rows of the sample that the calibration uses at most (about), and how much a repeated sentence may weigh at most.
CALIBRATE, MOST_MASS = 2_000, 3.0
SHARP = 4.0  # a vote weighs its cosine to this power
THRESHOLD = 0.5
_END = re.compile(r"(?<=[.!?।…])[\"')\]]*\s+|\n+")
# Signs that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e", "£": "l"})
_WORD = re.compile(r"[^\W_][\w@$'’ऀ-ॿ]*(?:[-.*][^\W_](?=[-.*\s,!?]|$))*", re.U)


def sentences(text: str | None) -> list[str]:
    out = [s for s in (x.strip() for x in _END.split(plain(text))) if re.search(r"[^\W\d_]", s)]
    return out


class _Spelling(dict):
    """Word -> its one spelling, kept for the next time."""

    def __missing__(self, w: str) -> str:
        if len(self) > 200_000:
            self.clear()
        if w.isdigit():
            x = "0"
        else:
            x = re.sub(r"[-.*]", "", w)
            if re.search(r"[a-z]", x):
                x = x.translate(_LEET)
            x = re.sub(r"(.)\1+", r"\1", x)
        self[w] = x
        return x


_SPELLING = _Spelling()


def tokens(s: str) -> list[str]:
    """Words in one spelling: look-alikes, digits for letters, spelled-out letters and repeats undone; numbers as one word."""
    return [_SPELLING[w] for w in _WORD.findall(s)]


def terms(w: list[str]) -> Counter:
    """Words, pairs of neighbours, and four-letter parts of long words."""
    out = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    for x in w:
        if len(x) > 5:
            out += ["#" + x[i : i + 4] for i in range(len(x) - 3)]
    return Counter(out)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one after the other."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)


class Index:
    """Block-max index over examples: (sentence, its votes: [(owner, label 0 or 1), ...])."""

    def __init__(self, rows: list[tuple[str, list[tuple[object, int]]]], weight: tuple[float, float] = (1.0, 1.0)):
        self.weight, self.count = weight, len(rows)
        bags = [terms(tokens(x[0])) for x in rows]
        df = Counter(t for b in bags for t in b)
        self.vocab = {t: i for i, t in enumerate(sorted(df))}
        self.idf = np.array([np.log(1 + self.count / df[t]) for t in self.vocab], np.float32)
        self.rare = float(np.log(1 + self.count))  # of a term that no example has; it counts in a query's length
        vectors = [self._vector(b) for b in bags]
        # examples that share their heaviest frequent terms stand in one block, so bounds are tight
        order = sorted(range(self.count), key=lambda i: self._place(vectors[i]))
        self.text = [rows[i][0] for i in order]
        self.mass = np.zeros((self.count, 2))
        self.own: dict[object, tuple[list[int], int]] = {}
        for r, i in enumerate(order):
            for owner, y in rows[i][1]:
                self.mass[r, y] += weight[y]
                self.own.setdefault(owner, ([], y))[0].append(r)
        # postings by (term, block)
        row = np.repeat(np.arange(self.count), [len(vectors[i][0]) for i in order])
        term = np.concatenate([vectors[i][0] for i in order]) if rows else np.zeros(0, np.int64)
        value = np.concatenate([vectors[i][1] for i in order]) if rows else np.zeros(0, np.float32)
        by = np.lexsort((row, term))
        self.rows, self.values, term = row[by].astype(np.int32), value[by].astype(np.float32), term[by]
        self.blocks = max(1, -(-self.count // BLOCK))
        new = np.flatnonzero(np.diff(term * self.blocks + self.rows // BLOCK, prepend=-1))
        self.run_start, self.run_size = new, np.diff(np.append(new, len(term)))
        self.run_block = self.rows[new] // BLOCK
        self.run_top = np.maximum.reduceat(self.values, new) if len(new) else np.zeros(0, np.float32)
        self.term_run = np.searchsorted(term[new], np.arange(len(self.vocab) + 1))  # runs of term t: term_run[t] to term_run[t + 1]
        self.bins: tuple[np.ndarray, np.ndarray] | None = None

    def _vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the index and their weights in the whole text's unit vector."""
        get = self.vocab.get
        all_ = np.array([get(t, -1) for t in bag], np.int64)
        n = 1 + np.log(np.fromiter(bag.values(), np.float32, len(bag)))
        known = all_ >= 0
        t, w = all_[known], n[known]
        w = w * self.idf[t]
        length = np.sqrt((w * w).sum() + ((n[~known] * self.rare) ** 2).sum())
        return t, (w / (length or 1)).astype(np.float32)

    def _place(self, vector: tuple[np.ndarray, np.ndarray]) -> tuple:
        t, _ = vector
        return tuple(t[np.argsort(self.idf[t], kind="stable")][:6].tolist())

    def nearest(self, words: list[list[str]], k: int = K, without: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and cosines of each query's k nearest examples, exact; ties by row. A query is its tokens.

        ``without``: for each query the owner whose votes don't count, or None; examples that only this owner has are left out.
        """
        out = []
        for i in range(0, len(words), GROUP):
            out += self._group(words[i : i + GROUP], k, (without or [None] * len(words))[i : i + GROUP])
        return out

    def _group(self, words: list[list[str]], k: int, without: list) -> list[tuple[np.ndarray, np.ndarray]]:
        m, n = len(words), self.count
        if not n:
            return [(np.zeros(0, int), np.zeros(0))] * m
        vectors = [self._vector(terms(w)) for w in words]
        term = np.concatenate([t for t, _ in vectors])
        size = self.term_run[term + 1] - self.term_run[term]
        run = _ranges(self.term_run[term], size)
        query = np.repeat(np.repeat(np.arange(m), [len(t) for t, _ in vectors]), size)
        value = np.repeat(np.concatenate([w for _, w in vectors]), size)
        place = query * self.blocks + self.run_block[run]
        bound = np.bincount(place, value * self.run_top[run], m * self.blocks).reshape(m, self.blocks) * (1 + 1e-6)
        alone = [(q, np.array(self._alone(owner), np.int64)) for q, owner in enumerate(without) if owner in self.own]

        def scored(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places (query x blocks + block) of the wanted blocks, and the scores of their examples: a row of BLOCK for each."""
            at = np.flatnonzero(wanted)
            slot = np.full(wanted.size, -1)
            slot[at] = np.arange(len(at))
            pick = slot[place] >= 0
            size = self.run_size[run[pick]]
            entry = _ranges(self.run_start[run[pick]], size)
            where = np.repeat(slot[place[pick]] * BLOCK, size) + self.rows[entry] % BLOCK
            score = np.bincount(where, np.repeat(value[pick], size) * self.values[entry], len(at) * BLOCK).reshape(-1, BLOCK)
            for q, rows in alone:
                k = slot[q * self.blocks + rows // BLOCK]
                score[k[k >= 0], rows[k >= 0] % BLOCK] = 0
            return at, score

        few = min(FIRST, self.blocks)
        first = np.argpartition(-bound, few - 1, axis=1)[:, :few]
        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, first, True, 1)
        at, score = scored(wanted)
        seen = score.reshape(m, -1)  # every query has as many first blocks
        least = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.zeros(m)
        more = (bound >= least[:, None]) & (bound > 0) & ~wanted
        if more.any():
            other, score2 = scored(more)
            at, score = np.concatenate([at, other]), np.concatenate([score, score2])
        q = at // self.blocks
        block, row = np.nonzero(score >= np.maximum(least, 1e-12)[q][:, None])
        q, row, s = q[block], (at[block] % self.blocks) * BLOCK + row, score[block, row]
        order = np.lexsort((row, -s, q))
        q, row, s = q[order], row[order], s[order]
        edge = np.searchsorted(q, np.arange(m + 1))
        return [(row[a : min(b, a + k)], s[a : min(b, a + k)]) for a, b in zip(edge, edge[1:], strict=False)]

    def _alone(self, owner) -> list[int]:
        """Examples that no other text has."""
        rows, y = self.own[owner]
        return [r for r in rows if self.mass[r].sum() <= self.weight[y] * (1 + 1e-9)]

    def votes(self, words: list[list[str]], without: list | None = None) -> list[tuple[float, int, float]]:
        """For each query its share of the distance-weighted votes, the nearest positive row (or nearest), its cosine."""
        out = []
        for (rows, scores), owner in zip(self.nearest(words, K, without), without or [None] * len(words), strict=True):
            if not len(rows):
                out.append((0.0, -1, 0.0))
                continue
            mass = self.mass[rows]
            if owner in self.own:
                own, y = self.own[owner]
                mass[np.isin(rows, own), y] -= self.weight[y]
            total = mass.sum(1)
            label = mass[:, 1] / total
            w = scores**SHARP * np.minimum(total, MOST_MASS * sum(self.weight))
            share = float((w * label).sum() / w.sum())
            side = label > 0.5
            pick = int(np.argmax(side)) if share > 0.5 and side.any() else 0
            out.append((share, int(rows[pick]), float(scores[pick])))
        return out

    def text_votes(self, texts: list[str | None], owners: list | None = None, kept: dict | None = None) -> list[tuple[float, int, float]]:
        """The highest vote among each text's sentences. Sentences of the same tokens are asked once; ``kept`` holds their votes for later calls."""
        kept = {} if kept is None else kept
        parts = [[tuple(tokens(s)) for s in sentences(t)] for t in texts]
        owners = owners or [None] * len(texts)
        owned = [o in self.own for o in owners]
        new = list(dict.fromkeys(s for p, own in zip(parts, owned, strict=True) if not own for s in p if s not in kept))
        kept.update(zip(new, self.votes([list(s) for s in new]), strict=True))
        asked = [(s, o) for p, o, own in zip(parts, owners, owned, strict=True) if own for s in p]
        answers = iter(self.votes([list(s) for s, _ in asked], [o for _, o in asked]))
        return [max((next(answers) if own else kept[s] for s in p), default=(0.0, -1, 0.0)) for p, own in zip(parts, owned, strict=True)]

    def calibrate(self, rows: list[tuple[object, str, int]]) -> None:
        """Monotone map of votes to probabilities (pool adjacent violators), each text without itself."""
        weight = self.weight
        found = self.text_votes([t for _, t, _ in rows], [k for k, *_ in rows])
        same: dict[float, list[float]] = {}
        for (x, *_), (*_, y) in zip(found, rows, strict=True):  # equal votes get one probability
            at = same.setdefault(x, [0.0, 0.0])
            at[0] += weight[y] * y
            at[1] += weight[y]
        blocks: list[list[float]] = []
        for x in sorted(same):
            blocks.append([x, *same[x]])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                b = blocks.pop()
                blocks[-1] = [b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
        self.bins = np.array([b[0] for b in blocks] or [1.0]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks] or [0.0])

    def probability(self, vote):
        x, p = self.bins
        return np.interp(vote, x, p)


def build(rows: list[tuple[object, str, int]], weight: tuple[float, float] = (1.0, 1.0)) -> Index:
    """rows: (owner, text, 0 or 1). A sentence that stands in several texts is one example with all their votes.

    ``weight``: how many rows of the table one sampled row of each side stands for.
    """
    seen: dict[tuple, tuple[str, list]] = {}
    for k, t, y in rows:
        for s in {tuple(tokens(s)): s for s in reversed(sentences(t))}.items():
            seen.setdefault(s[0], (s[1], []))[1].append((k, y))
    index = Index(list(seen.values()), weight)
    index.calibrate(rows[:: max(1, len(rows) // CALIBRATE)])
    return index


def fit(df: DataFrame, key: str = "id", text: str = "text", category: str = "labels.category", most: int = SAMPLE) -> Index:
    """An index from at most ``most`` labelled rows of either side; null labels and texts are left out."""
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lower(F.trim(F.col(category))).isin(*POSITIVE).alias("y")).where("k is not null and t is not null and y is not null").dropDuplicates(["k"])
    total = {bool(r.y): r.n for r in src.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # both sides in one pass: each part of the table keeps its own first rows before they meet
    first = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k"))
    rows = [(r.k, r.t, int(r.y)) for r in src.withColumn("rn", first).where(F.col("rn") <= most).orderBy("y", "rn").collect()]
    got = Counter(y for *_, y in rows)
    return build(rows, tuple(total.get(bool(y), 0) / max(1, got[y]) for y in (0, 1)))


def score(df: DataFrame, index: Index, key: str = "id", text: str = "text") -> DataFrame:
    """id, score (calibrated probability), vote, evidence (nearest example), cosine; one row per row. Null and empty texts score 0.

    A row of the sample that the index was fitted on is scored without its own label, whatever that is.
    """
    sent = df.sparkSession.sparkContext.broadcast(index)  # its size is bounded by the sample

    def run(batches):
        kept: dict = {}
        for pdf in batches:
            if len(kept) > 50_000:
                kept.clear()
            found = sent.value.text_votes(pdf["t"].tolist(), pdf["k"].tolist(), kept)
            vote, row, cosine = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0),) * 3
            yield pd.DataFrame({"id": pdf["k"], "score": np.where(row >= 0, sent.value.probability(vote), 0.0), "vote": vote, "evidence": [sent.value.text[r] if r >= 0 else None for r in row.astype(int)], "cosine": cosine})

    src = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return src.mapInPandas(run, f"id {dict(df.dtypes)[key]}, score double, vote double, evidence string, cosine double")


def rates(scored: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Per source (null included): records, flagged, rate, mean score."""
    return scored.groupBy(source).agg(F.count("*").alias("records"), F.count_if(F.col("score") >= threshold).alias("flagged"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
