"""Problem 3: the same or nearly the same record on both sides of a split.

Selected minima of word hashes are joined across the splits, and what meets is aligned. The
minima are not those of winnowing's windows: a pair with one word in six changed need not
share a run of words that windows of fingerprints could be sure to select from, so windows
lose pairs (the tests measure it). Here the minima are taken over the whole text, so many
that none can be lost: all words, repeated ones told apart, have one order, the rarest first
(by a count sketch of fixed size). Two texts of which at most e words differ share a word
among the e + 1 rarest of each, and their first l shared words stand among the e + l rarest
of each. Texts are joined by one such word; where a word makes too many pairs, by it and a
second one, then a third. Every level is exact, so the number of pairs decides only how
texts meet. Length and word signature bound the difference inside the join, and the words
of what is left are aligned exactly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .leak import words
from .util import opened, spread, stored

#: Words of more pairs than this are joined together with a further word instead, up to DEPTH words. It changes no result.
MOST_PAIRS = 20_000
DEPTH = 3
#: Parts into which the pairs of one key are cut at the last depth, where their number has no limit.
PARTS = 16
#: Cells of the sketch of word counts; its size does not depend on the data.
SKETCH = 1 << 18
DIFFER = 1 / 6
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Hash(dict):
    """Word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = xxhash.xxh64_intdigest(word)
        return self[word]


def hashes(w: list[str], kept: _Hash) -> np.ndarray:
    return np.fromiter((kept[x] for x in w), np.uint64, len(w))


SIGNATURE = ("s0", "s1", "s2", "s3")


def signature(h: np.ndarray) -> list[int]:
    """256 bits, one set by each word. Two texts with e differing words have at most 2 e differing bits."""
    bits = np.zeros(256, bool)
    bits[((h >> np.uint64(20)) % np.uint64(256)).astype(int)] = True
    return np.packbits(bits).view(np.int64).tolist()


def align(a: list[str], b: list[str]) -> int:
    """Words of a and b that match in order: the longest common subsequence, a column of its table at a time as the bits of one number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    column = full
    for y in b:
        hit = column & at.get(y, 0)
        column = (column + hit | column - hit) & full
    return len(a) - column.bit_count()


def side(split: F.Column) -> F.Column:
    """train or eval; null for what belongs to no split."""
    s = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    return F.when(s == "train", "train").when(s.isin("val", "test"), "eval")


def _classes(records: DataFrame) -> DataFrame:
    """k, side, c: records with the digest of their words, and w: the words."""

    def run(batches):
        import xxhash

        for pdf in batches:
            w = [" ".join(words(t)) for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "side": pdf["side"], "c": [xxhash.xxh3_128_digest(x) for x in w], "w": w})

    return records.mapInPandas(run, "k string, side string, c binary, w string").where("w <> ''")


def _rarity(texts: DataFrame) -> np.ndarray:
    """The sketch: in each cell the number of texts on either side whose words fall into it. 2 x SKETCH numbers, whatever the data."""

    def run(batches):
        count, kept = np.zeros((2, SKETCH), np.int64), _Hash()
        for pdf in batches:
            for w, train, other in zip(pdf["w"], pdf["train"], pdf["eval"], strict=True):
                cells = (np.unique(hashes(w.split(" "), kept)) % np.uint64(SKETCH)).astype(np.int64)
                if train:
                    np.add.at(count[0], cells, 1)
                if other:
                    np.add.at(count[1], cells, 1)
        at = np.flatnonzero(count.any(0))
        yield pd.DataFrame({"cell": at, "t": count[0, at], "e": count[1, at]})

    got = texts.select("w", "train", "eval").mapInPandas(run, "cell long, t long, e long").groupBy("cell").agg(F.sum("t").alias("t"), F.sum("e").alias("e")).toPandas()
    out = np.zeros((2, SKETCH), np.int64)
    out[:, got.cell.to_numpy(int)] = got[["t", "e"]].to_numpy().T
    return out


def _rarest(h: np.ndarray, rarity: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` rarest words in the order of all texts (the second, third ... of a repeated word are words of their own), and whether texts
    of both sides may have them."""
    by = np.argsort(h, kind="stable")
    same = h[by]
    first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    own = _mix(same + nth.astype(np.uint64) * _SEED)
    cells = (same % np.uint64(SKETCH)).astype(np.int64)
    order = np.lexsort((own, rarity[:, cells].sum(0)))[:most]
    return (own[order] >> np.uint64(32)).astype(np.uint32).view(np.int32), (rarity[:, cells[order]] > 0).all(0)


def _may(n: F.Column, differ: float) -> F.Column:
    return F.floor(n * differ + 1e-9).cast("int")


def _prefixes(texts: DataFrame, rarity: np.ndarray, differ: float, depth: int) -> DataFrame:
    """Texts with their signature and their e + depth rarest words; of those, only the ones that texts of both sides may have, with their places."""
    sent = texts.sparkSession.sparkContext.broadcast(rarity)

    def run(batches):
        kept = _Hash()
        for pdf in batches:
            hs = [hashes(w.split(" "), kept) for w in pdf["w"]]
            rare = [_rarest(h, sent.value, int(len(h) * differ + 1e-9) + depth) for h in hs]
            out = {"c": pdf["c"], "train": pdf["train"], "eval": pdf["eval"], "n": [len(h) for h in hs]}
            out |= {"words": [w[both] for w, both in rare], "places": [np.flatnonzero(both).astype(np.int32) for _, both in rare]}
            yield pd.DataFrame(out | dict(zip(SIGNATURE, np.array([signature(h) for h in hs], np.int64).reshape(-1, 4).T, strict=True)))

    return texts.mapInPandas(run, "c binary, train boolean, eval boolean, n int, words array<int>, places array<int>, s0 long, s1 long, s2 long, s3 long")


def _rows(level: DataFrame, depth: int, differ: float) -> DataFrame:
    """Each text once for every further word of its prefix at this depth: the key g of its words so far, and at, the last one's place in ``words``."""
    # the word number l of those in common stands among the e + l rarest
    within = F.filter(F.sequence(F.col("at") + 1, F.size("words") - 1), lambda i: F.get("places", i) < _may(F.col("n"), differ) + depth)
    at = F.explode(F.when(F.col("at") + 1 < F.size("words"), within)).alias("next")
    rows = level.select("c", "train", "eval", "n", *SIGNATURE, "words", "g", at)
    return rows.select("c", "train", "eval", "n", *SIGNATURE, F.xxhash64("g", F.get("words", "next")).alias("g"), F.col("next").alias("at"))


def _met(rows: DataFrame) -> DataFrame:
    """The keys that texts of both sides have, with the number of pairs that each would make."""
    n = rows.groupBy("g").agg(F.count_if("train").alias("nt"), F.count_if("eval").alias("ne"))
    return n.where("nt > 0 and ne > 0").select("g", (F.col("nt") * F.col("ne")).alias("pairs"))


def _joined(rows: DataFrame, keys: DataFrame, differ: float, parts: int = 1) -> DataFrame:
    """Pairs of one key, as far as lengths and signatures allow the two texts to be near: both bounds are exact."""
    rows = rows.join(keys, "g")
    a = rows.where("train").select("g", F.col("c").alias("ca"), F.col("n").alias("na"), *[F.col(s).alias(f"a{s}") for s in SIGNATURE])
    b = rows.where("eval").select("g", F.col("c").alias("cb"), F.col("n").alias("nb"), *[F.col(s).alias(f"b{s}") for s in SIGNATURE])
    on = ["g"]
    if parts > 1:
        a = a.withColumn("part", F.pmod(F.xxhash64("ca"), F.lit(parts)).cast("int"))
        b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        on = ["g", "part"]
    may = _may(F.greatest("na", "nb"), differ)
    bits = sum((F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in SIGNATURE[1:]), F.bit_count(F.col("as0").bitwiseXOR(F.col("bs0"))))
    near = (F.abs(F.col("na") - F.col("nb")) <= may) & (bits <= 2 * may)
    return a.join(b, on).where(near & (F.col("ca") != F.col("cb"))).select("ca", "cb")


def _candidates(texts: DataFrame, differ: float) -> DataFrame:
    """(ca, cb) of all texts that may be near; a pair may come several times."""
    # the least texts that may differ at all have so many words in common, so no pair ends before the last depth
    least = int(np.ceil(1 / differ - 1e-9)) if differ > 0 else DEPTH + 1
    depth = max(1, min(DEPTH, least - int(least * differ + 1e-9)))
    prefixes = stored(_prefixes(texts, _rarity(texts), differ, depth))
    level = prefixes.withColumns({"g": F.lit(0).cast("long"), "at": F.lit(-1)})
    found = []
    for k in range(1, depth + 1):
        rows = _rows(level, k, differ)
        keys = stored(_met(rows))
        last = k == depth
        found.append(_joined(rows, keys.where(F.col("pairs") <= MOST_PAIRS).select("g"), differ))
        hot = keys.where(F.col("pairs") > MOST_PAIRS).select("g")
        if hot.isEmpty():
            break
        if last:
            found.append(_joined(rows, hot, differ, PARTS))
            break
        # the words of a text are fetched again only where a key of it goes on
        on = rows.join(hot, "g").select("c", "g", "at")
        level = stored(on.join(prefixes, "c"))
    return reduce(DataFrame.unionByName, found)


def overlaps(df: DataFrame, key: str = "record_id", text: str = "text", split: str = "split", differ: float = DIFFER, checked: bool = True) -> DataFrame:
    """(train_key, eval_key, matched, longer, coverage): pairs of one record in train and one in val or test.

    At most ``differ`` of the longer text's words are not matched in order (a changed, added,
    dropped, misspelt or moved word each counts once). Records of no split, null keys and
    texts without a word take no part. Equal texts meet as one class; pairs of records are
    opened at the end only.
    """
    src = df.select(F.col(key).cast("string").alias("k"), side(F.col(split)).alias("side"), F.col(text).alias("t")).where("k is not null and side is not null and t is not null")
    named = _classes(spread(src))
    rows = stored(named.groupBy("c", "k", "side").agg(F.first("w").alias("w")))
    members = rows.select("c", "k", "side")
    texts = stored(rows.groupBy("c").agg(F.max(F.col("side") == "train").alias("train"), F.max(F.col("side") == "eval").alias("eval"), F.first("w").alias("w")))
    pairs = _candidates(texts, differ).distinct()
    pairs = pairs.join(texts.select(F.col("c").alias("ca"), F.col("w").alias("wa")), "ca").join(texts.select(F.col("c").alias("cb"), F.col("w").alias("wb")), "cb")

    def verify(batches):
        for pdf in batches:
            out = []
            for ca, cb, wa, wb in zip(pdf["ca"], pdf["cb"], pdf["wa"], pdf["wb"], strict=True):
                a, b = wa.split(" "), wb.split(" ")
                size = max(len(a), len(b))
                # words in common bound what an alignment can match
                if checked and len(set(a) ^ set(b)) > 2 * (size * differ) + 1e-9:
                    continue
                m = align(a, b)
                if size - m <= size * differ + 1e-9:
                    out.append((ca, cb, m, size))
            yield pd.DataFrame(out, columns=["ca", "cb", "matched", "longer"])

    near = pairs.mapInPandas(verify, "ca binary, cb binary, matched int, longer int")
    same = texts.where("train and eval").select(F.col("c").alias("ca"), F.col("c").alias("cb"), F.size(F.split("w", " ")).alias("matched")).withColumn("longer", F.col("matched"))
    both = near.unionByName(same)
    out = opened(both, "ca", members.where("side = 'train'"), "k", "train_key")
    out = opened(out, "cb", members.where("side = 'eval'"), "k", "eval_key")
    return out.where("train_key <> eval_key").select("train_key", "eval_key", "matched", "longer", (F.col("matched") / F.col("longer")).alias("coverage"))


def report(found: DataFrame, df: DataFrame, key: str = "record_id", split: str = "split", source: str = "source") -> DataFrame:
    """Per split and source of the evaluation side: records, overlapping records, pairs, mean best coverage."""
    records = df.select(F.col(key).cast("string").alias("eval_key"), F.lower(F.regexp_replace(F.col(split), r"(?U)^\s+|\s+$", "")).alias("split"), F.col(source).alias("source")).where("split in ('val', 'test')").dropDuplicates(["eval_key"])
    best = found.groupBy("eval_key").agg(F.max("coverage").alias("coverage"), F.count("*").alias("pairs"))
    return records.join(best, "eval_key", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("coverage").alias("overlapping"), F.sum(F.coalesce("pairs", F.lit(0))).alias("pairs"), F.avg("coverage").alias("mean_coverage"))
