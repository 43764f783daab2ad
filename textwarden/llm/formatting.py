"""Problem 6: records equal but for white space, letter case, punctuation and field order.

Recursive radix partitioning on canonical bytes: rows are counted by the first characters of
their canonical form; a bucket above ``LIMIT`` rows or ``BYTES`` is split by further characters
until it fits, or until all its rows are one and the same form. Each fitting bucket goes to one
task, which counts it in a trie with terminal counters. The table of split buckets is a
DataFrame from round to round; nothing of it comes to the driver.
"""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import checkpoint, stored

LIMIT, BYTES = 40_000, 64 << 20  # rows and bytes that one bucket may hold
FIRST_BYTES = 2
FIELDS = ("text", "label", "category", "source")


class _Drop(dict):
    """Code point -> itself, or nothing for white space and punctuation."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        gone = c.isspace() or unicodedata.category(c)[0] == "P"
        self[code] = "" if gone else c
        return self[code]


_DROP = _Drop()


def canonical(text: str | None) -> str | None:
    """Lower case without white space and punctuation; marks, digits, symbols and invisible characters stay."""
    return None if text is None else text.lower().translate(_DROP)


def canonical_json(body: str | None) -> str | None:
    """Canonical form of a JSON object, by field name; null unless it is one with all four fields."""
    try:
        x = json.loads(body or "")
    except ValueError:
        return None
    if not isinstance(x, dict) or any(f not in x for f in FIELDS):
        return None
    return "\x1f".join("\x00" if x[f] is None else canonical(x[f] if isinstance(x[f], str) else json.dumps(x[f], sort_keys=True)) for f in FIELDS)


@F.pandas_udf(T.StringType())
def canonical_udf(text: pd.Series) -> pd.Series:
    return text.map(canonical)


@F.pandas_udf(T.StringType())
def canonical_json_udf(text: pd.Series) -> pd.Series:
    return text.map(canonical_json)


class Trie:
    """Compressed trie over strings; a node is [edges by first character, [edge text, node]..., terminal]."""

    def __init__(self) -> None:
        self.root: list = [{}, None]

    def add(self, s: str) -> list:
        """The terminal counter of s: [copies, smallest key]."""
        node, i = self.root, 0
        while True:
            if i == len(s):
                if node[1] is None:
                    node[1] = [0, None]
                return node[1]
            edge = node[0].get(s[i])
            if edge is None:
                leaf = [{}, [0, None]]
                node[0][s[i]] = [s[i:], leaf]
                return leaf[1]
            label, child = edge
            if s.startswith(label, i):
                node, i = child, i + len(label)
                continue
            k, most = 1, min(len(label), len(s) - i)
            while k < most and label[k] == s[i + k]:
                k += 1
            middle = [{label[k]: [label[k:], child]}, None]
            edge[0], edge[1] = label[:k], middle
            node, i = middle, i + k


def _count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    trie, cells = Trie(), []
    for s, key in zip(pdf["c"], pdf["k"], strict=True):
        cell = trie.add(s)
        cell[0] += 1
        if cell[1] is None or key < cell[1]:
            cell[1] = key
        cells.append(cell)
    return pd.DataFrame({"key_a": [c[1] for c in cells], "k": pdf["k"].to_numpy(), "copies": [c[0] for c in cells]})


def members(records: DataFrame, key: str, canon: str, limit: int = LIMIT, most_bytes: int = BYTES) -> DataFrame:
    """One row per record: key_a (smallest key of its group), k (its key), copies (records of the group).

    ``records``: one row per record. Null canonical forms are left out; the empty one is a
    form like any other. A group of any size is counted in full: a form that alone fills an
    oversized bucket is counted by partial aggregation instead of a trie.
    """
    rest = checkpoint(records.select(F.col(key).alias("k"), F.col(canon).alias("c")).where("k is not null and c is not null"))
    # each row: its prefix so far; a form shorter than the prefix ends with a mark that no longer prefix has
    prefix = lambda n: F.when(F.length("c") < n, F.concat("c", F.lit("\x1e"))).otherwise(F.substring("c", 1, n))
    count = F.count("*").alias("n"), F.sum(F.octet_length("c").cast("long")).alias("bytes"), (F.min(F.md5(F.col("c").cast("binary"))) == F.max(F.md5(F.col("c").cast("binary")))).alias("same")
    tries: list[DataFrame] = []
    whole: list[DataFrame] = []
    n = FIRST_BYTES
    while True:
        rows = rest.withColumn("p", prefix(n))
        big = stored(rows.groupBy("p").agg(*count).where((F.col("n") > limit) | (F.col("bytes") > most_bytes)).select("p", "same"))
        if big.isEmpty():
            tries.append(rows)
            break
        # one row per oversized prefix; its size is known from the stored table, so the join is chosen by it
        tries.append(rows.join(big, "p", "left_anti"))
        whole.append(rows.join(big.where("same"), "p", "left_semi"))
        rest, n = checkpoint(rows.join(big.where("not same"), "p", "left_semi").select("k", "c")), n * 2
    out = reduce(DataFrame.unionByName, tries).select("k", "c", "p").groupBy("p").applyInPandas(_count_bucket, "key_a string, k string, copies long")
    for part in whole:
        # rows of one form meet by its digest only to learn the group's smallest key: partial sums per task, then one row per form
        part = part.select("k", F.md5(F.col("c").cast("binary")).alias("c"))
        tops = part.groupBy("c").agg(F.min("k").alias("key_a"), F.count("*").alias("copies"))
        out = out.unionByName(part.join(stored(tops), "c").select("key_a", "k", "copies"))
    return out


def groups(found: DataFrame) -> DataFrame:
    """One row per group: key_a and copies, from ``members``."""
    return found.where("k = key_a").select("key_a", "copies")
