"""Problem 8: a mixture of sources with target token shares.

Iterative proportional fitting rakes token weights to the source, language and topic
marginals, each source's weight within its cap of repeats; documents are then sampled by
calibrated probabilities. Topics are the clusters of spherical k-means over token counts,
fitted on all documents, each pass over them a Spark job. Nothing but one document and one
number per token and topic of each pass, the table of cells (source x language x topic) and
a histogram of fixed size per source comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import DEFAULT, byte_sizes, encode
from .util import checkpoint, spread, stored

BINS = 4096
#: Most sources of a target table.
MAX_SOURCES = 10_000
LANGS = ("en", "hi", "hinglish", "es", "mr")
#: Topics, and the tokens that are worked on at once.
TOPICS, BLOCK = 8, 50_000
#: Parts of vectors are whole numbers of 1 / UNIT. Their sums are exact in doubles, so the order and the parts that documents come in change nothing.
UNIT = 1 << 26


class Block(NamedTuple):
    """Documents that have tokens: their hashed ids, where each begins in the flat arrays, different token ids in ascending order and their counts."""

    h: np.ndarray
    start: np.ndarray
    ids: np.ndarray
    n: np.ndarray


def _blocks(h: np.ndarray, ends: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Iterator[Block]:
    """Blocks of about BLOCK tokens; ends: where each document ends in the flat arrays."""
    begins = np.concatenate([[0], ends[:-1]])
    a = 0
    while a < len(h):
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + BLOCK, "right")))
        at = slice(int(begins[a]), int(ends[b - 1]))
        yield Block(h[a:b], begins[a:b] - begins[a], ids[at].astype(np.int64), n[at].astype(np.int64))
        a = b


def _weights(b: Block, idf: np.ndarray) -> np.ndarray:
    """The parts of the documents' unit vectors, in UNITs; a document of nothing but tokens of no weight has zeros."""
    w = (1 + np.log(np.arange(1, int(b.n.max()) + 1)))[b.n - 1] * idf[b.ids]
    length = np.sqrt(np.add.reduceat(w * w, b.start))
    size = np.diff(b.start, append=len(b.ids))
    return np.rint(w / np.repeat(np.where(length > 0, length, 1), size) * UNIT)


def _cosines(b: Block, q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres x documents, in UNITs squared."""
    return np.stack([np.add.reduceat(q * c.take(b.ids), b.start) for c in centres])


def _frequency(blocks: Iterable[Block], size: int) -> np.ndarray:
    """Documents of each token."""
    df = np.zeros(size, np.int64)
    for b in blocks:
        np.add.at(df, b.ids, 1)
    return df


def _farthest(blocks: Iterable[Block], idf: np.ndarray, centres: np.ndarray) -> tuple | None:
    """(nearness, hashed id, ids, counts) of the document farthest from all centres, least of equals by what follows; without centres the first."""
    best = None
    for b in blocks:
        q = _weights(b, idf)
        near = _cosines(b, q, centres).max(0) if len(centres) else np.zeros(len(b.h))
        some = np.logical_or.reduceat(q > 0, b.start)
        if not some.any():
            continue
        near[~some] = np.inf
        least = near.min()
        if best is not None and least > best[0]:
            continue
        ends = np.append(b.start[1:], len(b.ids))
        tied = np.flatnonzero(near == least)
        for i in tied[b.h[tied] == b.h[tied].min()]:
            at = slice(b.start[i], ends[i])
            one = (float(least), int(b.h[i]), b.ids[at].tolist(), b.n[at].tolist())
            best = one if best is None else min(best, one)
    return best


def _sums(blocks: Iterable[Block], idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres x tokens: sums of the vectors that are nearest to each centre, the first of equals."""
    k, size = centres.shape
    out = np.zeros(k * size, np.int64)
    for b in blocks:
        q = _weights(b, idf)
        of = _cosines(b, q, centres).argmax(0)
        np.add.at(out, b.ids + np.repeat(of * size, np.diff(b.start, append=len(b.ids))), q.astype(np.int64))
    return out.reshape(k, size)


class Local:
    """Passes over documents in memory: (token ids in ascending order, counts). They come in the order of the list."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], size: int):
        self.size, self.n = size, len(docs)
        full = [(i, c) for i, c in docs if len(i)]
        ends = np.cumsum([len(i) for i, _ in full], dtype=np.int64)
        self.blocks = list(_blocks(np.arange(len(full)), ends, np.concatenate([i for i, _ in full]), np.concatenate([c for _, c in full]))) if full else []

    def frequency(self) -> tuple[np.ndarray, int]:
        return _frequency(self.blocks, self.size), self.n

    def farthest(self, idf: np.ndarray, centres: np.ndarray) -> tuple | None:
        return _farthest(self.blocks, idf, centres)

    def sums(self, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return _sums(self.blocks, idf, centres)


class Spread:
    """The same passes over all rows of ``counted``, one Spark job each. Tasks' sums are added by the executors; one row per centre comes to the driver."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows.select("h", "ids", "n"), size

    def _added(self, run: Callable[[Iterator[Block]], np.ndarray]) -> dict[int, np.ndarray]:
        """Rows of the arrays that ``run`` makes of each task's documents, added up."""
        schema = pa.schema([("c", pa.int32()), ("x", pa.binary())])

        def rows(of: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(of), pa.int32()), pa.array([x.tobytes() for x in of.values()], pa.binary())], schema=schema)

        def part(batches):
            x = run(b for batch in batches for b in _opened(batch))
            for c in range(len(x)):
                yield rows({c: x[c]})

        def add(batches):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                for c, x in zip(batch.column("c").to_pylist(), batch.column("x"), strict=True):
                    one = np.frombuffer(x.as_buffer(), np.int64)
                    out[c] = out[c] + one if c in out else one
            for c, x in out.items():
                yield rows({c: x})

        sums = self.rows.mapInArrow(part, "c int, x binary").repartition("c").mapInArrow(add, "c int, x binary").collect()
        return {r.c: np.frombuffer(r.x, np.int64) for r in sums}

    def _send(self, *values):
        return self.rows.sparkSession.sparkContext.broadcast(values)

    def frequency(self) -> tuple[np.ndarray, int]:
        size = self.size
        return self._added(lambda blocks: _frequency(blocks, size)[None]).get(0, np.zeros(size, np.int64)), self.rows.count()

    def farthest(self, idf: np.ndarray, centres: np.ndarray) -> tuple | None:
        sent = self._send(idf, centres)

        def run(batches):
            best = _farthest((b for batch in batches for b in _opened(batch)), *sent.value)
            if best is not None:
                yield pa.record_batch([pa.array([x]) for x in best], names=["near", "h", "ids", "n"])

        got = self.rows.mapInArrow(run, "near double, h long, ids array<long>, n array<long>").orderBy("near", "h", "ids", "n").limit(1).collect()
        sent.destroy()
        return tuple(got[0]) if got else None

    def sums(self, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
        sent = self._send(idf, centres)
        got = self._added(lambda blocks: _sums(blocks, *sent.value))
        sent.destroy()
        return np.stack([got[c] for c in range(len(centres))])


class Topics:
    """Spherical k-means over TF-IDF of tokens. The same documents give the same topics: each next centre is the document farthest from all so far."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]] | Local | Spread, size: int, k: int = TOPICS, rounds: int = 15):
        """docs: (token ids in ascending order, counts), or what passes over them; size: number of tokens there are."""
        over = Local(docs, size) if isinstance(docs, list) else docs
        df, n = over.frequency()
        self.idf = np.log((1 + n) / (1 + df))  # a token of every document says nothing
        self.centres = np.zeros((0, size))  # in UNITs
        for _ in range(k):
            one = over.farthest(self.idf, self.centres)
            if one is None or one[0] >= UNIT * UNIT * (1 - 1e-6):  # no document is apart from the centres
                break
            b = Block(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array(one[2], np.int64), np.array(one[3], np.int64))
            centre = np.zeros((1, size))
            centre[0, b.ids] = _weights(b, self.idf)
            self.centres = np.concatenate([self.centres, centre])
        for _ in range(rounds if len(self.centres) > 0 else 0):
            new = over.sums(self.idf, self.centres).astype(float)
            length = np.sqrt((new * new).sum(1, keepdims=True))
            new = np.where(length > 0, np.rint(new / np.where(length > 0, length, 1) * UNIT), self.centres)
            moved = np.abs(new - self.centres).max()
            if moved < 1e-6 * UNIT:
                break
            self.centres = new

    def block(self, b: Block) -> np.ndarray:
        """The topic's number for each document; the first of equals."""
        if not len(self.centres):
            return np.zeros(len(b.h), np.int64)
        return _cosines(b, _weights(b, self.idf), self.centres).argmax(0)

    def of(self, ids: list[int]) -> str:
        """The topic of a text's tokens."""
        if not ids:
            return "t0"
        i, n = np.unique(ids, return_counts=True)
        return f"t{int(self.block(Block(np.zeros(1, np.int64), np.zeros(1, np.int64), i, n))[0])}"


def counted(docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str = DEFAULT) -> DataFrame:
    """doc_id, source, lang, h, ids, n, tokens; one row per row of docs with a text. h is the hashed doc_id; ids and n are the different tokens, ascending, and their counts, as 4-byte numbers."""

    @F.pandas_udf("ids binary, n binary, tokens long")
    def count(t: pd.Series) -> pd.DataFrame:
        out = [(*np.unique(np.array(ids, np.int32), return_counts=True), len(ids)) for ids in (encode(x, path) for x in t)]
        return pd.DataFrame({"ids": [i.tobytes() for i, _, _ in out], "n": [n.astype(np.int32).tobytes() for _, n, _ in out], "tokens": [k for _, _, k in out]})

    lang = F.regexp_extract(F.lower("lang"), "^[a-z]+", 0)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), canonical_source(F.col("source")).alias("source"), F.when(lang.isin(*LANGS), lang).otherwise("unknown").alias("lang"), F.xxhash64(doc).alias("h"), count(F.col(text)).alias("x"))
    return rows.select("doc_id", "source", "lang", "h", "x.ids", "x.n", "x.tokens")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column in a row, and where each of its rows ends in them."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])) if data is not None else np.zeros(0, np.uint8)
    return values.view(np.int32), (at[1:] - at[0]) // 4


def _opened(batch: pa.RecordBatch) -> Iterator[Block]:
    """The documents of a batch that have tokens."""
    if not batch.num_rows:
        return
    (ids, ends), (n, _) = _flat(batch.column("ids")), _flat(batch.column("n"))
    full = np.diff(ends, prepend=0) > 0
    yield from _blocks(batch.column("h").to_numpy()[full], ends[full], ids, n)


def topics(docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str = DEFAULT, k: int = TOPICS) -> Topics:
    """Topics fitted on all documents and all their tokens."""
    return fitted(stored(counted(spread(docs), doc, text, path)), path, k)


def fitted(rows: DataFrame, path: str = DEFAULT, k: int = TOPICS) -> Topics:
    """Topics fitted on all rows of ``counted``, which is read once for each pass."""
    size = len(byte_sizes(path))
    return Topics(Spread(rows, size), size, k)


def canonical_source(c: F.Column) -> F.Column:
    """Lower case without outer white space; the empty name is null."""
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(s != "", s)


def sized(rows: DataFrame, found: Topics) -> DataFrame:
    """doc_id, source, lang, topic, tokens; one row per row of ``counted``. Those without tokens have the first topic."""
    sent = rows.sparkSession.sparkContext.broadcast(found)  # topics x tokens of the vocabulary

    def run(batches):
        for batch in batches:
            of = np.zeros(batch.num_rows, np.int64)
            got = [sent.value.block(b) for b in _opened(batch)]
            if got:
                of[np.diff(_flat(batch.column("ids"))[1], prepend=0) > 0] = np.concatenate(got)
            names = pa.array([f"t{i}" for i in of.tolist()], pa.string())
            yield pa.record_batch([batch.column(c) for c in keep[:3]] + [names, batch.column("tokens")], names=[*keep[:3], "topic", "tokens"])

    keep = ["doc_id", "source", "lang", "tokens"]
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("tokens", T.LongType())])
    return rows.select(*keep, "ids", "n", "h").mapInArrow(run, schema)


def _wanted(x: pd.DataFrame, column: str, tokens: np.ndarray, total: float, given: dict[str, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Group of each cell and tokens wanted of each group. Values that ``given`` does not name keep what it leaves over, in proportion."""
    have = x.groupby(column).tokens.sum() / tokens.sum()
    if given:
        named = {c: given[c] for c in have.index if c in given}
        rest = have[[c for c in have.index if c not in given]]
        left = max(0.0, 1 - sum(named.values()))
        have = pd.Series({c: named[c] if c in named else left * have[c] / rest.sum() for c in have.index})
        have = have / (have.sum() or 1)
    return x.groupby(column).ngroup().to_numpy(), (have.sort_index() * total).to_numpy()


def rake(supply: pd.DataFrame, share: dict[str, float], cap: dict[str, float], total: float | None = None, rounds: int = 500, tol: float = 1e-9, langs: dict[str, float] | None = None, subjects: dict[str, float] | None = None) -> tuple[pd.DataFrame, float]:
    """Weights of the cells, and the total in tokens.

    ``supply``: source, lang, topic, tokens. The source marginal is ``share`` of the total; the
    language and topic marginals are the given ones, or those of the supply. The total is the
    given one, or less if a cap does not allow it: the largest at which every source can reach its
    share. The source marginal holds at the end; the other two as far as the caps allow.
    """
    x = supply[supply.source.isin([s for s in share if share[s] > 0]) & (supply.tokens > 0)].reset_index(drop=True)
    if not len(x):
        return x.assign(weight=pd.Series(dtype=float)), 0.0
    have = x.groupby("source").tokens.sum()
    scale = sum(share[s] for s in have.index)
    part = {s: share[s] / scale for s in have.index}  # a source without documents leaves its share to the others
    most = min(cap[s] * have[s] / part[s] for s in have.index)
    total = most if total is None else min(total, most)
    tokens, limit = x.tokens.to_numpy(float), x.source.map(cap).to_numpy(float)
    w = np.full(len(x), total / tokens.sum())
    margins = [_wanted(x, "topic", tokens, total, subjects), _wanted(x, "lang", tokens, total, langs), _wanted(x, "source", tokens, total, part)]
    for _ in range(rounds):
        before = w.copy()
        for k, (group, target) in enumerate(margins):
            for _ in range(50 if k == 2 else 1):  # source: until the cap's excess is spread over the other cells
                now = np.bincount(group, w * tokens, len(target))
                free = np.bincount(group, np.where(w < limit, w * tokens, 0), len(target))
                f = np.where(free > 0, (target - (now - free)) / np.where(free > 0, free, 1), 1).clip(0)
                w = np.where(w < limit, w * f[group], w)
                w = np.minimum(w, limit)
                if np.abs(np.bincount(group, w * tokens, len(target)) - target).max() <= tol * total:
                    break
        if np.abs(w - before).max() <= tol:
            break
    return x.assign(weight=w), total


def mix(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", path: str = DEFAULT, total: float | None = None, seed: int = 11, langs: dict[str, float] | None = None, subjects: dict[str, float] | None = None, found: Topics | None = None) -> DataFrame:
    """doc_id, source, tokens, repeats (at least 1): the sampled mixture.

    ``langs``, ``subjects``: wanted shares of languages and of topics (named as by ``Topics.of``); without them those of the
    documents. ``found``: topics fitted before; without it they are fitted on the documents.
    ``targets``: source, target_share, max_repeats. A document's expected repeats are its
    cell's weight: the whole part for sure, the rest by a uniform number that depends on
    doc_id and seed only. That number's threshold is calibrated per source, so that the tokens
    meet the source's share up to about one document. Documents of no wanted source, of
    null source or without tokens are not in it.
    """
    goal = targets.select(canonical_source(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0").limit(MAX_SOURCES + 1).collect()
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    share, cap = {r.s: float(r.target_share) for r in goal}, {r.s: float(r.max_repeats or 1) for r in goal}
    rows = counted(spread(docs), doc, text, path)
    if found is None:
        rows = stored(rows)
        found = fitted(rows, path)
    size = checkpoint(sized(rows, found))
    spark = docs.sparkSession
    wanted = size.where(F.col("source").isin(list(share)) & (F.col("tokens") > 0))
    # at most sources x languages x topics rows
    cells = wanted.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()
    cells, total = rake(cells, share, cap, total, langs=langs, subjects=subjects)
    if not len(cells):
        return wanted.select("doc_id", "source", "tokens", F.lit(1).alias("repeats")).limit(0)
    table = spark.createDataFrame(cells[["source", "lang", "topic", "weight"]], "source string, lang string, topic string, weight double")
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    drawn = wanted.join(F.broadcast(table), ["source", "lang", "topic"]).withColumn("whole", F.floor(F.col("weight") + 1e-9).cast("int")).withColumn("part", F.greatest(F.col("weight") - F.col("whole"), F.lit(0.0)))
    drawn = drawn.withColumn("v", F.when(F.col("part") > 1e-9, u / F.col("part")))
    # v below 1: drawn. Calibration moves 1 per source so that the drawn tokens meet the target.
    bin_ = F.least(F.floor(F.col("v") * (BINS // 4)), F.lit(BINS - 1)).cast("int")
    hist = drawn.groupBy("source", bin_.alias("bin")).agg(F.sum(F.col("tokens") * F.when(F.col("v").isNotNull(), 1).otherwise(0)).alias("part"), F.sum(F.col("tokens") * F.col("whole")).alias("whole")).toPandas()
    target = (cells.weight * cells.tokens).groupby(cells.source).sum()
    edge = []
    for s, h in hist.groupby("source"):
        need = target[s] - float(h.whole.sum())
        h = h[h.bin.notna()].sort_values("bin")
        cum = np.concatenate([[0], np.cumsum(h.part.to_numpy(float))])
        k = int(np.abs(cum - need).argmin())
        edge.append((s, 0.0 if k == 0 else float(h.bin.iloc[k - 1] + 1) / (BINS // 4)))
    edges = spark.createDataFrame(edge, "source string, edge double")
    out = drawn.join(F.broadcast(edges), "source")
    top = F.create_map(*[x for s in cap for x in (F.lit(s), F.lit(int(cap[s])))])
    repeats = F.least(F.col("whole") + F.when(F.col("v") < F.col("edge"), 1).otherwise(0), F.element_at(top, F.col("source"))).cast("int")
    return out.select("doc_id", "source", "tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, actual_share, documents, most_repeats: one row per wanted source."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    goal = targets.select(canonical_source(F.col("source")).alias("source"), "target_share").where("source is not null")
    got = got.withColumn("all", F.sum("tokens").over(Window.partitionBy()))  # one row per source
    return goal.join(got, "source", "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
