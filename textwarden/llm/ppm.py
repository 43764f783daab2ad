"""Prediction by partial matching over bytes, one model per class, scored for whole batches at once.

Every context of up to ``ORDER`` bytes has the counts of the bytes that followed it in the
training text. A byte is coded from the longest known context; where it never followed
there, an escape (by the number of distinct followers: method C) leads to the next
shorter one, down to all bytes alike. The counts are frozen after training, so the code
length of a text is exact and depends on nothing but the text. Contexts and (context,
byte) pairs are looked up in open-addressing tables with one row for all classes.
"""

from __future__ import annotations

import numpy as np

ORDER = 4
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Table:
    """uint64 keys -> row numbers; built once, read by whole arrays."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(len(keys) * 2 + 1))))
        self.mask = np.uint64(size - 1)
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, rows = keys, np.arange(len(keys), dtype=np.int32)
        slot = mix(left) & self.mask
        while len(left):
            free = self.rows[slot] < 0
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.rows[slot[take]] = left[take], rows[take]
            left, rows, slot = left[~take], rows[~take], (slot[~take] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = mix(keys) & self.mask
        out = self.rows[slot]
        bad = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(bad):
            slot[bad] = (slot[bad] + np.uint64(1)) & self.mask
            out[bad] = self.rows[slot[bad]]
            bad = bad[(out[bad] >= 0) & (self.keys[slot[bad]] != keys[bad])]
        return out


def _contexts(data: np.ndarray, order: int) -> np.ndarray:
    """Key of the ``order`` bytes before each position (positions before the start count as byte 0)."""
    key = np.full(len(data), order + 1, np.uint64)
    for j in range(order, 0, -1):
        before = np.zeros(len(data), np.uint64)
        before[j:] = data[:-j] if j else data
        key = (key << np.uint64(8)) | before
    return key


class PPM:
    """``levels``: for each order the known (context, byte) pairs with their whole cost under each class, escapes to
    shorter contexts included, and the known contexts with the cost of their escape. A byte is therefore one look-up
    at the longest context after which any class knows it, plus one per longer context."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.classes, self.order = sorted(texts), order
        self.levels = []
        data = {c: np.frombuffer(("\n".join(["", *texts[c], ""])).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64) for c in self.classes}
        shorter: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(order + 1):
            pairs, contexts = [], []
            for c in self.classes:
                key = _contexts(data[c], k)[k:]
                pair, n = np.unique((key << np.uint64(8)) | data[c][k:], return_counts=True)
                pairs.append((pair, n))
                ctx, start = np.unique(pair >> np.uint64(8), return_index=True)
                total = np.add.reduceat(n, start) if len(n) else n
                contexts.append((ctx, total, np.diff(np.append(start, len(pair)))))
            all_ctx = np.unique(np.concatenate([x[0] for x in contexts]))
            all_pair = np.unique(np.concatenate([x[0] for x in pairs]))
            escape = np.zeros((len(all_ctx), len(self.classes)), np.float32)  # an unknown context costs nothing
            cost = np.full((len(all_pair), len(self.classes)), np.nan, np.float32)
            for j, ((pair, n), (ctx, total, distinct)) in enumerate(zip(pairs, contexts, strict=True)):
                escape[np.searchsorted(all_ctx, ctx), j] = -np.log2(distinct / (total + distinct))
                at = np.searchsorted(ctx, pair >> np.uint64(8))
                cost[np.searchsorted(all_pair, pair), j] = -np.log2(n / (total[at] + distinct[at]))
            # where a class does not know the pair: its escape, and the pair's whole cost one order below
            if shorter is None:
                below = np.full(cost.shape, np.float32(8))
            else:
                known = (all_pair & np.uint64((1 << 8 * k) - 1)) | np.uint64(k << 8 * k)  # without the first byte, marked as of order k - 1
                below = shorter[1][np.searchsorted(shorter[0], known)]
            cost = np.where(np.isnan(cost), escape[np.searchsorted(all_ctx, all_pair >> np.uint64(8))] + below, cost)
            shorter = all_pair, cost
            self.levels.append((Table(all_ctx), escape, Table(all_pair), cost))

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of each byte under each class; data: uint64 bytes."""
        out = np.zeros((len(data), len(self.classes)), np.float32)
        todo = np.arange(len(data))
        for k in range(self.order, -1, -1):
            ctx_table, escape, pair_table, cost = self.levels[k]
            key = _contexts(data, k)[todo]
            pair = pair_table.find((key << np.uint64(8)) | data[todo])
            hit = pair >= 0
            out[todo[hit]] += cost[pair[hit]]
            todo, key = todo[~hit], key[~hit]
            if not len(todo):
                return out
            ctx = ctx_table.find(key)
            out[todo[ctx >= 0]] += escape[ctx[ctx >= 0]]
        out[todo] += np.float32(8)
        return out

    def score(self, segments: list[str]) -> np.ndarray:
        """Bits of each segment under each class. ``order`` zero bytes, which are not counted, keep the segments out of each other's contexts."""
        parts = [("\n" + s + "\n").encode("utf-8", "surrogatepass") for s in segments]
        if not parts:
            return np.zeros((0, len(self.classes)), np.float32)
        gap = bytes(self.order)
        data = np.frombuffer(gap + gap.join(parts), np.uint8).astype(np.uint64)
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes + self.order) - sizes
        bounds = np.stack([starts, starts + sizes], 1).ravel()[:-1]  # sums of the segments and of the gaps after them
        return np.add.reduceat(self.bits(data), bounds, axis=0)[::2]
