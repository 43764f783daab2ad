"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Both directions run as one batched matrix product. A text longer than one window
is cut into overlapping windows; each character takes its scores from the window
in which it stands farthest from an edge, and one Viterbi pass over the whole
text reconciles the windows.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .fold import fold_chars

KINDS = ("email", "phone", "id_number", "address", "person_name")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
WINDOW, OVERLAP, BATCH = 160, 80, 256
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0 \n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_DEVANAGARI = [chr(c) for c in range(0x900, 0x980) if not chr(c).isdigit()]
_ID = {c: i + 3 for i, c in enumerate([*_ALPHABET, *_DEVANAGARI])}
N_CHARS = len(_ID) + 3  # 0 is padding, 1 any other character, 2 an invisible one


class _Code(dict):
    def __missing__(self, code: int) -> int:
        c = chr(code)
        low = "0" if c.isdigit() else " " if c in "\t\r\x0b\x0c" else c.lower()
        k = 2 if code == 0x200B else _ID.get(low[:1], 1)
        self[code] = 2 * k + (c != c.lower())
        return self[code]


_CODE = _Code()


def encode(text: str) -> np.ndarray:
    """One id per character: twice the letter, plus one for a capital."""
    return np.fromiter((_CODE[ord(c)] for c in fold_chars(text)), np.int32, len(text))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def transitions_allowed() -> np.ndarray:
    """I-k follows only B-k or I-k."""
    ok = np.ones((len(TAGS), len(TAGS)), bool)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            ok[:, j] = [s[1:] == t[1:] for s in TAGS]
    return ok


class Tagger:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        self.trans = np.where(transitions_allowed(), self.w["trans"], -1e4).astype(np.float32)
        # input product of every (character, case) and direction, once
        emb = np.repeat(self.w["emb"], 2, 0)
        emb = np.concatenate([emb, np.tile([[0.0], [1.0]], (len(self.w["emb"]), 1)).astype(np.float32)], 1)
        self.table = np.einsum("ve,deh->dvh", emb, self.w["wx"]).astype(np.float32) + self.w["b"][:, None]

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as z:
            return cls(dict(z))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """ids: windows x length. Returns windows x length x tags."""
        n, length = ids.shape
        u = self.w["wh"]
        hidden = u.shape[1]
        h, c = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
        out = np.empty((2, length, n, hidden), np.float32)
        for t in range(length):
            z = h @ u
            z[0] += self.table[0][ids[:, t]]
            z[1] += self.table[1][ids[:, length - 1 - t]]
            g = np.tanh(z[..., 3 * hidden :])
            s = sigmoid(z[..., : 3 * hidden])
            c = s[..., hidden : 2 * hidden] * c + s[..., :hidden] * g
            h = s[..., 2 * hidden :] * np.tanh(c)
            # padding leaves no trace in the backward state: a window's scores don't depend on what it is batched with
            real = (ids[:, length - 1 - t] > 0)[:, None]
            h[1] *= real
            c[1] *= real
            out[0, t], out[1, length - 1 - t] = h[0], h[1]
        both = np.concatenate([out[0], out[1]], -1)
        return (both.reshape(length * n, -1) @ self.w["wo"] + self.w["bo"]).reshape(length, n, -1).transpose(1, 0, 2)

    def emissions(self, texts: list[str]) -> list[np.ndarray]:
        """Per text, length x tags, put together from overlapping windows."""
        pieces, step = [], WINDOW - OVERLAP
        for k, text in enumerate(texts):
            ids = encode(text)
            for at in range(0, max(1, len(ids) - OVERLAP), step):
                pieces.append((k, at, ids[at : at + WINDOW]))
        out = [np.zeros((len(t), len(TAGS)), np.float32) for t in texts]
        pieces.sort(key=lambda p: len(p[2]))
        for i in range(0, len(pieces), BATCH):
            part = pieces[i : i + BATCH]
            ids = np.zeros((len(part), max(1, max(len(p[2]) for p in part))), np.int32)
            for r, (_, _, x) in enumerate(part):
                ids[r, : len(x)] = x
            for (k, at, x), e in zip(part, self.scores(ids), strict=True):
                first = at + (OVERLAP // 2 if at else 0)
                last = at + len(x) if at + len(x) >= len(out[k]) else at + WINDOW - OVERLAP // 2
                out[k][first:last] = e[first - at : last - at]
        return out

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of every text, by one Viterbi pass over the whole text."""
        emissions = self.emissions(texts)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        # a text in which no character prefers a tag over O by far can't get a span that beats the all-O path cheaply; decode all alike
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            length = len(texts[part[-1]])
            if not length:
                continue
            e = np.zeros((len(part), length, len(TAGS)), np.float32)
            e[:, :, 1:] = -1e4  # beyond the end only O
            for r, k in enumerate(part):
                e[r, : len(texts[k])] = emissions[k]
            score = e[:, 0] + np.where([t[0] == "I" for t in TAGS], np.float32(-1e4), np.float32(0))
            back = np.zeros((len(part), length, len(TAGS)), np.int8)
            for t in range(1, length):
                x = score[:, :, None] + self.trans
                back[:, t] = x.argmax(1)
                score = x.max(1) + e[:, t]
            path = np.zeros((len(part), length), np.int8)
            path[:, -1] = score.argmax(1)
            rows = np.arange(len(part))
            for t in range(length - 1, 0, -1):
                path[:, t - 1] = back[rows, t, path[:, t]]
            for r, k in enumerate(part):
                out[k] = spans(path[r, : len(texts[k])])
        return out


def spans(path: np.ndarray) -> list[tuple[int, int, str]]:
    out, start, kind = [], -1, ""
    for i in np.flatnonzero(np.diff(np.concatenate([[0], path, [0]]))):
        tag = TAGS[path[i]] if i < len(path) else "O"
        if kind and tag != f"I-{kind}":
            out.append((start, int(i), kind))
            kind = ""
        if tag[0] == "B":
            start, kind = int(i), tag[2:]
    return out


def is_visible(c: str) -> bool:
    return unicodedata.category(c)[0] != "C"
