"""Sizes in tokens of a public byte-level BPE; the vocabulary file is a parameter and stays outside the repository."""

from __future__ import annotations

import base64
import functools
import os

#: Where the vocabulary lies unless TEXTWARDEN_TOKENIZER or a parameter says otherwise: one for many languages, as the texts are in many.
DEFAULT = os.environ.get("TEXTWARDEN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how texts are split before merging, published with this vocabulary. Another vocabulary brings its own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(4)
def encoding(path: str = DEFAULT, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str = DEFAULT, pattern: str = PATTERN) -> list[int]:
    """The tokens of the whole text, however long its runs without white space are: the encoder merges a run in n log n steps."""
    return encoding(path, pattern).encode_ordinary(text)


@functools.lru_cache(4)
def byte_sizes(path: str = DEFAULT):
    """Bytes of each token, by its id."""
    import numpy as np

    e = encoding(path)
    out = np.zeros(e.n_vocab, np.int32)
    for b in e.token_byte_values():
        out[e.encode_single_token(b)] = len(b)
    return out
