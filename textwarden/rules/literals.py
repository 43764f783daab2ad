"""What a text must contain for a pattern to match: literal words, taken from the pattern itself.

A rule whose words a text lacks is never run on it. The words are searched in the
lower-case text, byte by byte, inside generated code; most texts hold none of them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _parser as parser

MOST = 24  # more words than this are not worth their search


def _sets(tree) -> list[set[str] | None]:
    """For each part of a sequence, the words of which one must be there; None if nothing must."""
    out: list[set[str] | None] = []
    run = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            out.append({run})
            run = ""
        if name == "SUBPATTERN":
            out.append(_best(arg[3]))
        elif name == "BRANCH":
            words = [_best(x) for x in arg[1]]
            out.append(None if any(w is None for w in words) else set().union(*words))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            out.append(_best(arg[2]))
    if run:
        out.append({run})
    return out


def _best(tree) -> set[str] | None:
    good = [s for s in _sets(tree) if s and len(s) <= MOST]
    # the part with the longest shortest word, then with the fewest words
    return max(good, key=lambda s: (min(map(len, s)), -len(s)), default=None)


@lru_cache(None)
def needs(pattern: str) -> tuple[str, ...]:
    """Lower-case words of which every match holds at least one; empty if no such words are known."""
    found = _best(parser.parse(pattern))
    if not found or min(map(len, found)) < 2 or any(not w.isascii() for w in found):
        return ()
    words = {w.lower() for w in found}
    # letters that other letters fold to (the long s, the Kelvin sign) would be missed in an ignore-case match
    return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


def python_hit(pattern: str, text: str) -> bool:
    """The same test in Python, for tests."""
    w = needs(pattern)
    return not w or any(x in text.lower() for x in w) or re.search(pattern, text) is None
