"""Confusables skeleton: decompose, replace by prototype, decompose again.

``skeleton`` keeps every visible difference (accents, letter case, vowel signs,
punctuation, number of spaces, tabs, line breaks) and removes the invisible ones.
``fold_chars`` is the aligned one-character-per-character form that the models
use, so that spans found on it are spans of the stored text.
"""

from __future__ import annotations

import unicodedata

# Letters of other scripts and the Latin letter that they look like.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ґ": "r", "г": "r", "ӕ": "æ", "ә": "ǝ",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I", "З": "3",
    # Greek
    "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian and Latin letters of other alphabets
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "յ": "j", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ⅼ": "l", "ⲟ": "o", "ꜱ": "s", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    # Marks drawn alike
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "⁃": "-", "ꓸ": ".", "․": ".", "ǃ": "!", "ʹ": "'", "ʼ": "'", "∕": "/", "⁄": "/", "∶": ":", "ː": ":",
    # Devanagari letters that equal a letter with a vowel sign
    "ऄ": "अॆ", "आ": "अा", "ऑ": "अाॅ", "ऒ": "अाॆ", "ओ": "अाे", "औ": "अाै", "ऍ": "एॅ", "ऎ": "एॆ", "ऐ": "एे",
    "ॉ": "ाॅ", "ॊ": "ाॆ", "ो": "ाे", "ौ": "ाै",
}
#: Compatibility forms that look like their plain form; super- and subscripts, circles and fractions do not.
_SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def invisible(c: str) -> bool:
    """Zero-width and format characters, variation selectors and fillers."""
    return (unicodedata.category(c) == "Cf" and c not in "؀؁؂؃") or 0xFE00 <= ord(c) <= 0xFE0F or c in "͏ᅟᅠㅤﾠ᠋᠌᠍"


class _Prototype(dict):
    """Code point -> replacement, filled on demand (for ``str.translate``)."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if invisible(c):
            to = ""
        elif unicodedata.category(c) == "Zs":
            to = " "
        elif c in LOOKALIKES:
            to = LOOKALIKES[c]
        else:
            kind = unicodedata.decomposition(c)
            to = c
            if kind.startswith(_SAME_LOOK) and not unicodedata.normalize("NFKD", c).startswith(" "):
                to = "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c))
        self[code] = to
        return to


_PROTOTYPE = _Prototype()


def load_table(path: str) -> _Prototype:
    """Prototypes of this module with those of a file in the public format of confusables added: ``source ; target ; class``, code
    points in hexadecimal, # begins a comment. What this module keeps apart (ASCII characters from each other, and what is
    invisible) stays as it is; chains of the file are followed to their end."""
    found: dict[int, str] = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            part = line.split("#")[0].split(";")
            if len(part) >= 2 and part[0].strip():
                source, target = ("".join(chr(int(x, 16)) for x in p.split()) for p in part[:2])
                if len(source) == 1 and not source.isascii() and not invisible(source):
                    found[ord(source)] = target
    out = _Prototype()
    for code in found:
        seen, to = {code}, found[code]
        while len(to) == 1 and ord(to) in found and ord(to) not in seen:
            seen.add(ord(to))
            to = found[ord(to)]
        out[code] = unicodedata.normalize("NFD", to).translate(_PROTOTYPE)
    return out


def skeleton(text: str | None, table: _Prototype = _PROTOTYPE) -> str | None:
    """The one form of all texts that look alike; null stays null."""
    if text is None:
        return None
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


class _One(dict):
    """Code point -> one code point: its prototype without marks; U+200B for what is invisible."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if invisible(c) or 0x300 <= code < 0x370:
            to = 0x200B
        elif 0x900 <= code < 0x980:
            to = code
        else:
            s = skeleton(c) or c
            to = ord(s[0])
        self[code] = to
        return to


_ONE = _One()


def fold_chars(text: str) -> str:
    """As ``skeleton``, but as many characters as the text has, and accents are dropped."""
    return text if text.isascii() else text.translate(_ONE)


def plain(text: str | None) -> str:
    """Skeleton in composed form, lower case, for models on words; null is empty."""
    return unicodedata.normalize("NFC", skeleton(text) or "").lower()
