"""Folding of text before pattern matching: case, accents, look-alike letters, digits for letters."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v",
    "ԝ": "w", "х": "x", "у": "y", "ᴢ": "z", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "ſ": "s",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Characters without width that split words unseen.
UNSEEN = "­​‌‍⁠﻿"


def _plain(c: str) -> str | None:
    """The Latin letters of a character with accents or in compatibility form, or None."""
    base = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
    base = "".join(LOOKALIKES.get(x, x) for x in base)
    return base if base != c else None


def folding() -> dict[int, str]:
    """Translation table for ``str.translate``: one character to its folded form. Digits stay;
    whether one stands for a letter depends on its neighbours (``fold``)."""
    table = {ord(a): b for a, b in LOOKALIKES.items()}
    table |= {ord(a.upper()): b for a, b in LOOKALIKES.items() if len(a.upper()) == 1}
    spans = ((0x41, 0x5B), (0xC0, 0x250), (0x1E00, 0x1F00), (0x370, 0x530), (0xFF21, 0xFF5B), (0x1D400, 0x1D800))
    for code in (c for a, b in spans for c in range(a, b)):
        if code not in table and (plain := _plain(chr(code))) is not None:
            table[code] = plain
    return table | {ord(c): "" for c in UNSEEN}


TABLE = folding()


#: A run of letters and stand-ins with at least one of each.
_MIXED = re.compile(r"(?<![a-z0134578@$])(?:[a-z]++[0134578@$]|[0134578@$]++[a-z])[a-z0134578@$]*")
_LETTERS = {ord(a): b for a, b in SUBSTITUTES.items()}
_BREAK = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Case, accents and look-alikes folded; digits and signs inside words become letters."""
    return _MIXED.sub(lambda m: m[0].translate(_LETTERS), text.translate(TABLE))


def folded_words(text: str) -> str:
    """The folded words of a text, each with a blank before and after it."""
    words = _BREAK.sub(" ", fold(text)).strip()
    return f" {words} " if words else " "
