"""Splitting texts as the public tokenizers do, fast and exactly, in plain Python.

``re`` knows no ``\\p{L}``, so its classes are written out from ``unicodedata`` for the
basic plane, which ``re`` then tests by table. Characters beyond that plane, or newer than
Unicode 3.2 (where versions may disagree on the class), are "odd": a text with an odd
character is left to the tokenizers library whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: The code points the tokenizers count as white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(wanted) -> str:
    out, start = [], None
    for c in range(0x10001):
        inside = c < 0x10000 and wanted(c)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def classes() -> tuple[str, str, re.Pattern]:
    """Letters, numbers (as ranges of a ``re`` class), and a pattern that finds an odd character."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x10000)]
    old = unicodedata.ucd_3_2_0.category
    known = _ranges(lambda c: old(chr(c)) not in ("Cn", "Cs"))
    return _ranges(lambda c: kind[c] == "L"), _ranges(lambda c: kind[c] == "N"), re.compile(f"[^{known}]")


@lru_cache(maxsize=1)
def byte_level() -> re.Pattern:
    """Pre-tokens of the byte-level BPE: words, numbers, symbols with one space before."""
    a, n, _ = classes()
    w = WHITE
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[{n}]+| ?[^{w}{a}{n}]+|[{w}]+(?![^{w}])|[{w}]+")


@lru_cache(maxsize=1)
def word_level() -> re.Pattern:
    """Pre-tokens of the word-end BPE: words, single digits, symbols; white space is dropped."""
    a, n, _ = classes()
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{a}]+|[{n}]|[^{WHITE}{a}{n}]+")


def chunks(texts: list[str], limit: int = 2_000_000):
    """Index ranges of ``texts`` with about ``limit`` characters each (a longer text is alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)
