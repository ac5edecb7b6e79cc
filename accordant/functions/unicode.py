"""Which texts Unicode composition or case folding can change, told by character classes.

The classes are made from the interpreter's Unicode tables.  A text of safe characters only is left
alone by the function, so it need not leave the JVM; any other text may still turn out unchanged.
"""

from __future__ import annotations

import unicodedata
from functools import cache

LAST = 0x10FFFF
SURROGATES = range(0xD800, 0xE000)
# Ranges of at least so many characters are tested on their own, one after the other.
LARGE = 48


@cache
def changed_by_composition() -> frozenset[int]:
    """Code points that NFKC changes, moves, or joins with the character before them."""
    out = set()
    for c in range(0x80, LAST + 1):
        ch = chr(c)
        if c in SURROGATES:
            out.add(c)
        elif unicodedata.combining(ch) or unicodedata.normalize("NFKC", ch) != ch:
            out.add(c)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(int(parts[1], 16))
    # The vowels and final consonants that join to syllables by rule: second letters of decomposed syllables.
    for c in range(0xAC00, 0xD7A4):
        out.update(map(ord, unicodedata.normalize("NFD", chr(c))[1:]))
    return frozenset(out)


@cache
def changed_by_folding() -> frozenset[int]:
    """Code points whose case folding is not their lower case, or depends on the place or the Unicode version.

    The sharp s is not among them: after lower-casing it is replaced by two letters, as folding does.
    """
    out = {0x3A3, *SURROGATES}
    for c in range(0x80, LAST + 1):
        ch = chr(c)
        lower = ch.lower().replace("ß", "ss")
        recent = unicodedata.ucd_3_2_0.category(ch) == "Cn"
        if ch.casefold() != lower or len(ch.lower()) > 1 or (recent and lower != ch):
            out.add(c)
    return frozenset(out)


def _ranges(points: frozenset[int]) -> list[tuple[int, int]]:
    """Runs of code points from U+0080 on that are not in ``points``."""
    out, start = [], 0x80
    for c in sorted(points):
        if c > start:
            out.append((start, c - 1))
        start = max(start, c + 1)
    if start <= LAST:
        out.append((start, LAST))
    return out


def _class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@cache
def safe_pattern(kind: str) -> str:
    """A Java pattern for whole texts that ``kind`` ('composition' or 'folding') leaves alone.

    Runs of ASCII and of the large ranges are passed by one comparison a character.
    """
    points = {"composition": changed_by_composition, "folding": changed_by_folding}[kind]()
    ranges = _ranges(points)
    large = [r for r in ranges if r[1] - r[0] >= LARGE]
    small = [r for r in ranges if r[1] - r[0] < LARGE]
    runs = [r"[\x00-\x7F]++", *[f"{_class([r])}++" for r in large], *([f"{_class(small)}++"] if small else [])]
    return r"\A(?:" + "|".join(runs) + r")*+\z"
