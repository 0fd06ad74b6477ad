"""Measures of one text in Python, with the same words, sentences and lines as the SQL of `expressions`: \\s is ASCII white space, a
word is a run of letters, marks, figures and _."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from functools import cache

from plumbline.functions import expressions as E

SPACE = " \t\n\x0b\f\r"
ASCII_WORD = re.compile("[A-Za-z0-9_]+")


def python(pattern: str) -> str:
    """A pattern of the SQL with its code points as re writes them."""
    return re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


CJK = re.compile(python(E.CJK))
HIGH, ASTRAL = re.compile(python(r"[\x{3040}-\x{10ffff}]")), re.compile(python(r"[\x{10000}-\x{10ffff}]"))
#: White space that str.split() cuts at and \s of the SQL doesn't.
ODD_SPACE = re.compile(python(r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"))
SOLID = re.compile(f"[^{SPACE}]+")
ENDERS = re.compile(E.ENDERS)
KEPT, BLANK_LINES = re.compile(f"([.!?])[{SPACE}]+"), re.compile(f"\n[{SPACE}]*\n")
LIST_LINE = re.compile(rf"[{SPACE}]*(?:[-*\u2022]|[0-9]+[.)])[{SPACE}]".replace("\\u2022", chr(0x2022)))


@cache
def word_class(last: int) -> str:
    """Ranges of all word characters up to the code point."""
    out, start = [], None
    for c in range(last + 2):
        inside = c <= last and (c == 0x5F or unicodedata.category(chr(c))[0] in "LMN")
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@cache
def word_pattern(last: int) -> re.Pattern:
    return re.compile(f"[{word_class(last)}]+")


def words(low: str) -> list[str]:
    """Words of a text. Characters beyond U+FFFF have a pattern of their own, as re looks through their ranges one by one."""
    if low.isascii():
        return ASCII_WORD.findall(low)
    return word_pattern(sys.maxunicode if ASTRAL.search(low) else 0xFFFF).findall(low)


def tokens(low: str) -> list[str]:
    """Words; each CJK character is one."""
    if not low.isascii() and HIGH.search(low):
        low = CJK.sub(r" \1 ", low)
    return words(low)


def trimmed(text: str) -> str:
    return text.strip(SPACE)


def white(text: str) -> int:
    """How many runs without white space."""
    return len(SOLID.findall(text)) if ODD_SPACE.search(text) else len(text.split())


def sentences(text: str) -> list[str]:
    return [y for y in map(trimmed, ENDERS.split(text)) if y]


def kept_sentences(text: str) -> list[str]:
    """Sentences with their ends: cut at white space after . ! or ?; one that holds the mark of a cut is cut there too."""
    return [y for y in KEPT.sub("\\1\x01", trimmed(text)).split("\x01") if y]


def paragraphs(text: str) -> list[str]:
    return [y for y in map(trimmed, BLANK_LINES.split(text)) if y]


def most(items: list) -> int:
    return max(Counter(items).values(), default=0)


def spread(counts: list[int]) -> tuple[int, int]:
    """Sum and sum of squares, of which SQL makes the standard deviation."""
    return sum(counts), sum(c * c for c in counts)


def stands(low: str, term: str) -> bool:
    """Whether the term is in the text as whole words."""
    at, is_word = low.find(term), word_pattern(sys.maxunicode).match
    while at >= 0:
        end = at + len(term)
        if not (at and is_word(low[at - 1])) and not (end < len(low) and is_word(low[end])):
            return True
        at = low.find(term, at + 1)
    return False


def listed(line: str) -> bool:
    return LIST_LINE.match(line) is not None
