"""What the scores need of a text, counted in Python in one pass: words, sentences and lines are made once, where expressions of SQL make
them again for each count. Formulas stay SQL; these are the integers and flags in them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from itertools import chain

from plumbline.functions import expressions as E
from plumbline.functions import lexicon as L
from plumbline.functions import texts as T

DASHES = (chr(0x2013), chr(0x2014))


def marks(text: str) -> tuple[int, int, int]:
    """Dashes, ellipses and exclamation marks."""
    return sum(map(text.count, DASHES)), text.count("..."), text.count("!")


SEVEN = "struct<words int, distinct_ int, most_ int, sents int, rows_ int, ns int, k_sum long, k_squares long, hits int, em int, ell int, bang int, moral boolean, n_lines int, n_listed int>"
SEVEN_MORALS = ["remember that", "in the end", "ultimately", "the lesson is", "what matters most", "at the end of the day", "it's important to remember"]
SHORT_ENDERS = re.compile("[.!?\n]+")
SHORT = [w for tier in L.SHORT_BUZZWORDS.values() for w in tier]


def seven(text: str) -> tuple:
    """Of structure.seven."""
    low, lines = text.lower(), T.trimmed(text).split("\n")
    counts = Counter(T.words(low))
    k = [T.white(y) for y in T.sentences(text)]
    end = T.trimmed(low)[-200:]
    hits = sum(T.stands(low, w) for w in SHORT)
    moral = any(T.stands(end, m) for m in SEVEN_MORALS)
    sents = sum(1 for y in SHORT_ENDERS.split(text) if T.trimmed(y))
    rows = sum(1 for y in lines if T.trimmed(y))
    return (counts.total(), len(counts), max(counts.values(), default=0), sents, rows, len(k), *T.spread(k), hits, *marks(text), moral, len(lines), sum(map(T.listed, lines)))


def held(categories: dict[str, tuple[float, list[str]]]) -> Callable[[set[str], str], list[str]]:
    """matching.held as a function of a text's words and of its words with two blanks between and one around."""
    from plumbline.operators.matching import rows_of

    names: dict[str, set[str]] = {}
    for _, category, _, _, words, *_ in rows_of({"f": categories}):
        names.setdefault(words, set()).add(category)
    order = sorted(names, key=lambda t: (-len(t), t))
    entries = [(t.split()[0], f" {t.replace(' ', '  ')} ", sorted(names[t])) for t in order]

    def run(present: set[str], line: str) -> list[str]:
        out = []
        for first, term, found in entries:
            if first in present and term in line:
                line = line.replace(term, " # ")
                out += found
        return out

    return run


def lexicons() -> list[Callable]:
    from plumbline.operators.matching import full_lexicon

    lex = full_lexicon()
    return [held(lex[f]) for f in ("buzzword", "phrase", "multilingual", "authority")]


_lexicons: list[Callable] = []


def terms(words: list[str]) -> list[list[str]]:
    """Categories of the terms of each lexicon that the words hold."""
    if not _lexicons:
        _lexicons.extend(lexicons())
    present, line = set(words), f" {'  '.join(words)} "
    return [find(present, line) for find in _lexicons]


TERMS = "hb array<string>, hp array<string>, hm array<string>, ha array<string>"
SIGNALS = f"struct<{TERMS}, ns int, k_sum long, k_squares long, em int, ell int, bang int, moral boolean, n_lines int, n_listed int>"


def signals(text: str) -> tuple:
    """Of scoring.signals."""
    low, lines = text.lower(), T.trimmed(text).split("\n")
    k = [T.white(y) for y in T.sentences(text)]
    end = T.trimmed(low)[-200:]
    return (*terms(T.tokens(low)), len(k), *T.spread(k), *marks(text), any(m in end for m in L.MORALS[:7]), len(lines), sum(map(T.listed, lines)))


DIMENSIONS = f"struct<{TERMS}, nw int, distinct_ int, most_ int, ns int, n_sum long, n_squares long, em int, ell int, bang int, prov int, moral boolean, n_lines int, n_listed int, a int, z int, common_ int, portable_ int>"
UPPER = "A-Z" + "".join(map(chr, (0xC4, 0xD6, 0xDC, 0xC0))) + "-" + chr(0xDE)
UPPERS, INNER = re.compile(f"[{UPPER}]"), re.compile(f"[^{T.SPACE}]+[{UPPER}]")
CONCRETE = re.compile("[0-9\"'`/@" + "".join(map(chr, (0xAB, 0xBB, 0x201E))) + "]|http|www[.]")
STOPWORDS = set(L.STOPWORDS)


def portable(s: str) -> bool:
    """structure.portable of a sentence."""
    if CONCRETE.search(s) or INNER.match(s):
        return False
    gap = T.SOLID.match(s)
    begin = gap.end() if gap else 0
    return not any(not T.word_pattern(0x10FFFF).match(s[m.start() - 1]) for m in UPPERS.finditer(s, begin + 1))


def provenance(text: str) -> int:
    from plumbline.operators.scoring import PROVENANCE

    gates = {"turn_search": "search", "citation_artifact": ":contentReference[", "placeholder_date": "-XX-XX"}
    edge = f"[^{T.word_class(0x10FFFF)}]"
    return sum(len(re.findall(T.python(p).replace(E.EDGE, edge), text)) for n, p in PROVENANCE.items() if (gates[n] in text if n in gates else not text.isascii()))


def dimensions(text: str) -> tuple:
    """Of scoring.dimensions. Words of a text are those of its sentences, as no word holds an end."""
    low, lines, s = text.lower(), T.trimmed(text).split("\n"), T.sentences(text)
    parts = [T.tokens(y) for y in T.ENDERS.split(low) if T.trimmed(y)]
    words = list(chain.from_iterable(parts))
    counts = Counter(words)
    a = z = common = 0
    if len(s) >= 4:
        first, last = (set(T.words(y.lower())) - STOPWORDS for y in (s[0], s[-1]))
        a, z, common = len(first), len(last), len(first & last)
    end = T.trimmed(low)[-200:]
    moral = any(T.stands(end, m) for m in L.MORALS)
    return (*terms(words), counts.total(), len(counts), max(counts.values(), default=0), len(s), *T.spread(list(map(len, parts))), *marks(text), provenance(text), moral, len(lines), sum(map(T.listed, lines)), a, z, common, sum(map(portable, s)))


RUNS = "array<struct<pos int, words string>>"


def by_first(terms: Iterable[str]) -> dict[str, list[tuple[list[str], str]]]:
    """Word sequences of a lexicon by their first word."""
    out: dict[str, list[tuple[list[str], str]]] = {}
    for term in sorted(set(terms)):
        out.setdefault(term.split()[0], []).append((term.split(), term))
    return out


def runs(lexicon: dict[str, list[tuple[list[str], str]]], text: str) -> list[tuple[int, str]]:
    """Places, in words from 0, at which sequences of the lexicon stand."""
    words = T.tokens(text.lower())
    return [(i, term) for i, w in enumerate(words) if w in lexicon for parts, term in lexicon[w] if words[i : i + len(parts)] == parts]


RHETORIC = "struct<n_kept int, short_run int, same_opening int, nw int, em int, pairs int, recap boolean, throat boolean, cycling boolean, insight boolean, puffery boolean, frames boolean, heads boolean, bold boolean, quotes boolean, bars boolean, needs array<boolean>>"
QUOTES, BARS = (chr(0x201C), chr(0x201D)), ("|", chr(0x2022))
PAIR = re.compile(f"(?:^|[{T.SPACE}])[a-z]+-[a-z]+(?:[{T.SPACE},.]|$)")


def rhetoric(text: str) -> tuple:
    """Of signals.rhetorical_findings_seeded."""
    from plumbline.operators import signals as S

    body = T.trimmed(text)
    kept, paras = T.kept_sentences(text), T.paragraphs(text)
    longest = run = 0
    for y in kept:
        run = run + 1 if T.white(y) <= 5 else 0
        longest = max(longest, run)
    firsts = [m.group().lower() if (m := T.SOLID.search(y)) else "" for y in kept]
    last_para, last = paras[-1].lower() if paras else "", kept[-1].lower() if kept else ""
    recap = last_para.startswith(tuple(S.RECAP_OPENERS)) or last.startswith(tuple(S.KICKER_OPENERS)) and T.white(last) <= 14
    pairs = len(set(PAIR.findall(text))) if "-" in text else 0
    low = text.lower()
    holds = lambda words: any(w in low for w in words)
    cycling = any(sum(T.stands(low, f"the {w}") for w in group) >= 2 for group in S.SYNONYM_GROUPS)
    frames = low.startswith(tuple(S.OPENER_FRAMES)) or ". " in low and any(f". {f}" in low for f in S.OPENER_FRAMES)
    found = (cycling, holds(S.INSIGHT_SETUPS), holds(S.PUFFERY), frames, "#" in text, "**" in text, any(c in text for c in QUOTES), any(c in text for c in BARS))
    return (len(kept), longest, T.most(firsts), T.white(text), marks(text)[0], pairs, recap, body.lower().startswith(tuple(S.THROAT_OPENERS)), *found, [holds(words) for words in S.NEEDED])
