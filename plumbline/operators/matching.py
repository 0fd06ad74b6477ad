"""Lexicon matching as joins.

Two ways. `held` finds which terms of a lexicon a document has, inside the row: terms whose first word
occurs are looked for longest first, and what one term takes no other takes. `matches` gives places: each
position at which a term stands becomes a row, which is joined with the lexicon; where
matches overlap the longest stands (then the first), as an anti-join within the document. Terms are matched by
words, so punctuation inside a term doesn't count.
"""

from __future__ import annotations

import re
import zlib
from functools import partial

from plumbline.functions import lexicon as L
from plumbline.functions.dialect import Spark
from plumbline.operators import measures
from plumbline.plans.catalog import operator

#: Terms of a lexicon that may be broadcast.
BROADCAST_TERMS = 20_000


def rows_of(families: dict[str, dict[str, tuple[float, list[str]]]]) -> list[tuple]:
    """(family, category, confidence, term, words, first, n) of each term; a term is listed once for
    each category that has it."""
    out = []
    for family, categories in families.items():
        for category, (confidence, terms) in categories.items():
            for term in terms:
                words = re.findall(r"\w+", term.lower())
                if words:
                    out.append((family, category, float(confidence), term.lower(), " ".join(words), words[0], len(words)))
    return sorted(set(out))


#: Frequent words of the test corpus's four languages, in the place of a lexicon that it never uses.
CORPUS_LEXICON = {"corpus": {"articles": (0.5, ["the", "la", "le", "der", "die", "el", "los"]), "links": (0.6, ["and the", "of the", "de la", "und der", "que la", "the thin", "in the"]), "others": (0.4, ["of", "de", "que", "und", "est", "in the of", "and", "thin"])}}


def full_lexicon() -> dict:
    return {
        "buzzword": {t: (L.BUZZWORD_CONFIDENCE[t], w) for t, w in L.BUZZWORDS.items()},
        "phrase": L.PHRASES,
        "multilingual": {k: (0.7, v) for k, v in L.MULTILINGUAL.items()},
        "authority": {"fake_authority": (0.8, L.AUTHORITY)},
    }


def held(q: Spark, categories: dict[str, tuple[float, list[str]]], w: str = "w") -> str:
    """Array of the categories' names, one for each different word sequence of theirs that the words w hold; of terms
    that overlap the longest (then the first in order) counts. A sequence of several categories counts for each."""
    names: dict[str, set[str]] = {}
    for _, category, _, _, words, *_ in rows_of({"f": categories}):
        names.setdefault(words, set()).add(category)
    terms = sorted(names, key=lambda t: (-len(t), t))
    entries = [f"{t.split()[0]}| {t.replace(' ', '  ')} | {''.join(f'<{c}>' for c in sorted(names[t]))}#{i}# " for i, t in enumerate(terms)]
    firsts = q.common(w, q.array_of(sorted({t.split()[0] for t in terms})))
    able = q.let(firsts, "y", q.filter(q.array_of(entries), "x", q.contains("y", q.part("x", 1))))
    line = f"concat(' ', {q.join(w, '  ')}, ' ')"
    # Each term leaves its marks once or more: marks carry the term's number, so that they are told apart.
    marked = q.fold(able, line, f"replace(s, {q.part('x', 2)}, {q.part('x', 3)})")
    marks = q.distinct(q.all(marked, "(?:<[^<>]*>)+#[0-9]+#"))
    return q.captured(q.join(marks, ""), "<([^<>]*)>")


def of(q: Spark, names: str, *categories: str) -> str:
    """How many of the names are one of the categories."""
    return q.size(q.filter(names, "x", " OR ".join(f"x = {q.lit(c)}" for c in categories)))


def matches(q: Spark, families: dict, source: str = "prep", suppress: bool = True) -> str:
    """CTEs lexicon, found and kept: (doc_id, family, category, confidence, term, pos, n). Overlaps are
    settled within a family, as each family is matched on its own. The source has t and its words w; Spark looks for
    the terms in t (see measures)."""
    rows = rows_of(families)
    if q.name == "spark":
        run = q.measured("t", f"plumbline_runs_{zlib.crc32(repr(rows).encode()):08x}", partial(measures.runs, measures.by_first(r[4] for r in rows)), measures.RUNS, once=False)
        places = q.explode("doc_id", f"(SELECT doc_id, {run} AS gs FROM {source}) r", "gs", "nth", "v")
        return f"""lexicon AS {q.values(rows, ["family", "category", "confidence", "term", "words", "first", "n"])}, runs0 AS ({places}), runs AS (SELECT doc_id, v.pos AS pos, v.words AS words FROM runs0),
found AS (SELECT {"/*+ BROADCAST(l) */ " if len(rows) <= BROADCAST_TERMS else ""}r.doc_id, l.family, l.category, l.confidence, l.term, l.words, r.pos, l.n FROM runs r JOIN lexicon l ON r.words = l.words),
kept AS ({settled(suppress)})"""
    lex, span = q.values(rows, ["family", "category", "confidence", "term", "words", "first", "n"]), max(r[-1] for r in rows)
    n, firsts = q.size("z.w"), q.array_of(sorted({r[-2] for r in rows}))
    able = q.filter(f"range(1, {n} + 1)", "i", q.contains("z.fw", "list_extract(z.w, i)"))
    both = f"{{'w': w, 'fw': {q.common('w', firsts)}}}"
    exploded = q.explode("doc_id", f"(SELECT doc_id, {q.let(both, 'z', q.map(able, 'i', f"{{'at': i - 1, 'run': list_slice(z.w, i, i + {span - 1})}}"))} AS gs FROM {source}) r", "gs", "nth", "v")
    return f"""lexicon AS {lex}, runs0 AS ({exploded}), runs AS (SELECT doc_id, v.at AS pos, v.run AS g FROM runs0),
found AS (SELECT r.doc_id, l.family, l.category, l.confidence, l.term, l.words, r.pos, l.n FROM runs r JOIN lexicon l ON {q.at('g', 1)} = l.first AND {q.join('list_slice(g, 1, l.n)', ' ')} = l.words),
kept AS ({settled(suppress)})"""


def settled(suppress: bool) -> str:
    if not suppress:
        return "SELECT * FROM found"
    return """SELECT a.* FROM found a LEFT JOIN (SELECT DISTINCT a.doc_id, a.family, a.term, a.pos FROM found a JOIN found b
ON a.doc_id = b.doc_id AND a.family = b.family AND a.pos < b.pos + b.n AND b.pos < a.pos + a.n
AND (length(b.words) > length(a.words) OR (length(b.words) = length(a.words) AND b.pos < a.pos))) x
ON a.doc_id = x.doc_id AND a.family = x.family AND a.term = x.term AND a.pos = x.pos WHERE x.doc_id IS NULL"""


def lean(q: Spark, text: str = "text") -> str:
    from plumbline.functions import expressions as E

    return f"WITH src AS (SELECT doc_id, coalesce({text}, '') AS t FROM documents), prep AS (SELECT doc_id, t, {E.tokens(q, 't')} AS w FROM src)"


#: Sentences in the published examples' style; document d gets number d modulo their count.
SEEDS = [
    "",
    "In conclusion, we delve into a rich tapestry of robust ideas and unlock the power of synergy. Moreover, studies have shown that it works.",
    "Experts agree, and many believe, that experts say the paradigm shift is pivotal; let that sink in. Full stop.",
    "It's worth noting that, needless to say, it's important to note the flywheel and the north star. At the end of the day, remember that.",
    "Il est important de noter que, en somme, force est de constater le paysage. Zusammenfassend lässt sich sagen: es gilt zu beachten.",
    "The holy grail of best practices is a beacon of hope, a sea of actionable insights. Research shows recent studies agree. Researchers discovered it.",
    "A plain remark about the weather in March.",
]


def seeded(q: Spark, seeds: list[str] = SEEDS, text: str = "text") -> str:
    """The text with the document's example sentence, if the dialect says so."""
    if not q.seeds:
        return f"coalesce({text}, '')"
    cases = " ".join(f"WHEN {i} THEN {q.lit(' ' + s)}" for i, s in enumerate(seeds) if s)
    return f"concat(coalesce({text}, ''), CASE doc_id % {len(seeds)} {cases} ELSE '' END)"


@operator()
def lexicon_match_counts(q):
    return f"{lean(q)}, {matches(q, CORPUS_LEXICON, suppress=False)} SELECT doc_id, category, term, count(*) AS n FROM kept GROUP BY doc_id, category, term"


@operator()
def lexicon_overlap_suppressed(q):
    return f"{lean(q)}, {matches(q, CORPUS_LEXICON)} SELECT doc_id, category, term, count(*) AS n FROM kept GROUP BY doc_id, category, term"


@operator()
def lexicon_first_spans(q):
    """The first place of each term in each document, in words."""
    return f"{lean(q)}, {matches(q, CORPUS_LEXICON)} SELECT doc_id, term, min(pos) AS first_pos, max(pos) AS last_pos FROM kept GROUP BY doc_id, term"


@operator()
def lexicon_guard_window(q):
    """Links that have an article at most six words before them."""
    return f"""{lean(q)}, {matches(q, CORPUS_LEXICON, suppress=False)}
SELECT m.doc_id, m.term, count(DISTINCT m.pos) AS n FROM kept m JOIN kept g ON m.doc_id = g.doc_id AND m.pos - g.pos BETWEEN 1 AND 6
WHERE m.category = 'links' AND g.category = 'articles' GROUP BY m.doc_id, m.term"""


@operator()
def buzzwords_by_tier_seeded(q):
    lex = {"buzzword": full_lexicon()["buzzword"]}
    return f"""{lean(q, seeded(q))}, {matches(q, lex)}
SELECT doc_id, category AS tier, count(DISTINCT term) AS n_terms, {q.collect('term', ',')} AS terms FROM kept GROUP BY doc_id, category"""


@operator()
def phrases_by_category_seeded(q):
    """Distinct phrases of a category, and how many of them count: all from the category's minimum on."""
    least = "CASE " + " ".join(f"WHEN category = '{c}' THEN {n}" for c, n in L.RAISED_MIN_HITS.items()) + f" ELSE {L.PHRASE_MIN_HITS} END"
    return f"""{lean(q, seeded(q))}, {matches(q, {'phrase': L.PHRASES})},
c AS (SELECT doc_id, category, count(DISTINCT term) AS n, {q.collect('term', ',')} AS terms FROM kept GROUP BY doc_id, category)
SELECT doc_id, category, n, terms, CASE WHEN n >= {least} THEN n ELSE 0 END AS effective FROM c"""


@operator()
def multilingual_markers_seeded(q):
    lex = {f"multilingual_{k}": {k: (0.7, v)} for k, v in L.MULTILINGUAL.items()}
    return f"{lean(q, seeded(q))}, {matches(q, lex)} SELECT doc_id, category AS lang, count(DISTINCT term) AS n, {q.collect('term', ',')} AS terms FROM kept GROUP BY doc_id, category"


@operator()
def lexicon_stats(q):
    return f"SELECT family, category, count(*) AS n_terms, max(n) AS longest FROM {q.values(rows_of(full_lexicon()), ['family', 'category', 'confidence', 'term', 'words', 'first', 'n'])} l GROUP BY family, category"


@operator()
def exempt_terms_stripped_seeded(q):
    """Terms that a genre exempts are deleted from the text that signals read."""
    from plumbline.functions import expressions as E

    allowed = ["robust", "synergy", "tapestry"]
    x = q.sub("lower(t)", f"({E.EDGE})(?:{'|'.join(allowed)})({E.EDGE})", "$1$2")
    return f"{lean(q, seeded(q))} SELECT doc_id, length(t) - length({x}) AS removed, {q.sha256(x)} AS signal_sha256 FROM prep"

