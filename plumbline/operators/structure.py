"""Structural measures of documents: no lexicon, one pass over each text, no shuffle."""

from __future__ import annotations

from plumbline.functions import expressions as E
from plumbline.functions.dialect import Spark
from plumbline.functions.lexicon import GUARDS, INTENSIFIERS, SHORT_BUZZWORDS, STOPWORDS, SUBSTITUTE_VERBS, WEIGHTS_7
from plumbline.operators import measures
from plumbline.plans.catalog import operator


def base(q: Spark, table: str = "documents", text: str = "text", key: str = "doc_id", more: str = "") -> str:
    """CTEs: src (t: the text, null as empty), prep (tokens w, sentences s, their token counts n)."""
    return f"""WITH src AS (SELECT {key}, {more + ', ' if more else ''}coalesce({text}, '') AS t FROM {table}),
prep0 AS (SELECT *, {E.tokens(q, 't')} AS w, {E.sentences(q, 't')} AS s FROM src),
prep AS (SELECT *, {q.map('s', 'y', q.size(E.tokens(q, 'y')))} AS n FROM prep0)"""


@operator()
def doc_density(q):
    return f"""{base(q)} SELECT doc_id, {q.size('w')} AS n_tokens,
coalesce({E.ratio(q, q.size(q.distinct('w')), q.size('w'))}, 0.0) AS density FROM prep"""


@operator()
def doc_repetition(q):
    return f"{base(q)} SELECT doc_id, coalesce({E.ratio(q, q.most('w'), q.size('w'))}, 0.0) AS repetition FROM prep"


@operator()
def doc_burstiness(q):
    return f"""{base(q)} SELECT doc_id, {q.size('s')} AS n_sentences,
round(CASE WHEN {q.size('s')} < 2 THEN 0.0 ELSE {E.spread(q, 'n')} END, 6) AS burstiness FROM prep"""


@operator()
def doc_burstiness_words(q):
    n = q.map("s", "y", q.size(E.white_words(q, "y")))
    return f"""{base(q)}, b AS (SELECT doc_id, s, {n} AS k FROM prep) SELECT doc_id,
round(CASE WHEN {q.size('s')} < 2 THEN 0.0 ELSE {E.spread(q, 'k')} END, 6) AS burstiness FROM b"""


@operator()
def doc_verbosity(q):
    return f"""{base(q)}, a AS (SELECT doc_id, cast({q.size('w')} AS DOUBLE) / greatest({q.size('s')}, 1) AS mean FROM prep)
SELECT doc_id, round(mean, 6) AS mean_sentence, round(least(1.0, greatest(0.0, mean - 20) / 15), 6) AS verbosity FROM a"""


def rates(q: Spark) -> tuple[str, str, str]:
    n = f"greatest({q.size('s')}, 1)"
    return tuple(f"round(cast({q.count('t', p)} AS DOUBLE) / {n}, 3)" for p in (r"[\x{2014}\x{2013}]", r"\.\.\.", "!"))


@operator()
def doc_punctuation_rates(q):
    em, ellipsis, bang = rates(q)
    return f"{base(q)} SELECT doc_id, {em} AS em_dash_rate, {ellipsis} AS ellipsis_rate, {bang} AS exclamation_rate FROM prep"


LIST_LINE = r"^[\s]*[-*•][\s]|^[\s]*[0-9]+[.)][\s]"


@operator()
def doc_list_share(q):
    return f"""{base(q)}, l AS (SELECT doc_id, {E.lines(q, E.trim(q, 't'))} AS l FROM prep)
SELECT doc_id, {q.size('l')} AS n_lines, {E.ratio(q, q.size(q.filter('l', 'x', q.has('x', LIST_LINE))), q.size('l'))} AS list_share,
({q.size('l')} > 3 AND {q.size(q.filter('l', 'x', q.has('x', LIST_LINE)))} > 0.4 * {q.size('l')}) AS list_heavy FROM l"""


def content(q: Spark, x: str) -> str:
    return q.distinct(q.filter(q.all(f"lower({x})", E.WORD), "w", f"NOT {q.contains(q.array_of(STOPWORDS), 'w')}"))


@operator()
def doc_mirrored_overlap(q):
    return f"""{base(q)}, e AS (SELECT doc_id, {q.size('s')} AS k, {content(q, f"coalesce({q.at('s', 1)}, '')")} AS a, {content(q, f"coalesce({q.at('s', -1)}, '')")} AS z FROM prep),
o AS (SELECT doc_id, CASE WHEN k >= 4 AND {q.size('a')} >= 3 AND {q.size('z')} >= 3 THEN cast({q.size(q.common('a', 'z'))} AS DOUBLE) / least({q.size('a')}, {q.size('z')}) END AS overlap FROM e)
SELECT doc_id, round(overlap, 6) AS overlap, coalesce(overlap > 0.6, false) AS mirrored FROM o"""


def portable(q: Spark, s: str) -> str:
    """A sentence without names, figures, quotes, code or links."""
    rest = q.sub(s, r"^[^\s]+", "")
    inner = q.has(s, r"^[^\s][^\s]*[A-ZÄÖÜÀ-Þ]")
    return f"NOT ({q.has(rest, E.EDGE + '[A-ZÄÖÜÀ-Þ]')} OR {inner} OR {q.has(s, '[0-9]')} OR {q.has(s, '[\"' + chr(39) + '`«»„]|/|@|https?|www[.]')})"


@operator()
def doc_portability(q):
    p = q.size(q.filter("s", "y", portable(q, "y")))
    return f"{base(q)} SELECT doc_id, {p} AS portable_sentences, coalesce({E.ratio(q, p, q.size('s'), 3)}, 0.0) AS rate FROM prep"


@operator()
def doc_adverb_rate(q):
    """Words in -ly without intensifiers, over all words without intensifiers."""
    strong = q.array_of(INTENSIFIERS)
    ly = q.size(q.filter("w", "x", f"x LIKE '_%ly' AND NOT {q.contains(strong, 'x')}"))
    boost = q.size(q.filter("w", "x", q.contains(strong, "x")))
    return f"""{base(q)}, c AS (SELECT doc_id, {ly} AS ly_words, {boost} AS intensifiers, {q.size('w')} AS n FROM prep)
SELECT doc_id, ly_words, intensifiers, coalesce(round(cast(ly_words AS DOUBLE) / nullif(n - intensifiers, 0), 4), 0.0) AS rate,
CASE WHEN n >= 40 AND ly_words > 0.04 * (n - intensifiers) THEN CASE WHEN intensifiers >= 2 THEN 1.0 ELSE 0.5 END ELSE 0.0 END AS adverb_slop FROM c"""


@operator()
def doc_copula_rate(q):
    copula = q.size(q.filter("w", "x", "x IN ('is', 'are', 'was', 'were')"))
    joined = q.join("w", " ")
    sub = q.count(joined, "(?:^| )(?:" + "|".join(SUBSTITUTE_VERBS) + ")")
    return f"""{base(q)}, c AS (SELECT doc_id, {copula} AS copulas, {sub} AS substitutes FROM prep)
SELECT doc_id, copulas, substitutes, coalesce({E.ratio(q, 'copulas', '(copulas + substitutes)')}, 0.0) AS rate FROM c"""


def guards(q: Spark) -> str:
    """CTE g: what of the short-text minimums a document meets."""
    words = q.size(q.all("lower(t)", E.WORD))
    sents = q.size(q.filter(q.split("t", r"[.!?\n]+"), "y", E.trim(q, "y") + " <> ''"))
    rows = q.size(q.filter(q.split(E.trim(q, "t"), r"\n"), "y", E.trim(q, "y") + " <> ''"))
    return f"""g0 AS (SELECT *, {words} AS words, {sents} AS sents, {rows} AS rows_ FROM prep),
{guarded()}"""


def guarded() -> str:
    G = GUARDS
    return f"""g AS (SELECT *, words >= {G['density']} AS on_density, words >= {G['repetition']} AS on_repetition,
(sents >= {G['burst_sentences']} AND words >= {G['burst_words']}) AS on_burstiness, sents >= {G['punctuation']} AS on_punctuation,
words >= {G['trailing_moral']} AS on_moral, rows_ >= {G['list_heavy']} AS on_list FROM g0)"""


@operator()
def text_stats(q):
    return f"{base(q)}, {guards(q)} SELECT doc_id, words, sents AS sentences, rows_ AS n_lines FROM g"


@operator()
def doc_guard_status(q):
    names = ["density", "repetition", "burstiness", "punctuation", "moral", "list"]
    skipped = q.join(q.filter(q.array(*(f"CASE WHEN NOT on_{n} THEN '{n}' END" for n in names)), "x", "x IS NOT NULL"), ",")
    return f"{base(q)}, {guards(q)} SELECT doc_id, {', '.join('on_' + n for n in names)}, {skipped} AS skipped FROM g"


def seven(q: Spark, more: str = "") -> str:
    """CTEs up to scored: the 7-metric score over active metrics. Spark counts in Python (see measures); the formulas are the same."""
    W = WEIGHTS_7
    if q.name == "spark":
        counts = q.measured("t", "plumbline_seven", measures.seven, measures.SEVEN)
        made = f"""WITH src AS (SELECT doc_id, {more + ', ' if more else ''}coalesce(text, '') AS t FROM documents), prep AS (SELECT *, {counts} AS f FROM src), g0 AS (SELECT *, f.* FROM prep), {guarded()}"""
        source, distinct, most, nw, ns, spread, hits, moral, n_lines, n_listed = "g", "distinct_", "most_", "words", "ns", E.deviation("ns", "k_sum", "k_squares"), "hits", "moral", "n_lines", "n_listed"
        em, ell, bang = (f"cast({x} AS DOUBLE) / greatest(ns, 1)" for x in ("em", "ell", "bang"))
    else:
        buzz = [w for tier in SHORT_BUZZWORDS.values() for w in tier]
        # Words that a hyphen joins are one term; a term inside another counts once, so distinct terms are enough.
        hits = " + ".join(f"CASE WHEN contains(lo, {q.lit(w)}) AND {q.has('lo', E.word(w))} THEN 1 ELSE 0 END" for w in buzz)
        morals = "|".join(["remember that", "in the end", "ultimately", "the lesson is", "what matters most", "at the end of the day", "it's important to remember"])
        em, ell, bang = (f"cast({q.count('t', p)} AS DOUBLE) / greatest({q.size('s')}, 1)" for p in (r"[\x{2014}\x{2013}]", r"\.\.\.", "!"))
        lined = E.lines(q, E.trim(q, "t"))
        source, distinct, most, nw, ns, spread = "m0", q.size(q.distinct("wd")), q.most("wd"), q.size("wd"), q.size("s"), E.spread(q, "k")
        moral, n_lines, n_listed = q.has(q.tail(E.trim(q, "lower(t)"), 200), E.word(morals)), q.size("ls"), q.size(q.filter("ls", "x", q.has("x", LIST_LINE)))
        made = f"""{base(q, more=more)}, {guards(q)},
m0 AS (SELECT *, lower(t) AS lo, {q.all('lower(t)', E.WORD)} AS wd, {lined} AS ls, {q.map('s', 'y', q.size(E.white_words(q, 'y')))} AS k FROM g)"""
    return f"""{made},
m AS (SELECT *,
CASE WHEN on_density THEN greatest(0.0, (0.5 - coalesce(cast({distinct} AS DOUBLE) / nullif({nw}, 0), 0)) / 0.5) ELSE 0.0 END AS density_slop,
CASE WHEN on_repetition THEN least(1.0, coalesce(cast({most} AS DOUBLE) / nullif({nw}, 0), 0) / 0.3) ELSE 0.0 END AS repetition_slop,
CASE WHEN on_burstiness THEN greatest(0.0, (5 - CASE WHEN {ns} < 2 THEN 0.0 ELSE {spread} END) / 5) ELSE 0.0 END AS burstiness_slop,
least(1.0, ({hits}) / 6.0) AS buzzword_slop,
CASE WHEN on_punctuation THEN least(1.0, ({em} + {ell} + {bang}) / 2) ELSE 0.0 END AS punctuation_slop,
CASE WHEN on_moral AND {moral} THEN 1.0 ELSE 0.0 END AS moral_slop,
CASE WHEN on_list AND {n_lines} > 3 AND {n_listed} > 0.4 * {n_lines} THEN 1.0 ELSE 0.0 END AS list_slop FROM {source}),
scored AS (SELECT *, round(least(1.0, ({W['density']} * density_slop + {W['repetition']} * repetition_slop + {W['burstiness']} * burstiness_slop + {W['buzzwords']} * buzzword_slop + {W['punctuation']} * punctuation_slop + {W['trailing_moral']} * moral_slop + {W['list_heavy']} * list_slop)
/ (CASE WHEN on_density THEN {W['density']} ELSE 0 END + CASE WHEN on_repetition THEN {W['repetition']} ELSE 0 END + CASE WHEN on_burstiness THEN {W['burstiness']} ELSE 0 END + {W['buzzwords']} + CASE WHEN on_punctuation THEN {W['punctuation']} ELSE 0 END + CASE WHEN on_moral THEN {W['trailing_moral']} ELSE 0 END + CASE WHEN on_list THEN {W['list_heavy']} ELSE 0 END)), 3) AS overall FROM m)"""


@operator()
def doc_structural_score(q):
    dims = ["density", "repetition", "burstiness", "buzzword", "punctuation", "moral", "list"]
    return f"{seven(q)} SELECT doc_id, overall, {', '.join(f'round({d}_slop, 3) AS {d}_slop' for d in dims)} FROM scored"


@operator()
def source_quality_topk(q):
    """The flagship: the five worst documents of each source by structural score, with their band."""
    band = "CASE WHEN overall >= 0.7 THEN 'slop' WHEN overall >= 0.4 THEN 'suspicious' WHEN overall >= 0.25 THEN 'ai_assisted' ELSE 'clean' END"
    return f"""{seven(q, more='source')}, ranked AS (SELECT source, doc_id, overall, {band} AS band,
row_number() OVER (PARTITION BY source ORDER BY overall DESC, doc_id) AS place FROM scored)
SELECT source, place, doc_id, overall, band FROM ranked WHERE place <= 5"""


@operator()
def source_quality_summary(q):
    return f"""{seven(q, more='source')} SELECT source, count(*) AS n, round(avg(overall), 6) AS mean_score,
sum(CASE WHEN overall >= 0.4 THEN 1 ELSE 0 END) AS flagged FROM scored GROUP BY source"""


@operator("conversations")
def turn_structural_stats(q):
    return f"""{base(q, 'conversations', key='conv_id', more='turn, role')} SELECT conv_id, turn, role, {q.size('w')} AS n_tokens, {q.size('s')} AS n_sentences,
coalesce({E.ratio(q, q.size(q.distinct('w')), q.size('w'))}, 0.0) AS density FROM prep"""


@operator()
def sample_hashes(q):
    return f"SELECT doc_id, substring({q.sha256(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}, 1, 16) AS sample_hash FROM documents"


@operator()
def cjk_tokens_seeded(q):
    text = "coalesce(text, '')" if not q.seeds else "concat(coalesce(text, ''), CASE WHEN doc_id % 3 = 0 THEN ' 重要な役割' WHEN doc_id % 3 = 1 THEN ' 中文mixed字' ELSE '' END)"
    return f"{base(q, text=text)} SELECT doc_id, {q.size('w')} AS n_tokens, {q.has('t', E.CJK)} AS has_cjk FROM prep"


@operator()
def quotes_stripped_seeded(q):
    """Quoted passages of 40 characters or more go; blanks close up."""
    seeded = f"concat(coalesce(text, ''), CASE WHEN {str(q.seeds).lower()} AND doc_id % 2 = 0 THEN {q.lit(' She said ' + chr(34) + 'this is a quoted passage that is surely longer than forty characters' + chr(34) + ' and ' + chr(0x201E) + 'dies ist ein sehr langes Zitat mit mehr als vierzig Zeichen' + chr(0x201C) + ' twice')} ELSE '' END)"
    x = "t"
    for opening, closing in (('"', '"'), ("“", "”"), ("„", "“"), ("»", "«")):
        x = q.sub(x, f"{opening}[^{closing}]{{40,}}{closing}", " ")
    x = q.sub(x, r"[ \t]{2,}", " ")
    return f"WITH s AS (SELECT doc_id, {seeded} AS t FROM documents), c AS (SELECT doc_id, length(t) AS raw_chars, {x} AS kept FROM s) SELECT doc_id, raw_chars, length(kept) AS kept_chars, round(1.0 - cast(length(kept) AS DOUBLE) / nullif(raw_chars, 0), 4) AS removed_share FROM c"


@operator()
def hidden_characters_seeded(q):
    """Zero-width characters go and look-alike Cyrillic letters become Latin ones."""
    seed = q.lit("pаy​pаl еxаmple﻿")
    clean = f"translate(t, {q.lit(chr(0x430) + chr(0x435) + chr(0x43E) + chr(0x440) + chr(0x441) + chr(0x445) + chr(0x200B) + chr(0x200C) + chr(0x200D) + chr(0xFEFF))}, 'aeopcx')"
    return f"""WITH s AS (SELECT doc_id, concat(coalesce(text, ''), CASE WHEN {str(q.seeds).lower()} AND doc_id % 4 = 0 THEN {seed} ELSE '' END) AS t FROM documents)
SELECT doc_id, length(t) - length({clean}) AS hidden, {q.sha256(clean)} AS clean_sha256 FROM s"""
