"""Text measures as SQL expressions, for either engine (see dialect)."""

from __future__ import annotations

from plumbline.functions.dialect import TRIM, Spark

WORD = r"[\p{L}\p{M}\p{N}_]+"
CJK = r"([\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}])"
ENDERS = r"[.!?。！？]+"
EDGE = r"[^\p{L}\p{M}\p{N}_]"


def word(pattern: str) -> str:
    """The pattern as whole words, with Unicode edges that both engines read alike."""
    return rf"(?:^|{EDGE})(?:{pattern})(?:$|{EDGE})"


def trim(q: Spark, x: str) -> str:
    return q.sub(x, TRIM, "")


def tokens(q: Spark, x: str) -> str:
    """Lower-case words; each CJK character is one."""
    return q.all(q.sub(f"lower({x})", CJK, " $1 "), WORD)


def sentences(q: Spark, x: str) -> str:
    return q.filter(q.map(q.split(x, ENDERS), "s", trim(q, "s")), "s", "s <> ''")


def sentences_kept(q: Spark, x: str) -> str:
    """Sentences with their ends: cut at white space after . ! or ?."""
    marked = q.sub(trim(q, x), r"([.!?])\s+", "$1\x01")
    return q.filter(q.split(marked, "\x01"), "s", "s <> ''")


def lines(q: Spark, x: str) -> str:
    return q.split(x, r"\n")


def paragraphs(q: Spark, x: str) -> str:
    return q.filter(q.map(q.split(x, r"\n[\s]*\n"), "p", trim(q, "p")), "p", "p <> ''")


def white_words(q: Spark, x: str) -> str:
    return q.all(x, r"[^\s]+")


def spread(q: Spark, a: str) -> str:
    """Population standard deviation of an integer array, from exact sums."""
    return deviation(q.size(a), q.sum(a), q.sum(q.map(a, "v", "v * v")))


def deviation(n: str, s: str, ss: str) -> str:
    return f"(CASE WHEN {n} < 1 THEN 0 ELSE sqrt(greatest(cast({n} * {ss} - {s} * {s} AS DOUBLE), 0)) / {n} END)"


def ratio(q: Spark, a: str, b: str, digits: int = 6) -> str:
    return f"round(cast({a} AS DOUBLE) / nullif({b}, 0), {digits})"
