"""Operators that SQL can't express: exact spans, syntax trees, normal forms. Arrow batches throughout."""

from __future__ import annotations

import ast
import difflib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.lexicon import WEIGHTS_7

# --- exact term matching ----------------------------------------------------------------------------------
COUNT_WORDS = r"\d{1,4}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|fifty|hundred"
NOUN_PHRASE = r"\w[\w'-]*(?:\s+\w[\w'-]*){0,3}?"
#: A clause opens at the start, after an end or break, an opening quote or bracket, or a list marker.
CLAUSE_OPEN = "(?:^|(?<=[.!?:;…\\n\"“„«(\\[]))[ \\t]*(?:[#>*_—–-]+[ \\t]*)*(?:(?:[-*+]|\\d+[.)])[ \\t]+)?"


def term_pattern(term: str) -> str:
    """[X] stands for one to four words, [N] for a count, a leading ^ for the opening of a clause. Word
    boundaries hold at ASCII letters and digits only, so terms of other scripts match in running text."""
    body = term.lower()
    opening = body.startswith("^")
    body = body[1:] if opening else body
    pieces = re.split(r"(\[x\]|\[n\])", body)
    made = "".join(f"(?:{NOUN_PHRASE})" if p == "[x]" else f"(?:{COUNT_WORDS})" if p == "[n]" else re.escape(p) for p in pieces)
    edge = lambda c: c.isascii() and c.isalnum()
    left = r"\b" if body[:3] in ("[x]", "[n]") or edge(body[0]) else ""
    right = r"\b" if body[-3:] in ("[x]", "[n]") or edge(body[-1]) else ""
    return (CLAUSE_OPEN if opening else "") + left + made + right


def needles(term: str) -> list[str]:
    """The fixed parts of a term: a text that lacks one of them doesn't hold it."""
    return [p for p in re.split(r"\[x\]|\[n\]", term.lower().removeprefix("^")) if p]


def term_spans(text: str, terms: list[tuple[str, re.Pattern]]) -> list[tuple[str, int, int]]:
    """Spans of all terms, the longest first, then the first, that overlap no span taken before."""
    found = sorted(((m.start(), m.end(), t) for t, p in terms for m in p.finditer(text)), key=lambda s: (s[0] - s[1], s[0]))
    taken: list[tuple[int, int, str]] = []
    for start, end, term in found:
        at = bisect_left(taken, (end,))
        if at == 0 or taken[at - 1][1] <= start:
            taken.insert(at, (start, end, term))
    return [(term, start, end) for start, end, term in taken]


def match_terms(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, start, end, line) of each match in the lower-cased text; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [((t.lower(), re.compile(term_pattern(t))), needles(t)) for t in terms]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                low = (text.as_py() or "").lower()
                able = [term for term, parts in compiled if all(p in low for p in parts)]
                line, seen = 1, 0
                for t, a, b in term_spans(low, able):
                    line, seen = line + low.count("\n", seen, a), a
                    rows.append((key, t, a, b, line))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "term", "start", "end", "line"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, term string, start int, end int, line int")


# --- text preparation ---------------------------------------------------------------------------------------
HIDDEN = {ord(c): None for c in "​‌‍﻿"}
LOOKALIKE = str.maketrans("аеорсх", "aeopcx")


def normalize(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(HIDDEN).translate(LOOKALIKE)


def strip_markup(text: str) -> str:
    """Text without fenced and indented code, quoted lines, tables and inline code; done twice it's the same."""
    kept, fence = [], ""
    for line in text.split("\n"):
        bare = line.lstrip()
        if fence:
            fence = "" if bare.startswith(fence) else fence
            continue
        if bare.startswith(("```", "~~~")):
            fence = bare[:3]
            continue
        if bare.startswith((">", "|")) or line.startswith(("    ", "\t")):
            continue
        kept.append(re.sub(r"`[^`\n]*`", "", line))
    return "\n".join(kept)


def _mapped(docs: DataFrame, fn, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else fn(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")


def normalized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _mapped(docs, normalize, id_col, text_col)


def markup_stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _mapped(docs, strip_markup, id_col, text_col)


# --- forced triads ------------------------------------------------------------------------------------------
# Fixed values.
SUFFIXES = ("able", "ible", "ful", "less", "ous", "ive", "ing", "ed", "al", "ic", "ly", "y", "en", "ung", "keit", "ion", "ern")
LISTED = re.compile(r"\b([a-zà-ÿ]+),\s+([a-zà-ÿ]+)(,?)\s+(?:and|und)\s+([a-zà-ÿ]+)\b")
STACCATO = re.compile(r"(?<![\w.])([A-Za-zÀ-ÿ]{3,16})\.\s+([A-Za-zÀ-ÿ]{3,16})\.\s+([A-Za-zÀ-ÿ]{3,16})\.")


def forced_triad(text: str) -> str | None:
    """The first slogan of three like-ended words; with a serial comma two like ends are enough."""
    low = text.lower()
    for m in LISTED.finditer(low):
        words = (m[1], m[2], m[4])
        alike = max(sum(w.endswith(s) for w in words) for s in SUFFIXES)
        if len(set(words)) == 3 and not re.search(r"\d", low[max(0, m.start() - 30) : m.start()]) and alike >= (2 if m[3] else 3):
            return ", ".join(words)
    for m in STACCATO.finditer(text):
        if len({w.lower() for w in m.groups()}) == 3:
            return " ".join(w + "." for w in m.groups())
    return None


def forced_triads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _mapped(docs, forced_triad, id_col, text_col).where("text is not null").withColumnRenamed("text", "evidence")


# --- code ---------------------------------------------------------------------------------------------------
LEVELS = ("stub", "synthetic_risk", "claimed_only", "reachable", "tested", "asserted")


def _calls(node: ast.AST) -> set[str]:
    return {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}


def ladder(source: str, entries: tuple[str, ...] = ("main",)) -> list[tuple[str, str]]:
    """The rung of each function of a module: how far something else vouches for it."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return []
    functions = {n.name: n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    graph = {name: _calls(node) & set(functions) for name, node in functions.items()}
    tests = [n for n in functions if n.startswith("test")]
    asserted = set().union(*(_calls(a) for t in tests for a in ast.walk(functions[t]) if isinstance(a, ast.Assert)), set())
    tested = set().union(*(graph[t] for t in tests), set())
    open_, reached = [e for e in entries if e in functions], set()
    for top in tree.body:
        if not isinstance(top, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            open_ += list(_calls(top) & set(functions))
    while open_:
        name = open_.pop()
        if name not in reached:
            reached.add(name)
            open_ += list(graph[name])
    out = []
    for name, node in functions.items():
        body = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        stub = all(isinstance(s, ast.Pass) or isinstance(s, ast.Raise) and "NotImplemented" in ast.dump(s) for s in body)
        used = {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}
        unread = [a.arg for a in node.args.args if a.arg not in used | {"self"}]
        risk = bool({"random", "randint", "uniform"} & _calls(node)) or (unread and len(body) == 1 and isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Constant))
        level = "stub" if stub else "synthetic_risk" if risk else "asserted" if name in asserted else "tested" if name in tested else "reachable" if name in reached else "claimed_only"
        out.append((name, level))
    return sorted(out)


def reinvented(source: str) -> list[tuple[str, str, float]]:
    """Pairs of functions of a module whose names and parameters are alike."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return []
    signatures = sorted((n.name, f"{n.name}({', '.join(a.arg for a in n.args.args)})") for n in ast.walk(tree) if isinstance(n, ast.FunctionDef))
    pairs = ((a, b, difflib.SequenceMatcher(None, x, y).ratio()) for i, (a, x) in enumerate(signatures) for b, y in signatures[i + 1 :])
    return [(a, b, round(r, 6)) for a, b, r in pairs if r > 0.8]


def verification_ladder(files: DataFrame) -> DataFrame:
    """files (doc_id, source) to (doc_id, name, level)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, v) for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, v in ladder(s or "")]
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], ["doc_id", "name", "level"])

    return files.select("doc_id", "source").mapInArrow(run, "doc_id long, name string, level string")


def reinvented_functions(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, a, b, r) for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b, r in reinvented(s or "")]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64()))], ["doc_id", "first", "second", "ratio"])

    return files.select("doc_id", "source").mapInArrow(run, "doc_id long, first string, second string, ratio double")


# --- calibration --------------------------------------------------------------------------------------------
def calibrate(features: DataFrame, threshold: float = 0.2, floor: float = 0.5, rounds: int = 2) -> dict[str, float]:
    """Coordinate ascent over the weights of a feature table (columns of WEIGHTS_7 and `bad`): a coordinate's
    candidates are columns of one aggregate. Below the precision floor a candidate loses what it lacks."""
    weights = dict(WEIGHTS_7)
    grid = [round(0.05 * k, 2) for k in range(12)]

    def values(name: str, candidates: list[float]) -> list[float]:
        columns = []
        for k, c in enumerate(candidates):
            score = sum(((c if d == name else w) * F.col(d) for d, w in weights.items()), F.lit(0.0))
            hit = F.least(F.lit(1.0), score) >= threshold
            columns += [F.sum((hit & F.col("bad")).cast("long")).alias(f"tp{k}"), F.sum((hit & ~F.col("bad")).cast("long")).alias(f"fp{k}"), F.sum((~hit & F.col("bad")).cast("long")).alias(f"fn{k}")]
        row = features.agg(*columns).first()
        out = []
        for k in range(len(candidates)):
            tp, fp, fn = (row[f"{x}{k}"] or 0 for x in ("tp", "fp", "fn"))
            f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            out.append(f1 - max(0.0, floor - (tp / (tp + fp) if tp + fp else 1.0)))
        return out

    best = values(min(weights), [weights[min(weights)]])[0]
    for _ in range(rounds):
        before = best
        for name in sorted(weights):
            scored = values(name, grid)
            top = max(scored)
            if top > best + 1e-9:
                best, weights[name] = top, grid[scored.index(top)]
        if best <= before:
            break
    return weights
