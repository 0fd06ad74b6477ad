"""Term spans: only patterns whose fixed parts a text has are tried, and many matches don't meet each other one by one."""

import re
import time

from plumbline.operators import python_tier as P
from plumbline.plans.python_queries import TERMS, seeded_documents, term_spans_exact_seeded

TEXTS = ["We delve into a rich tapestry of robust ideas.\nIn today we delve deeper; here are 5 ways to leverage the power of x.", "in 3 words we win", "harness harness unleash", "", "İn a robust world: leverage", "at the end of the day,\n\nin the grand scheme of things a paradigm shift"]


def test_fixed_parts():
    assert P.needles("here are [N] ways") == ["here are ", " ways"] and P.needles("^in [X] we") == ["in ", " we"] and P.needles("[X]") == []


def test_spans_are_those_of_all_patterns(spark):
    compiled = [(t.lower(), re.compile(P.term_pattern(t))) for t in TERMS]
    wanted = {(k, t, a, b, s.lower().count("\n", 0, a) + 1) for k, s in enumerate(TEXTS) for t, a, b in P.term_spans(s.lower(), compiled)}
    found = P.match_terms(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), TERMS).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted) > 8


def test_many_matches_take_no_square():
    text, terms = "robust idea " * 30_000, [("robust", re.compile(r"\brobust\b")), ("robust idea", re.compile(r"\brobust idea\b"))]
    began = time.process_time()
    assert len(P.term_spans(text, terms)) == 30_000
    assert time.process_time() - began < 10


def test_seeded_spans(spark, tmp_path):
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    compiled = [(t.lower(), re.compile(P.term_pattern(t))) for t in TERMS]
    texts = {r.doc_id: r.text.lower() for r in seeded_documents(spark, str(tmp_path)).collect()}
    wanted = {(k, t, a, b, s.count("\n", 0, a) + 1) for k, s in texts.items() for t, a, b in P.term_spans(s, compiled)}
    assert {tuple(r) for r in term_spans_exact_seeded(spark, str(tmp_path)).collect()} == wanted
    assert P.needles("[X] of [N]") == [" of "]
