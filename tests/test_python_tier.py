import re

from plumbline.operators import python_tier as P


def spans(text, *terms):
    low = text.lower()
    return [(t, low[a:b]) for t, a, b in P.term_spans(low, [(t.lower(), re.compile(P.term_pattern(t))) for t in terms])]


def test_placeholders_and_clause_openings():
    assert spans("Here are 5 ways to win", "here are [N] ways") == [("here are [n] ways", "here are 5 ways")]
    assert spans("Most people agree.", "^most people") and not spans("For most people it works.", "^most people")
    assert spans("the power of deep work", "the power of [X]")[0][1] == "the power of deep"


def test_longest_span_first():
    assert spans("navigating the rich tapestry", "tapestry", "rich tapestry", "the rich") == [("rich tapestry", "rich tapestry")]


def test_terms_match_in_running_text():
    assert spans("値得注意的是、", "注意的是") == [("注意的是", "注意的是")]
    assert not spans("delved", "delve")


def test_normalize_twice_is_once():
    for text in ("ｆｕｌｌ", "pаy​pal", "", "plain"):
        assert P.normalize(P.normalize(text)) == P.normalize(text)
    assert P.normalize("pаy​pаl") == "paypal"


def test_markup_goes():
    text = "keep `code` this\n```py\nx = 1\n```\n> quote\n| a |\n    indented\nend"
    assert P.strip_markup(text) == "keep  this\nend"
    assert P.strip_markup(P.strip_markup(text)) == P.strip_markup(text)


def test_triads():
    assert P.forced_triad("It is reliable, scalable, and usable.") == "reliable, scalable, usable"
    assert P.forced_triad("In 2024: reliable, scalable, and usable.") is None
    assert P.forced_triad("People. Process. Tools.") == "People. Process. Tools."
    assert P.forced_triad("We ate bread, cheese, and soup.") is None


def test_ladder_levels():
    source = "def used():\n    return 1 + x\n\ndef main():\n    return used()\n\ndef empty():\n    pass\n\ndef lonely(a):\n    return a\n\ndef checked(a):\n    return a\n\ndef test_it():\n    assert checked(1)\n"
    assert dict(P.ladder(source)) | {"test_it": ""} == {"used": "reachable", "main": "reachable", "empty": "stub", "lonely": "claimed_only", "checked": "asserted", "test_it": ""}
    assert P.ladder("def broken(:") == []


def test_alike_functions():
    assert [(a, b) for a, b, _ in P.reinvented("def parse_row(x):\n    pass\ndef parse_rows(x):\n    pass\ndef z():\n    pass\n")] == [("parse_row", "parse_rows")]


def test_match_terms_handles_nulls(spark):
    df = spark.createDataFrame([(1, "We delve.\nDelve deeper."), (2, None), (3, "")], "doc_id long, text string")
    rows = [(r.doc_id, r.term, r.line) for r in P.match_terms(df, ["delve", "delve deeper"]).orderBy("start").collect()]
    assert rows == [(1, "delve", 1), (1, "delve deeper", 2)]


def test_calibration_finds_the_useful_weight(spark):
    from plumbline.functions.lexicon import WEIGHTS_7

    rows = [tuple((1.0 if d == "density" and bad else 0.0) for d in WEIGHTS_7) + (bad,) for bad in (True, False) * 10]
    features = spark.createDataFrame(rows, ", ".join(f"{d} double" for d in WEIGHTS_7) + ", bad boolean")
    assert P.calibrate(features, threshold=0.4, rounds=1)["density"] >= 0.4
