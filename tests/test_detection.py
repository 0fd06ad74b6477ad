"""Findings on texts as they are, the masks, and that plain operators add nothing to a text."""

import os

import duckdb
import pytest

from plumbline import cli, plans
from plumbline.operators import detection as D
from plumbline.plans.catalog import OPERATORS, TABLES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


def found(spark, name, *texts):
    plans.load()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return OPERATORS[name].frame(spark, documents=docs).collect()


def ids(spark, name, *texts):
    out = [set() for _ in texts]
    for r in found(spark, name, *texts):
        out[r.doc_id].add(r.signal_id)
    return out


def test_micro_patterns(spark):
    hit = ids(spark, "micro_findings", *D.MICRO_SEEDS, None)
    assert hit[1] == {"FalseAgency"} and hit[2] == {"FalseRange"} and hit[3] >= {"ActorlessClaim"} and hit[4] == {"NameDropList"}
    assert hit[5] == {"PurityBan", "VibeScapegoat"} and hit[6] == {"SalvationModel"} and hit[7] == {"HeadingRepeatedBelowItself"}
    assert hit[0] == hit[8] == hit[9] == set()


def test_micro_patterns_leave_plain_texts(spark):
    texts = ["The system realizes a gain of two percent.", "From latency to throughput it all improved.", "The plan must be decided by Monday.", "It was decided by Anna to wait.", "We noted the result.", "The outage came from a database migration by vibe coders.", "# Budget plan\nOther things come first."]
    assert ids(spark, "micro_findings", *texts) == [set()] * len(texts)


def test_recap_needs_an_opener_and_the_words_of_the_start(spark):
    assert ids(spark, "micro_findings", "Caches help readers. They cost memory. Overall, caches help readers.", "Caches help readers. Overall, rain falls.") == [{"RecapEnding"}, set()]


def test_more_rhetoric(spark):
    hit = ids(spark, "rhetorical_more", *D.MORE_SEEDS, None)
    assert hit[1:5] == [{"ColonReveal"}, {"engagement_comment_default"}, {"ChatbotLeftover"}, {"InlineHeaderRestatement"}]
    assert hit[6] == hit[7] == set()
    assert ids(spark, "rhetorical_more", "Warning: this is hot.", "**Speed:** It is quick.") == [set(), set()]


def test_code(spark):
    rows = {r.doc_id: r for r in found(spark, "code_findings", *D.PROGRAM_SEEDS, None)}
    assert rows[1].chained_type_assertions == 1 and rows[1].as_any_casts == 1 and rows[2].widen_then_assert == 1
    assert rows[3].excessive_defensive_try and rows[4].module_mocking and not rows[5].module_mocking and rows[5].as_any_casts == 0
    assert set(rows) == {1, 2, 3, 4, 5}


def test_pull_requests_and_commits(spark):
    rows = {r.doc_id: r.rules for r in found(spark, "pull_request_findings", *(f"Title {s}" for s in D.PR_SEEDS))}
    assert rows == {1: "title_emoji_count|title_blocked_term|dangling_code_reference"}
    assert ids(spark, "commit_keyword_findings", "- Adding more\n- Fixing it", "A comprehensive fix", "comprehensive " + "x" * 250, "Fix typo") == [{"CommitKeywordSlop"}, set(), {"CommitKeywordSlop"}, set()]


def test_german_structure(spark):
    assert ids(spark, "german_structure", *D.GERMAN_SEEDS) == [set(), {"HollowFazitHeading"}, {"LetterStructure"}, {"BulletCapitalization"}, set()]


def test_masks(spark):
    rows = {r.doc_id: r.masked_chars for r in found(spark, "guard_masks", "Nobody tells you this.", "Nobody tells you this. I lost a year.", "Time is running out.", "Time is running out: 3 days left.", "I hope this helps.", "Hope this helps. Cheers, A", "A vector of change.", "The model takes a vector.")}
    assert [rows[k] > 0 for k in range(8)] == [False, True] * 4


def test_plain_operators_add_nothing(spark):
    """The same text is clean whatever its id, in all that the command line runs."""
    text = "A plain note on the weather. It rained in March."
    scores = {(r.score, r.severity) for r in found(spark, "signals_noisy_or", *[text] * 7)}
    assert scores == {(0.0, "clean")}
    for name in cli.COMMANDS.values():
        rows = {tuple(v for k, v in r.asDict().items() if k != "doc_id") for r in found(spark, name, *[text] * 7)}
        assert len(rows) <= 1, name
    assert not any(n.endswith("_seeded") for n in cli.COMMANDS.values())


def test_classifier_reads_each_text_once(spark):
    plans.load()
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = OPERATORS["signals_noisy_or"].frame(spark, documents=docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan and plan.count("Exchange") <= 1


@needs_data
@pytest.mark.parametrize("name", ["micro_findings_seeded", "rhetorical_more_seeded", "code_findings_seeded", "pull_request_findings_seeded", "german_structure_seeded", "guard_masks_seeded", "signals_noisy_or_seeded", "metadata_findings_seeded"])
def test_same_as_duckdb(spark, name):
    rows = plans.queries()[name](spark, DATA)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cursor = db.execute(plans.oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(repr([r[c] for c in names]) for r in rows.collect()) == sorted(repr(list(r)) for r in cursor.fetchall())
