"""The SQL operators against DuckDB on the smallest tables, and cases of their own."""

import math
import os

import duckdb
import pytest

from plumbline import plans
from plumbline.functions.dialect import SPARK
from plumbline.plans.catalog import OPERATORS, TABLES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
CHECKED = ["doc_density", "doc_repetition", "doc_burstiness", "doc_mirrored_overlap", "doc_portability", "doc_guard_status", "source_quality_topk", "lexicon_overlap_suppressed", "scorer_geomean_seeded", "signals_geometric", "rhetorical_findings_seeded", "paste_artifacts_seeded", "confusion_grouping_sets", "cross_validated_threshold", "mine_candidates_topk", "anchor_diff_turns", "trajectory_verdicts", "diff_added_lines_seeded"]


def plain(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return None if math.isnan(value) else round(float(value), 6)
    return value


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_same_as_duckdb(spark, name):
    found = plans.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cursor = db.execute(plans.oracles()[name])
    place = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert mine == sorted(repr([plain(r[i]) for i in place]) for r in cursor.fetchall())


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def run(spark, name, *texts):
    plans.load()
    return {r["doc_id"]: r for r in OPERATORS[name].frame(spark, documents=docs(spark, *texts)).collect()}


def test_density_of_repeated_words(spark):
    rows = run(spark, "doc_density", "a a a b", "", None, "重要な役割")
    assert [rows[k]["density"] for k in range(4)] == [0.5, 0.0, 0.0, 1.0]
    assert rows[3]["n_tokens"] == 5


def test_burstiness_needs_two_sentences(spark):
    rows = run(spark, "doc_burstiness", "One two three.", "One. One two three.", None)
    assert rows[0]["burstiness"] == 0.0 and rows[1]["burstiness"] == 1.0 and rows[2]["burstiness"] == 0.0


def test_short_texts_skip_metrics(spark):
    rows = run(spark, "doc_guard_status", "Too short.")
    assert rows[0]["skipped"] == "density,repetition,burstiness,punctuation,moral,list"


def test_longest_term_stands(spark):
    lexicon = {"f": {"a": (0.5, ["tapestry"]), "b": (0.9, ["rich tapestry"])}}
    from plumbline.operators.matching import lean, matches

    docs(spark, "A rich tapestry and a tapestry.").createOrReplaceTempView("documents")
    rows = spark.sql(f"{lean(SPARK)}, {matches(SPARK, lexicon)} SELECT term, pos FROM kept ORDER BY pos").collect()
    assert [(r.term, r.pos) for r in rows] == [("rich tapestry", 1), ("tapestry", 5)]


def test_ideology_is_suppressed_by_context(spark):
    rows = OPERATORS["ideology_findings_seeded"].frame(spark, documents=docs(spark, "Die Systempresse schweigt.", "x", "Systempresse: laut Aktenzeichen 12.")).collect()
    assert (0, "MartyrCartel") in {(r.doc_id, r.signal_id) for r in rows}
    assert (2, "MartyrCartel") not in {(r.doc_id, r.signal_id) for r in rows}


def test_no_cartesian_product_in_sweep(spark):
    if os.path.isdir(DATA):
        plan = plans.queries()["threshold_sweep"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan
