import json
import os

import pytest

from plumbline.sources import readers as R
from plumbline.streaming import jobs


def test_samples_take_response_and_drop_blanks(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"text":"a"}\n{"response":"b","model":"m"}\n{"text":"  "}\n')
    assert sorted((r.text, r.model, r.domain) for r in R.samples(spark, str(p)).collect()) == [("a", "unknown", "unknown"), ("b", "m", "unknown")]


def test_missing_store_is_empty_and_grows(spark, tmp_path):
    path = str(tmp_path / "store")
    assert R.review_store(spark, path).count() == 0
    R.add_review(spark, path, "S", "text", "n", "2026-01-01", "me")
    assert [r.sample_hash for r in R.review_store(spark, path).collect()] == ["982d9e3eb996f559"]


def test_loop_steps_name_their_run(spark, tmp_path):
    for run in ("a", "b"):
        os.makedirs(tmp_path / run)
        (tmp_path / run / "iterations.jsonl").write_text('{"iter":1,"score":0.5}\n{"iter":2,"action":"exit_ok"}\n')
    assert sorted((r.run_id, r.iter, r.action) for r in R.loop_steps(spark, f"{tmp_path}/*/iterations.jsonl").collect()) == [("a", 1, "accepted"), ("b", 1, "accepted")]


def test_settings_fail_loud(tmp_path):
    good = {"threshold": 0.4, "short_text_guards": dict.fromkeys(R.Settings.NAMES, 3)}
    p = tmp_path / "t.json"
    p.write_text(json.dumps(good))
    assert R.Settings.read(str(p)).threshold == 0.4
    for bad in ({}, good | {"threshold": 1.5}, good | {"short_text_guards": {}}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            R.Settings.read(str(p))


def test_project_config(tmp_path):
    p = tmp_path / "slop.json"
    p.write_text(json.dumps({"disabled_signals": ["A"], "weight_overrides": {"density": 0.1}, "aggregation": {"mode": "geomean", "epsilon": 0.1}}))
    found = R.ProjectConfig.read(str(p), {"density"})
    assert found.disabled_signals == ("A",) and found.aggregation == "geomean" and found.epsilon == 0.1
    for bad in ({"other": 1}, {"weight_overrides": {"nope": 1}}, {"aggregation": "mean"}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            R.ProjectConfig.read(str(p), {"density"})


def test_trajectory_state_over_batches(spark, tmp_path):
    schema = "run_id long, iter long, score double, edits double, action string"
    steps = [(1, 1, 0.9, 0.1, "accepted"), (1, 2, 0.3, 0.05, "accepted"), (2, 1, 0.5, 0.1, "rollback"), (2, 2, 0.5, 0.1, "rollback"), (3, 1, 0.5, 0.1, "accepted"), (3, 2, 0.5, 0.1, "accepted"), (3, 3, 0.5, 0.1, "accepted"), (3, 4, 0.5, 0.1, "accepted")]
    spark.createDataFrame(steps, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.drain(jobs.guarded(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "guard")
    got = {(r.run_id, r.iter): r.verdict for r in out.collect()}
    assert got[1, 2] == "escalate" and got[2, 2] == "escalate" and got[3, 4] == "stop_report" and got[3, 3] == "ok"


def test_stream_equals_batch(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(1, "One two. Three four five!", "en", "s", 1), (2, None, "en", "s", 0)], schema)
    df.write.parquet(str(tmp_path / "d"))
    stream = jobs.drain(jobs.scored(spark.readStream.schema(schema).parquet(str(tmp_path / "d"))), "t")
    from plumbline import plans
    from plumbline.plans.catalog import OPERATORS

    plans.load()
    batch = OPERATORS["doc_structural_score"].frame(spark, documents=df)
    assert sorted(map(tuple, stream.collect())) == sorted((r.doc_id, r.overall) for r in batch.collect())
