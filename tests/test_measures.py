"""Counts made in Python against the SQL of the check, on odd texts; and that each text is counted once, by no pattern of SQL."""

import duckdb
import pytest

from plumbline import plans
from tests.test_sql_operators import plain

NBSP, ACUTE, ASTRAL, MARK = chr(0xA0), chr(0x301), chr(0x10400), chr(0x3002)
TEXTS = [
    None, "", "   \n\t ", "One.", "One two. Three four! Five six? Seven eight. Nine ten.",
    "The robust tool harness. The robust tool harness. The robust tool harness.\r\nThe robust tool harness... It is the end. In the end, a tool.",
    "- one\n- two\n* three\n1. four\n12) five\n" + chr(0x2022) + " six\n\nseven",
    "A" + chr(0x2014) + "b " + chr(0x2013) + " c! d! e!!! f... g.... The key takeaway is: ultimately",
    "Studies have shown that experts say. Research shows recent studies. A growing body of evidence, experts say; experts-say. " * 4,
    f"caf{ACUTE}e na{NBSP}ive {ASTRAL}{ASTRAL} x{ASTRAL} " + "重要な役割" + f"{MARK}中文mixed字{MARK} lo" + "ng_word 3,5 " * 12,
    "Delve into a rich tapestry, a tapestry of the realm. Cutting-edge game-changing game changing! State-of-the-art. We delved into landscapes, landscape. " * 3,
    "It's worth noting that it's important to note: in conclusion, moreover. Furthermore additionally in addition. Let that sink in. Full stop. Mic drop.",
    "Plain words stand here. plain words Stand here. plain words stand Here 3. plain \"words\" stand here. plain words stand here.",
    "see turn0search12 and turn1search3, as of 2024-XX-XX, :contentReference[oaicite:0] " + chr(0xE000) + " turn1search3x",
    "Il est important de noter que, en somme, rappelons que. Zusammenfassend lässt sich sagen: es gilt zu beachten nunmehr. ÀB Éa ß",
    "The agent and the assistant met the tool. It's not slow. It's fast. Not a tool. Not a bot.\n\nIn conclusion, it is well-made, so-called here. And that's the point.",
    "# Head\n\n## Small\n**Bold** and x **bold** y\nFast | Strong | Clear\nGo. Run. Eat. Go on. Go home. " + chr(0x201C) + "q" + chr(0x201D),
    "So, here is the thing. A pivotal moment. Interesting point. " + "word " * 200 + chr(0x2014) + " " + chr(0x2014) + " " + chr(0x2014) + ".",
]
#: How often a plan counts each text: once, or once for each branch of a join with itself.
COUNTED: dict[str, int] = {"signals_noisy_or_seeded": 1, "policy_actions": 1, "pipeline_verdict_seeded": 1, "fix_strategies_seeded": 1, "pipeline_verdict": 1, "exempted_by_hash_seeded": 2, "signals_geometric_seeded": 1, "evaluation_errors": 1, "score_with_floors_seeded": 1, "signals_noisy_or": 1, "scorer_dimensions_seeded": 1, "rhetorical_findings_seeded": 1, "disabled_signal_antijoin_seeded": 1, "scorer_weighted_seeded": 1, "weight_gain_report": 1, "phrases_by_category_seeded": 3, "disabled_signal_antijoin": 1}
CHECKED: list[str] = ["signals_noisy_or_seeded", "policy_actions", "pipeline_verdict_seeded", "fix_strategies_seeded", "pipeline_verdict", "exempted_by_hash_seeded", "signals_geometric_seeded", "evaluation_errors", "score_with_floors_seeded", "signals_noisy_or", "scorer_dimensions_seeded", "rhetorical_findings_seeded", "disabled_signal_antijoin_seeded", "scorer_weighted_seeded", "weight_gain_report", "phrases_by_category_seeded", "disabled_signal_antijoin"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    rows = [(i, t, "en", f"src{i % 9}", 0) for i, t in enumerate(TEXTS * 8)]
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    db.execute("CREATE TABLE labels AS SELECT doc_id, cast(doc_id % 2 AS INT) AS quality, 0 AS toxic FROM documents WHERE doc_id % 3 <> 0")
    for t in ("documents", "labels"):
        db.execute(f"COPY {t} TO '{root}/{t}.parquet' (FORMAT parquet)")
    return str(root)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, folder, name):
    found = plans.queries()[name](spark, folder)
    columns = sorted(found.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cursor = db.execute(plans.oracles()[name])
    place = [[d[0] for d in cursor.description].index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in place]) for r in cursor.fetchall())
    assert mine == theirs and mine


@pytest.mark.parametrize("name", COUNTED)
def test_texts_are_counted_by_no_pattern_of_sql(spark, folder, name):
    plan = plans.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == COUNTED[name]
    assert name.startswith("rhetorical") or "regexp" not in plan and "RLIKE" not in plan
