"""Sequences: bursts, velocity, trajectories and diffs, with windows over ordered rows."""

from __future__ import annotations

from plumbline.functions import expressions as E
from plumbline.operators.matching import seeded
from plumbline.plans.catalog import operator


#: Fixed value: seconds between commits of a burst.
BURST_GAP = 60


def commits(q) -> str:
    """CTE c: events as commits, additions and deletions from their value."""
    return "WITH c AS (SELECT user_id, event_id, ts, cast(floor(abs(value)) AS BIGINT) % 500 + 1 AS additions, cast(floor(abs(value) * 7) AS BIGINT) % 40 AS deletions FROM events WHERE ts IS NOT NULL)"


@operator("events")
def burst_clusters(q):
    """Longest run of gaps under BURST_GAP seconds between the events of a user."""
    return f"""{commits(q)}, g AS (SELECT user_id, event_id, ts, {q.seconds('ts', 'lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS gap FROM c),
i AS (SELECT *, sum(CASE WHEN gap < {BURST_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT user_id, event_id, ts, coalesce(gap, 1e12) AS gap FROM g) z),
r AS (SELECT user_id, island, count(*) - 1 AS run FROM i GROUP BY user_id, island) SELECT user_id, max(run) AS longest_run, max(run) >= 3 AS burst FROM r GROUP BY user_id"""


@operator("events")
def burst_sessions(q):
    """Sessions of events at most 30 minutes apart."""
    return f"""{commits(q)}, g AS (SELECT user_id, event_id, ts, additions, {q.seconds('ts', 'lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS gap FROM c),
i AS (SELECT *, sum(CASE WHEN gap <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, event_id, ts, additions, coalesce(gap, 1e12) AS gap FROM g) z)
SELECT user_id, session, count(*) AS n, sum(additions) AS additions, round({q.seconds('max(ts)', 'min(ts)')}, 3) AS span_s FROM i GROUP BY user_id, session"""


@operator("events")
def velocity_rules(q):
    """Four rules over a user's commits; two of them make the finding."""
    gap = q.seconds("ts", "lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    return f"""{commits(q)}, g AS (SELECT *, {gap} AS gap FROM c),
i AS (SELECT *, sum(CASE WHEN gap < {BURST_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT user_id, event_id, ts, additions, deletions, coalesce(gap, 1e12) AS gap FROM g) z),
r AS (SELECT user_id, max(run) AS run FROM (SELECT user_id, island, count(*) - 1 AS run FROM i GROUP BY user_id, island) y GROUP BY user_id),
t AS (SELECT user_id, count(*) AS n, sum(additions) AS adds, sum(deletions) AS dels, greatest({q.seconds('max(ts)', 'min(ts)')}, 1.0) / 60 AS minutes,
sum(CASE WHEN additions + deletions >= 10 THEN 1 ELSE 0 END) AS big, max(CASE WHEN additions + deletions >= 10 THEN cast(additions AS DOUBLE) / (additions + deletions) END) AS hi, min(CASE WHEN additions + deletions >= 10 THEN cast(additions AS DOUBLE) / (additions + deletions) END) AS lo FROM c GROUP BY user_id),
f AS (SELECT t.user_id, n, n >= 2 AND adds / minutes > 100 AS fast, n >= 2 AND run >= 3 AS burst, n >= 2 AND adds + dels > 200 AND adds > 0.9 * (adds + dels) AS add_heavy, big >= 4 AND hi - lo < 0.02 AS steady FROM t JOIN r ON t.user_id = r.user_id),
k AS (SELECT *, (CASE WHEN fast THEN 1 ELSE 0 END) + (CASE WHEN burst THEN 1 ELSE 0 END) + (CASE WHEN add_heavy THEN 1 ELSE 0 END) + (CASE WHEN steady THEN 1 ELSE 0 END) AS fired FROM f)
SELECT user_id, n, fast, burst, add_heavy, steady, fired, CASE WHEN fired >= 2 THEN least(0.95, round(0.5 + 0.15 * fired, 2)) END AS confidence FROM k"""


def steps() -> str:
    """CTE s: a user's events as steps of a rewriting loop."""
    return """WITH s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iter, round((cast(floor(abs(value) * 100) AS BIGINT) % 1000) / 1000.0, 3) AS score,
round((cast(floor(abs(value) * 37) AS BIGINT) % 100) / 100.0, 2) AS edits, CASE WHEN event_type IN ('error', 'refund', 'logout') OR event_id % 6 = 0 THEN 'rollback' ELSE 'accepted' END AS action FROM events WHERE value IS NOT NULL)"""


@operator("events")
def trajectory_steps(q):
    return f"{steps()} SELECT run_id, iter, score, edits, action FROM s"


@operator("events")
def trajectory_verdicts(q):
    """ANOMALY: the score falls by over 0.4 with edits under half of it. DIMINISHING: three small changes in
    a row. ROLLBACK_CHAIN: two rollbacks in a row."""
    return f"""{steps()}, a AS (SELECT *, lag(score) OVER (PARTITION BY run_id ORDER BY iter) AS before_ FROM s WHERE action = 'accepted'),
d AS (SELECT *, round(before_ - score, 6) AS delta FROM a WHERE before_ IS NOT NULL),
an AS (SELECT run_id, max(CASE WHEN delta > 0.4 AND edits < 0.5 * delta THEN 1 ELSE 0 END) AS anomaly FROM d GROUP BY run_id),
di AS (SELECT *, sum(CASE WHEN abs(delta) < 0.02 THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY iter ROWS UNBOUNDED PRECEDING) AS island FROM d),
dm AS (SELECT run_id, max(k) AS small_run FROM (SELECT run_id, island, sum(CASE WHEN abs(delta) < 0.02 THEN 1 ELSE 0 END) AS k FROM di GROUP BY run_id, island) z GROUP BY run_id),
rb AS (SELECT *, sum(CASE WHEN action = 'rollback' THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY iter ROWS UNBOUNDED PRECEDING) AS island FROM s),
rm AS (SELECT run_id, max(k) AS rollbacks FROM (SELECT run_id, island, sum(CASE WHEN action = 'rollback' THEN 1 ELSE 0 END) AS k FROM rb GROUP BY run_id, island) z GROUP BY run_id)
SELECT rm.run_id, coalesce(anomaly, 0) AS anomaly, coalesce(small_run, 0) >= 3 AS diminishing, rollbacks >= 2 AS rollback_chain,
CASE WHEN coalesce(anomaly, 0) = 1 OR rollbacks >= 2 THEN 'escalate' WHEN coalesce(small_run, 0) >= 3 THEN 'stop_report' ELSE 'ok' END AS verdict FROM rm LEFT JOIN an ON rm.run_id = an.run_id LEFT JOIN dm ON rm.run_id = dm.run_id"""


@operator("events")
def event_type_hours(q):
    """Events by type and hour of the day, with totals of each type (rollup)."""
    hour = "hour(ts)" if q.name == "spark" else "hour(ts)"
    return f"SELECT event_type, {hour} AS hour_, count(*) AS n FROM events GROUP BY ROLLUP (event_type, {hour})"


DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a = 1\n-b = 2\n+b = 3\n+c = 4\n d = 5\n@@ -10,2 +11,3 @@\n e = 1\n+f = 2\n g = 3\ndiff --git a/test_x.py b/test_x.py\n--- a/test_x.py\n+++ b/test_x.py\n@@ -1,3 +1,2 @@\n def test():\n-    assert a == 1\n+    pass\n"


def diff_lines(q) -> str:
    """CTE n: the lines of the unified diffs that a text holds, with file, hunk start and new line number:
    headers carried forward by windows."""
    x = q.explode("doc_id", "d", "ls", "pos", "line")
    last = "last_value({} IGNORE NULLS)" if q.name == "duckdb" else "last_value({}, true)"
    win = "OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    file = q.sub("line", "^[+]{3} b/", "")
    start = q.sub("line", "^@@ -[0-9,]+ [+]([0-9]+).*$", "$1")
    return f"""WITH d AS (SELECT doc_id, {E.lines(q, seeded(q, ["", chr(10) + DIFF]))} AS ls FROM documents), x AS ({x}),
h AS (SELECT doc_id, pos, line, CASE WHEN {q.starts('line', '+++ b/')} THEN {file} END AS f, CASE WHEN {q.starts('line', '@@ ')} THEN cast({start} AS INT) END AS st FROM x),
c AS (SELECT doc_id, pos, line, {last.format('f')} {win} AS path, {last.format('st')} {win} AS start_, {last.format('CASE WHEN st IS NOT NULL THEN pos END')} {win} AS hunk FROM h),
n AS (SELECT *, start_ - 1 + sum(CASE WHEN {q.starts('line', '-')} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, hunk ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS new_line FROM c WHERE path IS NOT NULL AND hunk IS NOT NULL AND line <> '' AND NOT {q.starts('line', 'diff ')} AND NOT {q.starts('line', '--- ')} AND NOT {q.starts('line', '+++ ')})"""


@operator()
def diff_added_lines_seeded(q):
    return f"{diff_lines(q)} SELECT doc_id, path, new_line, substring(line, 2) AS line FROM n WHERE {q.starts('line', '+')}"


@operator()
def diff_test_delta_seeded(q):
    """Assertions added and removed in test files; a fall is a gamed check."""
    a = q.has("line", r"^[+][\s]*assert")
    r = q.has("line", r"^[-][\s]*assert")
    t = q.has("path", r"(?:^|/)test_|_test[.]")
    return f"{diff_lines(q)} SELECT doc_id, path, sum(CASE WHEN {a} THEN 1 ELSE 0 END) AS added, sum(CASE WHEN {r} THEN 1 ELSE 0 END) AS removed FROM n WHERE {t} GROUP BY doc_id, path"


@operator()
def diff_windows_seeded(q):
    """Changed lines of a file that follow each other as one window."""
    return f"""{diff_lines(q)}, a AS (SELECT doc_id, path, new_line FROM n WHERE {q.starts('line', '+')}), g AS (SELECT *, new_line - row_number() OVER (PARTITION BY doc_id, path ORDER BY new_line) AS island FROM a)
SELECT doc_id, path, min(new_line) AS first_line, max(new_line) AS last_line, count(*) AS n FROM g GROUP BY doc_id, path, island"""


@operator("conversations")
def judge_agreement(q):
    """Merged runs of an injected judge: each turn counts as a run that names a signal and quotes the turn; a
    signal stands when its quotes occur in the text and most runs agree."""
    return """WITH r AS (SELECT conv_id, turn, role, substring(coalesce(text, ''), 1, 20 + turn) AS quote, coalesce(text, '') AS t FROM conversations),
v AS (SELECT conv_id, role AS signal, quote FROM r WHERE contains(t, quote) AND length(quote) > 0), n AS (SELECT conv_id, count(*) AS runs FROM r GROUP BY conv_id)
SELECT v.conv_id, v.signal, count(*) AS votes, round(cast(count(*) AS DOUBLE) / max(n.runs), 6) AS agreement, max(length(quote)) AS longest_quote FROM v JOIN n ON v.conv_id = n.conv_id GROUP BY v.conv_id, v.signal"""
