"""Set-level jobs: evaluation against labels, folds, drift, mining and anchors."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dialect import SPARK, Spark
from plumbline.operators import ngrams
from plumbline.operators.structure import base, seven
from plumbline.operators.matching import full_lexicon, rows_of
from plumbline.plans.catalog import operator
from plumbline.sources.storage import scratch


def labelled(q: Spark) -> str:
    """CTE lab: doc_id, lang, source, score, bad (label quality 0)."""
    return f"{seven(q, more='lang, source')}, lab AS (SELECT s.doc_id, s.lang, s.source, s.overall AS score, l.quality = 0 AS bad FROM scored s JOIN labels l ON s.doc_id = l.doc_id)"


COUNTS = "count(*) AS n, sum(CASE WHEN hit AND bad THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN hit AND NOT bad THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT hit AND NOT bad THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN NOT hit AND bad THEN 1 ELSE 0 END) AS fn"
METRICS = "round(cast(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision_, round(cast(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall_, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(cast(tp + tn AS DOUBLE) / nullif(n, 0), 6) AS accuracy, round(cast(fp AS DOUBLE) / nullif(fp + tn, 0), 6) AS fp_rate, round(cast(fn AS DOUBLE) / nullif(fn + tp, 0), 6) AS fn_rate"


@operator("documents", "labels")
def confusion_grouping_sets(q):
    return f"{labelled(q)}, h AS (SELECT *, score >= 0.2 AS hit FROM lab), c AS (SELECT lang, source, {COUNTS} FROM h GROUP BY GROUPING SETS ((), (lang), (source))) SELECT lang, source, n, tp, fp, tn, fn, {METRICS} FROM c"


GRID = [round(0.05 * k, 2) for k in range(1, 13)]


def swept(q: Spark, source: str, keep: str) -> str:
    """Rows of source at each threshold of the grid."""
    grid = q.array(*(f"cast({x} AS DOUBLE)" for x in GRID))
    return q.explode(keep, source, grid, "step", "threshold")


@operator("documents", "labels")
def threshold_sweep(q):
    return f"{labelled(q)}, sw AS ({swept(q, 'lab', 'score, bad')}), h AS (SELECT threshold, bad, score >= threshold AS hit FROM sw), c AS (SELECT threshold, {COUNTS} FROM h GROUP BY threshold) SELECT round(threshold, 2) AS threshold, n, tp, fp, tn, fn, {METRICS} FROM c"


@operator("documents", "labels")
def quality_gates(q):
    """Gates on unrounded precision and recall at the decision threshold, for all and by language; undefined values don't pass."""
    return f"""{labelled(q)}, h AS (SELECT *, score >= 0.2 AS hit FROM lab), c AS (SELECT lang, {COUNTS} FROM h GROUP BY GROUPING SETS ((), (lang))),
r AS (SELECT lang, n, cast(tp AS DOUBLE) / nullif(tp + fp, 0) AS p, cast(tp AS DOUBLE) / nullif(tp + fn, 0) AS r FROM c)
SELECT lang, n, coalesce(p >= 0.5, false) AS precision_ok, coalesce(r >= 0.5, false) AS recall_ok, coalesce(p >= 0.5 AND r >= 0.5, false) AS passed FROM r"""


@operator("documents", "labels")
def control_set_gate(q):
    """Each labelled document against its threshold (by language, as genres are): bad ones must reach it, unless known to be
    missed, good ones must stay below."""
    bar = q.values([("en", 0.40), ("de", 0.45), ("fr", 0.50)], ["lang", "threshold"])
    known = f"{q.mod('doc_id', 7)} = 0"
    return f"""{labelled(q)}, bar AS {bar}, j AS (SELECT l.doc_id, l.score, l.bad, coalesce(b.threshold, 0.40) AS threshold, {known} AS known_fn FROM lab l LEFT JOIN bar b ON l.lang = b.lang),
s AS (SELECT *, CASE WHEN bad AND score >= threshold THEN 'hit' WHEN bad AND known_fn THEN 'known_miss' WHEN bad THEN 'miss' WHEN score < threshold THEN 'clean' ELSE 'false_alarm' END AS status FROM j)
SELECT status, count(*) AS n, round(avg(score), 6) AS mean_score FROM s GROUP BY status"""


@operator("documents", "labels")
def evaluation_errors(q):
    return f"{labelled(q)} SELECT doc_id, lang, score, bad, CASE WHEN bad THEN 'missed' ELSE 'false_alarm' END AS error FROM lab WHERE (score >= 0.2) <> bad"


@operator("labels")
def stratified_folds(q):
    """Five folds, each label dealt in turn, in an order given by a hash of the id."""
    h = q.sha256("concat('17:', cast(doc_id AS {}))".format("string" if q.name == "spark" else "VARCHAR"))
    return f"SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY {h}, doc_id) - 1) % 5 AS fold FROM labels"


@operator("documents", "labels")
def cross_validated_threshold(q):
    """For each fold the threshold that is best on the others, and the fold's counts at it. Counts are made
    once for each fold and threshold; those of the other folds are the totals less the fold's."""
    h = q.sha256("concat('17:', cast(doc_id AS {}))".format("string" if q.name == "spark" else "VARCHAR"))
    counts = "sum(CASE WHEN score >= threshold AND bad THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold AND NOT bad THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN score < threshold AND bad THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN score < threshold AND NOT bad THEN 1 ELSE 0 END) AS tn"
    return f"""{labelled(q)}, f AS (SELECT score, bad, (row_number() OVER (PARTITION BY bad ORDER BY {h}, doc_id) - 1) % 5 AS fold FROM lab), sw AS ({swept(q, 'f', 'score, bad, fold')}),
t AS (SELECT fold, threshold, {counts} FROM sw GROUP BY fold, threshold),
o AS (SELECT *, sum(tp) OVER (PARTITION BY threshold) - tp AS otp, sum(fp) OVER (PARTITION BY threshold) - fp AS ofp, sum(fn) OVER (PARTITION BY threshold) - fn AS ofn FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY coalesce(2.0 * otp / nullif(2 * otp + ofp + ofn, 0), 0) DESC, threshold) AS place FROM o)
SELECT fold, round(threshold, 2) AS threshold, tp, fp, fn, tn FROM b WHERE place = 1"""


@operator("documents", "labels")
def score_percentiles(q):
    return f"{labelled(q)} SELECT bad, count(*) AS n, {q.percentile('score', 0.1)} AS p10, {q.percentile('score', 0.5)} AS p50, {q.percentile('score', 0.9)} AS p90 FROM lab GROUP BY bad"


def each(keep: str, hits: list[tuple[str, str]], name: str) -> str:
    """Rows (name, hit) for each row of j in Spark: the branches of a union would each make the scores again."""
    rows = ", ".join(f"named_struct('name', {n}, 'hit', {h})" for n, h in hits)
    return f"SELECT {keep}, e.name AS {name}, e.hit AS hit FROM j LATERAL VIEW explode(array({rows})) x AS e"


@operator("documents", "labels")
def signal_hit_rates(q):
    dims = ["density", "repetition", "burstiness", "buzzword", "punctuation", "moral", "list"]
    parts = " UNION ALL ".join(f"SELECT quality, '{d}' AS signal, CASE WHEN {d}_slop >= 0.5 THEN 1 ELSE 0 END AS hit FROM j" for d in dims)
    if q.name == "spark":
        parts = each("quality", [(f"'{d}'", f"CASE WHEN {d}_slop >= 0.5 THEN 1 ELSE 0 END") for d in dims], "signal")
    return f"{seven(q)}, j AS (SELECT s.*, l.quality FROM scored s JOIN labels l ON s.doc_id = l.doc_id), u AS ({parts}) SELECT quality, signal, count(*) AS n, sum(hit) AS hits, round(cast(sum(hit) AS DOUBLE) / count(*), 6) AS rate FROM u GROUP BY quality, signal"


@operator()
def baseline_drift_full_join(q):
    """A frozen register against the scores of today: missing, new, moved by more than 0.02, text changed."""
    # Spark makes the hash before the counts, so that no text is exchanged.
    h, more = ("hashed", f"{q.sha256(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS hashed") if q.name == "spark" else (q.sha256("t"), "")
    return f"""{seven(q, more)}, now_ AS (SELECT doc_id, overall AS score, {h} AS hash FROM scored WHERE doc_id % 7 <> 3),
then_ AS (SELECT doc_id, round(CASE WHEN doc_id % 11 = 0 THEN overall + 0.05 ELSE overall END, 3) AS score, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE {h} END AS hash FROM scored WHERE doc_id % 5 <> 2)
SELECT coalesce(n.doc_id, t.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN t.doc_id IS NULL THEN 'unknown' WHEN n.hash <> t.hash THEN 'text_changed' ELSE 'score_drift' END AS kind, round(n.score - t.score, 3) AS delta
FROM now_ n FULL OUTER JOIN then_ t ON n.doc_id = t.doc_id WHERE n.doc_id IS NULL OR t.doc_id IS NULL OR n.hash <> t.hash OR abs(n.score - t.score) > 0.02"""


@operator("documents", "labels")
def integrity_report(q):
    """Repeated ids, repeated texts, blank texts and labels without a document."""
    return """SELECT (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS repeated_ids, (SELECT count(*) - count(DISTINCT text) FROM documents WHERE text IS NOT NULL) AS repeated_texts,
(SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = '') AS blank_texts, (SELECT count(*) FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL) AS lost_labels"""


@operator("documents", "labels")
def weight_gain_report(q):
    """The calibrated weights against equal ones, at the same threshold."""
    from plumbline.functions.lexicon import WEIGHTS_7

    names = {"buzzwords": "buzzword", "trailing_moral": "moral", "list_heavy": "list"}
    dims = [names.get(d, d) + "_slop" for d in WEIGHTS_7]
    fixed = " + ".join(f"{w} * {d}" for d, w in zip(dims, WEIGHTS_7.values()))
    even = "(" + " + ".join(dims) + f") / {len(dims)}.0"
    both = "SELECT 'calibrated' AS weights, a >= 0.2 AS hit, bad FROM j UNION ALL SELECT 'uniform', b >= 0.2, bad FROM j"
    if q.name == "spark":
        both = each("bad", [("'calibrated'", "a >= 0.2"), ("'uniform'", "b >= 0.2")], "weights")
    return f"""{seven(q)}, j AS (SELECT round({fixed}, 6) AS a, round({even}, 6) AS b, l.quality = 0 AS bad FROM scored s JOIN labels l ON s.doc_id = l.doc_id),
u AS ({both}), c AS (SELECT weights, {COUNTS} FROM u GROUP BY weights) SELECT weights, n, tp, fp, tn, fn, {METRICS} FROM c"""


# --- mining ---------------------------------------------------------------------------------------------
#: Lengths of mined n-grams, and documents that they must be in.
SIZES, MIN_DOCS = (2, 3, 4, 5), 2


def grams(q: Spark, least: int) -> str:
    """CTE df: document frequency of 2- to 5-grams that at least so many documents have. The n-grams of a
    document are made distinct before the exchange."""
    n = q.size("w")
    made = []
    for k in SIZES:
        if q.name == "spark":
            made.append(f"CASE WHEN {n} >= {k} THEN array_distinct(transform(sequence(1, {n} - {k - 1}), i -> array_join(slice(w, i, {k}), ' '))) ELSE cast(array() AS array<string>) END")
        else:
            made.append(f"CASE WHEN {n} >= {k} THEN list_distinct(list_transform(range(1, {n} - {k} + 2), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))) ELSE [] END")
    parts = " UNION ALL ".join(f"SELECT {k} AS n, g FROM ({q.explode('doc_id', 'm', f'g{k}', 'pos', 'g')}) e{k}" for k in SIZES)
    return f"{base(q)}, m AS (SELECT doc_id, {', '.join(f'{x} AS g{k}' for k, x in zip(SIZES, made))} FROM prep), x AS ({parts}), df AS (SELECT g, n, count(*) AS df FROM x GROUP BY g, n HAVING count(*) >= {least})"


def frequencies(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """ngram_document_frequency without an exchange of the n-grams of one document only."""
    return ngrams.repeated(documents, SIZES).select(F.col("g").alias("phrase"), "n", "df")


@operator(made=frequencies)
def ngram_document_frequency(q):
    return f"{grams(q, MIN_DOCS)} SELECT g AS phrase, n, df FROM df"


def chosen(q: Spark) -> str:
    """The rest of mine_candidates_topk after CTE df."""
    terms = sorted({r[4] for r in rows_of({k: v for k, v in full_lexicon().items() if k in ("buzzword", "phrase")})})
    words = ", ".join(q.lit(w) for w in sorted({w for t in terms for w in t.split()}))
    line, held_ = "concat(' ', g, ' ')", q.array_of([f" {t} " for t in terms])
    known = f"(CASE WHEN df < {MIN_DOCS} OR {q.size(q.filter(q.split('g', ' '), 'x', f'x IN ({words})'))} = 0 THEN false ELSE {q.size(q.filter(held_, 'x', f'contains({line}, x) OR contains(x, {line})'))} > 0 END)"
    return f"""open AS (SELECT * FROM df WHERE NOT {known}),
wider AS (SELECT df, {q.sub('g', ' [^ ]+$', '')} AS g FROM open WHERE n > 2 UNION SELECT df, {q.sub('g', '^[^ ]+ ', '')} FROM open WHERE n > 2),
top AS (SELECT o.* FROM open o LEFT JOIN wider w ON o.g = w.g AND o.df = w.df WHERE w.g IS NULL ORDER BY o.df DESC, o.n DESC, o.g LIMIT {MINED})
SELECT row_number() OVER (ORDER BY df DESC, n DESC, g) AS place, g AS phrase, n, df FROM top"""


#: How many n-grams are mined, and how many cells the first look takes in.
MINED, FIRST_CELLS = 40, 2_000


def mined(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """mine_candidates_topk from the most frequent down: what has at least so many documents and what covers it, as both have as many,
    comes from cells whose counts reach that number. If there are too few, the number falls, at last to MIN_DOCS."""
    cells = ngrams.cell_counts(documents, SIZES)
    ordered, reach = np.sort(cells, axis=None)[::-1], FIRST_CELLS
    while True:
        least = max(MIN_DOCS, int(ordered[reach])) if reach < len(ordered) else MIN_DOCS
        path, view = scratch(spark, "mined"), f"mined_{uuid.uuid4().hex[:12]}"
        ngrams.counted(documents, SIZES, cells, least).write.parquet(path)
        spark.read.parquet(path).createOrReplaceTempView(view)
        found = spark.sql(f"WITH df AS (SELECT * FROM {view}), {chosen(SPARK)}")
        rows = found.collect()
        spark.catalog.dropTempView(view)
        if len(rows) == MINED or least == MIN_DOCS:
            return spark.createDataFrame(rows, found.schema)
        reach = 20 * (reach + 1)


@operator(made=mined)
def mine_candidates_topk(q):
    """Frequent n-grams that no longer, as frequent one covers, and that hold no known term and are held by none: the first
    40. One that covers is as frequent one word further too, so a look at the next length is enough."""
    return f"{grams(q, MIN_DOCS)}, {chosen(q)}"


# --- anchors --------------------------------------------------------------------------------------------
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def canonical(q: Spark, x: str) -> str:
    """3,5 is 3.5; groups of three digits are thousands."""
    grouped = q.has(x, r"^[0-9]+(?:[.,][0-9]{3})+$")
    return f"CASE WHEN {grouped} THEN {q.sub(x, '[.,]', '')} ELSE {q.sub(x, ',', '.')} END"


@operator()
def anchor_numbers(q):
    x = q.explode("doc_id", "a", "xs", "pos", "x")
    return f"WITH a AS (SELECT doc_id, {q.all(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')', NUMBER)} AS xs FROM documents), x AS ({x}) SELECT doc_id, {canonical(q, 'x')} AS number_, count(*) AS n FROM x GROUP BY 1, 2"


@operator("conversations")
def anchor_diff_turns(q):
    """Anchors that a turn has and the turn before it hasn't, as a multiset, and the reverse."""
    seed = "concat(coalesce(text, ''), CASE turn % 3 WHEN 0 THEN ' costs 3,5 and 1.000 units' WHEN 1 THEN ' costs 3.5 and 1,000 and 7 units see https://a.example/x' ELSE ' has 7 and 7 parts' END)"
    words = f"{NUMBER}|https?://[^\\s]+"
    x = q.explode("conv_id, turn", "a", "xs", "pos", "x")
    return f"""WITH a AS (SELECT conv_id, turn, {q.all(seed, words)} AS xs FROM conversations), x AS ({x}),
c AS (SELECT conv_id, turn, {canonical(q, 'x')} AS value, count(*) AS n FROM x GROUP BY 1, 2, 3),
p AS (SELECT conv_id, turn + 1 AS turn, value, n FROM c), t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn > 0),
j AS (SELECT coalesce(c.conv_id, p.conv_id) AS conv_id, coalesce(c.turn, p.turn) AS turn, coalesce(c.value, p.value) AS value, coalesce(c.n, 0) - coalesce(p.n, 0) AS d FROM c FULL OUTER JOIN p ON c.conv_id = p.conv_id AND c.turn = p.turn AND c.value = p.value)
SELECT j.conv_id, j.turn, value, CASE WHEN d > 0 THEN 'added' ELSE 'lost' END AS kind, abs(d) AS n FROM j JOIN t ON j.conv_id = t.conv_id AND j.turn = t.turn WHERE d <> 0"""


@operator()
def source_claims_seeded(q):
    """Identifiers of sources by kind, and whether they are well formed."""
    seed = "concat(coalesce(text, ''), CASE doc_id % 4 WHEN 0 THEN ' see arXiv:2301.12345v2 and doi 10.1000/xyz123' WHEN 1 THEN ' see https://example.org/a' WHEN 2 THEN ' see arXiv:99.1' ELSE '' END)"
    return f"WITH s AS (SELECT doc_id, {seed} AS t FROM documents) SELECT doc_id, {q.count('t', 'arXiv:[0-9]{4}[.][0-9]{4,5}')} AS arxiv, {q.count('t', 'arXiv:')} AS arxiv_claims, {q.count('t', '10[.][0-9]{4,9}/[A-Za-z0-9._;()/:-]+')} AS doi, {q.count('t', 'https?://[^ ]+')} AS urls FROM s"

