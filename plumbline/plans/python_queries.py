"""Queries of operators in Python and of streams, with SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dialect import DUCK, SPARK
from plumbline.functions.lexicon import BUZZWORDS, WEIGHTS_7
from plumbline.operators import python_tier as P
from plumbline.operators.matching import seeded
from plumbline.operators.structure import seven
from plumbline.sources.storage import scratch
from plumbline.streaming import jobs

#: A module in each style that the ladder tells apart.
MODULES = [
    "def parse(x):\n    return x.split(',')\n\ndef parse_row(x):\n    return parse(x)\n\ndef test_parse():\n    assert parse('a') == ['a']\n",
    "def save(path):\n    pass\n\ndef main():\n    return load(1)\n\ndef load(n):\n    return n + 1\n",
    "import random\n\ndef measure(data):\n    return random.random()\n\ndef measured(data):\n    return 0.9\n",
    "def broken(:\n",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def seeded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.expr(seeded(SPARK)).alias("text"))


def with_modules(docs: DataFrame) -> DataFrame:
    """Documents with an example module in a fenced block at their end."""
    module = F.element_at(F.array(*[F.lit(f"\n```python\n{m}```\n") for m in MODULES]), (F.pmod("doc_id", F.lit(len(MODULES))) + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), module).alias("text"))


def modules(docs: DataFrame) -> DataFrame:
    """(doc_id, source) of the fenced Python blocks of the texts, joined; texts without one have no row."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)```python\n(.*?)```"), F.lit(1))
    return docs.select("doc_id", F.array_join(blocks, "\n").alias("source")).where("source <> ''")


TERMS = [w for tier in BUZZWORDS.values() for w in tier] + ["^in [X] we", "here are [N] ways"]


def term_spans_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.match_terms(documents(spark, sf_dir).select("doc_id", "text"), TERMS)


def term_spans_exact_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.match_terms(seeded_documents(spark, sf_dir), TERMS)


def nfkc_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.normalized(documents(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def markdown_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.markup_stripped(documents(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("kept_chars"))


def forced_triads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.forced_triads(documents(spark, sf_dir).select("doc_id", "text"))


def forced_triads_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" It is reliable, scalable, and fast. People. Process. Tools."))).otherwise(F.col("text")).alias("text"))
    return P.forced_triads(docs)


def verification_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.verification_ladder(modules(documents(spark, sf_dir)))


def verification_ladder_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.verification_ladder(modules(with_modules(documents(spark, sf_dir))))


def reinvented_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reinvented_functions(modules(documents(spark, sf_dir)))


def reinvented_functions_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reinvented_functions(modules(with_modules(documents(spark, sf_dir))))


def calibrated_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    names = {"buzzwords": "buzzword", "trailing_moral": "moral", "list_heavy": "list"}
    dims = ", ".join(f"{names.get(d, d)}_slop AS {d}" for d in WEIGHTS_7)
    path = scratch(spark, "features")
    spark.sql(f"{seven(SPARK)} SELECT {dims}, l.quality = 0 AS bad FROM scored s JOIN labels l ON s.doc_id = l.doc_id").write.parquet(path)
    found = P.calibrate(spark.read.parquet(path))
    return spark.createDataFrame(sorted(found.items()), "dimension string, weight double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [term_spans_exact, term_spans_exact_seeded, nfkc_normalised, markdown_stripped, forced_triads, forced_triads_seeded, verification_ladder, verification_ladder_seeded, reinvented_functions, reinvented_functions_seeded, calibrated_weights, jobs.stream_scored_documents, jobs.stream_event_windows, jobs.stream_user_sessions]
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    gap = "epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))"
    return {
        "stream_scored_documents": f"{seven(DUCK)} SELECT doc_id, overall FROM scored",
        "stream_event_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
        "stream_user_sessions": f"WITH g AS (SELECT *, {gap} AS gap FROM events WHERE ts IS NOT NULL), i AS (SELECT *, sum(CASE WHEN gap < 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM i GROUP BY user_id, s",
        "markdown_stripped": "SELECT doc_id, length(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: NOT (starts_with(ltrim(l, ' ' || chr(9)), '>') OR starts_with(ltrim(l, ' ' || chr(9)), '|') OR starts_with(l, '    ') OR starts_with(l, chr(9)))), lambda l: regexp_replace(l, '`[^`' || chr(10) || ']*`', '', 'g')), chr(10))) AS kept_chars FROM documents",
    }
