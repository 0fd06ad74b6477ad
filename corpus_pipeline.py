"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as parquet in the shared
folder and reads it again as the next stage's docs. All stages but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, partenum, quality, sentencepiece_model, substring
from plumbline.llm.queries import fold, read, vocabulary
from plumbline.llm.workspace import Workspace, shrink_heaps

KEEP_SCORE = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT, REPEAT_WORDS = 5, 80, 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labels outside the held-out fold, of the input tables; without
    labels every document stays."""
    shrink_heaps(spark, now=True)
    model = quality.fit(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").where(fold(5) != 0))
    return quality.score(docs, model).where(F.col("score") >= KEEP_SCORE).select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays; blank texts all stay."""
    shrink_heaps(spark, now=True)
    return partenum.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start earlier go; a document of which no word stays goes too."""
    shrink_heaps(spark, now=True)
    out = substring.remove_repeats(docs, REPEAT_WORDS).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    fresh = {"text": F.when(changed, F.col("cleaned")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(changed, F.length("cleaned").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items all stay."""
    shrink_heaps(spark, now=True)
    hits = decontaminate.candidates(docs, read(spark, sf_dir, "benchmark"), Workspace(spark, "decontaminate"))
    bad = decontaminate.verdicts(hits).where("contaminated").select(F.col("id").alias("__bad"))
    return docs.join(bad, substring.id_of("doc_id") == F.col("__bad"), "left_anti")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and whether the ids decode to the text and are sentencepiece's own."""
    shrink_heaps(spark, now=True)
    out = sentencepiece_model.encode(docs.select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), decoded=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip", "parity")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: Training, union by similarity and subword merges aren't SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{n}")
    return docs
