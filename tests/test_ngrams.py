"""Mining by hashed cells: the same rows as the SQL, few n-grams exchanged."""

import pytest

from plumbline import plans
from plumbline.functions.dialect import PLAIN_SPARK
from plumbline.operators import evaluation, ngrams
from plumbline.plans.catalog import OPERATORS

TEXTS = ["The red fox ran home. The red fox ran home again.", "the red fox ran home, said the owl", "Moreover the red fox ran", None, "", "重要な the red fox", "a b a b a b", "a b a b", "Ünder die a b"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_sql(spark, frame):
    frame.createOrReplaceTempView("documents")
    return sorted(map(tuple, spark.sql(evaluation.mine_candidates_topk(PLAIN_SPARK)).collect()))


@pytest.mark.parametrize("first", [0, 3, 10**9])
def test_mined_as_by_sql(spark, monkeypatch, first):
    plans.load()
    monkeypatch.setattr(evaluation, "FIRST_CELLS", first)
    frame = docs(spark)
    assert sorted(map(tuple, OPERATORS["mine_candidates_topk"].frame(spark, documents=frame).collect())) == by_sql(spark, frame)


def test_a_rank_of_ties_is_cut_as_by_sql(spark, monkeypatch):
    plans.load()
    monkeypatch.setattr(evaluation, "FIRST_CELLS", 1)
    frame = docs(spark, [f"{w} {w}x {w}y" for w in map(chr, range(97, 123)) for _ in range(3)])
    rows = OPERATORS["mine_candidates_topk"].frame(spark, documents=frame).collect()
    assert sorted(map(tuple, rows)) == by_sql(spark, frame)


def test_few_ngrams_are_exchanged(spark):
    """What may be mined is sent; before, every n-gram of every document was."""
    frame = docs(spark, ["the red fox ran"] * 50 + [" ".join(f"w{d}x{i}" for i in range(40)) for d in range(50)])
    cells = ngrams.cell_counts(frame, evaluation.SIZES)
    assert ngrams.counted(frame, evaluation.SIZES, cells, 50).count() == 6
    sent = ngrams.counted(frame, evaluation.SIZES, cells, 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in sent and "MapInArrow" in sent


@pytest.mark.parametrize("size", [16, 1 << 24])
def test_frequencies_as_by_sql(spark, monkeypatch, size):
    plans.load()
    monkeypatch.setattr(ngrams, "GROUP_BYTES", size)
    monkeypatch.setattr(ngrams, "BUCKET_BYTES", size)
    monkeypatch.setattr(ngrams, "CHUNK", 7)
    frame = docs(spark, TEXTS * 3 + ["x y", "x", "x y z", None, "\U00010400a \U00010400b", "\U00010400a \U00010400b"])
    frame = frame.union(frame.where("doc_id < 3")).union(frame.where("doc_id = 1").selectExpr("cast(null AS long)", "text"))
    frame.createOrReplaceTempView("documents")
    wanted = sorted(map(tuple, spark.sql(evaluation.ngram_document_frequency(PLAIN_SPARK)).collect()))
    found = OPERATORS["ngram_document_frequency"].frame(spark, documents=frame)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 20
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_frequencies_of_nothing(spark):
    plans.load()
    assert OPERATORS["ngram_document_frequency"].frame(spark, documents=docs(spark, [None, "", "one"])).count() == 0
    assert OPERATORS["mine_candidates_topk"].frame(spark, documents=docs(spark, [None, "", "one"])).count() == 0


def test_ngrams_of_one_document_are_not_counted(spark):
    """N-grams go through hashes before any string is made; before, each was exploded and exchanged."""
    frame = docs(spark, ["the red fox ran"] * 50 + [" ".join(f"w{d}x{i}" for i in range(40)) for d in range(50)])
    found = ngrams.repeated(frame, evaluation.SIZES)
    assert found.count() == 6
    seen = found._jdf.queryExecution().optimizedPlan().toString()
    assert seen.count("MapInArrow") == 3
