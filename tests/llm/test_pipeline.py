import corpus_pipeline
from plumbline.llm import workspace
from tests.llm.cases import edge, empty, words
from tests.llm.test_substring import brute as without_repeats

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, labels, bench):
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    noise = lambda k: " ".join(f"{w}***" for w in words(("noise", k), 60))
    rows = [(k, noise(k) if k % 6 == 0 else " ".join(words(("doc", k), 120))) for k in range(60)]
    base = dict(rows)
    base[101] = base[7] + " extra"  # near copy
    base[102] = " ".join(words("p", 40)) + " " + " ".join(words("q", 60))
    base[103] = " ".join(words("r", 60)) + " " + " ".join(words("p", 40))  # repeats a passage
    item = " ".join(words("bench", 30))
    base[104] = " ".join(words("s", 60)) + " " + item
    base[105], base[106] = None, ""
    labels = [(k, int(k % 6 != 0), 0) for k in range(60)]
    folder = f"file://{tmp_path}/sf"
    write(spark, folder, list(base.items()), labels, [(1, item)])
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    want = {k for k in base if not (k < 60 and k % 6 == 0) and k not in (101, 104)}
    assert set(out) == want
    texts = {k: t for k, t in base.items() if k in want | {104}}
    assert without_repeats(texts)[103][1] == 40
    assert out[103].n_pieces < out[102].n_pieces and all(r.round_trip and r.parity for r in out.values())
    assert out[105].ids == []


def test_each_stage_stands_edge_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    write(spark, folder, [(1, "a b c")], [(1, 1, 0)], [(1, "some item that is nowhere to be found at all")])
    for make in (edge, empty):
        docs = make(spark)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            if k < 4:
                assert out.columns == docs.columns
            assert out.count() == 0 if make is empty else out.count() > 0


def test_executors_give_back_their_heaps(spark, monkeypatch):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("heaps"))
    spark.sparkContext.setJobGroup("heaps", "heaps")
    try:
        workspace.shrink_heaps(spark, now=True)
        assert jobs() == 0  # local mode
        monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[1,1,1024]")
        workspace.shrink_heaps(spark, now=True)
        workspace.shrink_heaps(spark)  # too soon
        assert jobs() == 1
        workspace.shrink_heaps(spark, now=True)
        assert jobs() == 2
    finally:
        spark.sparkContext.setJobGroup("", "")
