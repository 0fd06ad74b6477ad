import random

import numpy as np
import pyarrow as pa

from plumbline.llm import substring
from plumbline.llm import textscan as T
from tests.llm.cases import docs, edge, empty, words


def brute(texts, window=20):
    seen, out = set(), {}
    for key in sorted(texts):
        w = (texts[key] or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        out[key] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    passages = [words(k, rng.choice([15, 20, 25, 60])) for k in range(6)]
    texts = {}
    for k in range(40):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages) if rng.random() < 0.6 else words(rng.random(), rng.randrange(1, 40))
        texts[k * 7 % 41] = rng.choice([" ", "\n", " \t"]).join(w)
    texts[900], texts[901] = "a " * 50, None
    rows = substring.remove_repeats(docs(spark, texts)).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute(texts)
    for r in rows:
        assert (r.cleaned or "").split() == r.kept.split()


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_WINDOWS", 50)
    shared = words(3, 30)
    texts = {k: " ".join(words(k + 10, 30) + shared + words(k + 90, 5)) for k in range(6)}
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs(spark, texts).repartition(3)).collect()} == brute(texts)


def test_edge_rows_and_empty_table(spark):
    rows = substring.remove_repeats(edge(spark)).collect()
    assert len(rows) == 11 and all(r.n_removed == 0 for r in rows)
    assert {r.row.doc_id: r.row.key for r in rows}[4] == "k"
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = " ".join(words(2, 40))
    rows = substring.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.row.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 40)]


def test_levels_double_until_none_survive(spark):
    assert substring.level_lengths(20) == [10, 20] and substring.level_lengths(64) == [8, 16, 32, 64] and substring.level_lengths(21) == [11, 21]
    shared = words(4, 70)
    texts = {1: " ".join(shared), 2: " ".join(words(9, 9) + shared), 3: " ".join(words(8, 50))}
    assert {r.id: r.length for r in substring.longest_repeats(docs(spark, texts)).collect()} == {1: 64, 2: 64}


def test_every_window_is_doubled(spark):
    assert substring.level_lengths(20) == [10, 20] and substring.level_lengths(25) == [13, 25] and substring.level_lengths(13) == [7, 13]
    assert substring.level_lengths(64) == [8, 16, 32, 64] and substring.level_lengths(1) == [1] and substring.level_lengths(2) == [1, 2]
    rng, passages = random.Random(8), [words(("odd", k), 40) for k in range(3)]
    texts = {k: " ".join(words(rng.random(), rng.randrange(20)) + rng.choice(passages)[rng.randrange(20) :] + words(rng.random(), 5)) for k in range(25)}
    for window in (3, 13, 25):
        rows = substring.remove_repeats(docs(spark, texts), window).collect()
        assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute(texts, window)


def test_words_of_equal_first_hash_are_told_apart(spark, monkeypatch):
    """The first hash of all windows made equal: the second alone decides."""
    plain = T.window_hashes

    def weak(words_, doc, length, salt=0, base=T.BASE_WORD):
        at, h = plain(words_, doc, length, salt, base)
        return at, (np.full(len(h), 5, dtype=np.uint64) if base == T.BASE_WORD else h)

    shared = words("w", 30)
    texts = {k: words(k, 25) + shared for k in range(4)}
    column = pa.array([" ".join(t) for t in texts.values()])
    monkeypatch.setattr(T, "window_hashes", weak)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("C", (), {"partitionId": lambda self: 0})())
    slots = np.array([0], dtype=np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts), pa.int64()), column], ["id", "text"])
    packed = pa.Table.from_batches(list(substring._emit(20, 0, 64, slots, False, True)(iter([batch]))))
    found = substring._by_document(substring._decide(True, slots)(packed))
    want = brute({k: " ".join(t) for k, t in texts.items()})
    assert {i: len(substring.decode_starts(s)) for i, s in zip(found["id"].to_pylist(), found["starts"].to_pylist())} == {k: 11 for k in (1, 2, 3)} and all(want[k][1] == 30 for k in (1, 2, 3))
