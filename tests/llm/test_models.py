import collections
import os
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import language, quality, queries
from tests.llm.cases import docs, edge, empty, words

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


@needs_data
def test_quality_on_the_held_out_fold(spark):
    rows = queries.op4_quality_classifier(spark, DATA).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.8
    assert np.mean([p for _, y, p in held if y]) > 0.95


def test_quality_separates_noise(spark):
    texts = {k: " ".join(["calm plain words in order"] * 3) if k % 2 else "x*** y&&& z### $$$" * 3 for k in range(40)}
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs(spark, texts), labels)
    scores = {r.row.doc_id: r.score for r in quality.score(docs(spark, texts), model).collect()}
    assert min(s for k, s in scores.items() if k % 2) > max(s for k, s in scores.items() if not k % 2)


def test_quality_without_labels_and_edge_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(edge(spark), none)
    rows = quality.score(edge(spark), model).collect()
    assert len(rows) == 11 and all(abs(r.score - 0.5) < 1e-9 for r in rows)
    one = quality.fit(edge(spark), spark.createDataFrame([(4, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.9 for r in quality.score(edge(spark), one).collect())
    assert quality.score(empty(spark), model).count() == 0


@needs_data
def test_language_on_the_held_out_fold(spark):
    rows = queries.op9_language_id(spark, DATA).collect()
    truth = {r.doc_id: (r.lang, len(r.text or "")) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97


def trained(spark, texts):
    return language.fit(spark.createDataFrame(texts, "text string, lang string"))


def brute_kneser_ney(texts, order=4):
    """log p of the last character of an n-gram, by plain dictionaries."""
    whole = collections.Counter()
    for text in texts:
        line = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
        line = [0] * 3 + [0, *(0 if c == " " else ord(c) for c in line), 0]
        whole.update(tuple(line[i - 3 : i + 1]) for i in range(4, len(line)))
    levels = [whole]
    for _ in range(order - 1):
        levels.insert(0, collections.Counter(g[1:] for g in levels[0]))

    def p(gram):
        if not gram:
            return 1 / 65536
        counts = levels[len(gram) - 1]
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        same = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:])
        return (max(counts[gram] - d, 0) if gram in counts else 0) / sum(same) + d * len(same) / sum(same) * p(gram[1:])

    return p


def test_kneser_ney_against_plain_dictionaries(spark):
    texts = ["the cat and the dog and the bird", "a cat, the cat; and then the end", "hat that cats had"]
    model = trained(spark, [(t, "en") for t in texts])
    p, load = brute_kneser_ney(texts), model.load(0)
    for gram in [(0, 0, 0, ord("t")), (0, ord("t"), ord("h"), ord("e")), (ord("c"), ord("a"), ord("t"), ord("q")), (ord("z"), ord("z"), ord("z"), ord("z")), (1, 2, ord("e"), 0)]:
        key = np.array([sum(c << 16 * (3 - k) for k, c in enumerate(gram))], np.uint64)
        assert load.log_p("en", key)[0] == pytest.approx(np.log(p(gram)), rel=1e-5)
    for context in ((ord("t"), ord("h"), ord("e")), (0, 0, 0), (5, 6, 7)):
        keys = (np.uint64(sum(c << 16 * (3 - k) for k, c in enumerate(context)))) | np.arange(65536, dtype=np.uint64)
        assert np.exp(load.log_p("en", keys)).sum() == pytest.approx(1, abs=1e-4)


def test_loads_of_a_large_model_give_the_same_result(spark, monkeypatch):
    spelled = str.maketrans("0123456789", "abcdefghij")
    texts = [(" ".join(words((lang, k), 60)).replace("w", lang).translate(spelled), lang) for lang in ("kl", "mn", "op") for k in range(5)]
    asked = docs(spark, {k: t for k, (t, _) in enumerate(texts)} | {90: "zz yy", 91: "mnab opc", 92: None})
    scored = lambda model: {r.row.doc_id: (r.lang_pred, r.score, r.cross_entropy) for r in language.identify(asked, model, keep=["doc_id"]).collect()}
    whole = trained(spark, texts)
    assert len(whole.loads) == 1
    want = scored(whole)
    monkeypatch.setattr(language, "MAX_MODEL_BYTES", 1500)
    parted = trained(spark, texts)
    assert len(parted.loads) > 3
    got = scored(parted)
    assert all(got[k][0] == want[k][0] and got[k][1:] == pytest.approx(want[k][1:]) for k in want if k != 92) and got[92] == want[92]


def test_languages_of_one_script_and_strange_texts(spark):
    """Cyrillic letters stay apart; a text of another language is rejected."""
    uk = ["їжак і ґава їли її їжу на ганку", "мої друзі їдуть до лісу і їдять ягоди", "є ще їжа і є її діти", "ґанок її хати є білий і міцний"]
    ru = ["ёж и ворона ели её еду на крыльце", "мои друзья едут в лес и едят ягоды", "есть ещё еда и есть её дети", "крыльцо её дома было белым и прочным"]
    model = trained(spark, [(t, "uk") for t in uk] + [(t, "ru") for t in ru])
    model = language.calibrate(model, spark.createDataFrame([(t, "uk") for t in uk] + [(t, "ru") for t in ru], "text string, lang string"))
    rows = {r.row.doc_id: r for r in language.identify(docs(spark, {1: "її їжа є", 2: "её еда была", 3: "qqq xyz kkk www jjj", 4: "ЇЖАК"}), model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 4)] == ["uk", "ru", "uk"]
    assert rows[3].rejected and not rows[4].rejected or rows[3].cross_entropy > rows[1].cross_entropy


def test_language_edge_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the dog and the bird", "en"), (2, "der hund und die katze und das tier", "de"), (3, None, "de"), (4, "no label", None)], "doc_id long, text string, lang string")
    model = language.calibrate(language.fit(train), train)
    rows = {r.row.doc_id: r for r in language.identify(docs(spark, {1: "the dog", 2: "die katze und das", 3: None, 4: "", 5: "123 !!", 6: "the"}), model).collect()}
    assert [rows[k].lang_pred for k in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[3].rejected
    assert language.identify(edge(spark), model).count() == 11
    assert language.identify(empty(spark), model).count() == 0
    assert language.fit(train.where("lang is null")) is None
    assert {r.lang_pred for r in language.identify(edge(spark), None).collect()} == {"und"}


def test_counts_do_not_cross_documents():
    data = np.frombuffer(b"abcd", np.uint8)
    kind, at = language.classes(data, np.array([0, 2, 4]))
    keys, owner = language.grams(kind, at, 3)
    assert owner.tolist() == [0, 0, 0, 1, 1, 1]
    assert keys[3] == kind[at[1] + 1]  # nothing of the document before
