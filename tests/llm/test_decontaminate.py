import random

import numpy as np

from plumbline.llm import decontaminate as D
from plumbline.llm import queries
from plumbline.llm.workspace import Workspace
from tests.llm.cases import docs, edge, empty, words


def found(spark, texts, items):
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return {r.id: r for r in D.verdicts(D.candidates(docs(spark, texts), bench, Workspace(spark, "t"))).collect()}


def test_passages_and_paraphrases(spark):
    rng = random.Random(2)
    items = {k: " ".join(words(("item", k), 30, 10**5)).capitalize() + ". The answer is " + " ".join(words(("answer", k), 4, 10**5)) + "." for k in range(20)}
    texts = {100 + k: " ".join(words(k, 300, 10**5)) for k in range(60)}
    for k in range(5):  # word for word, in the middle
        w = texts[100 + k].split()
        texts[100 + k] = " ".join(w[:77] + items[k].upper().replace(".", ";").split() + w[77:])
    for k in range(5, 8):  # one word in seven exchanged
        w = [x if i % 7 else f"other{rng.random()}" for i, x in enumerate(items[k].split())]
        texts[100 + k] += " " + " ".join(w)
    got = found(spark, texts, items)
    bad = {k: r.item_id for k, r in got.items() if r.contaminated}
    assert bad == {100 + k: k for k in range(8)}
    assert all(got[100 + k].lcs_ratio == 1.0 for k in range(5))


def test_short_items_must_stand_word_for_word(spark):
    items = {1: "zyx wvu tsr", 2: "qpo nml kji"}
    texts = {1: "here zyx wvu tsr stands", 2: "here qpo x nml y kji stands", 3: "nothing"}
    assert {k for k, r in found(spark, texts, items).items() if r.contaminated} == {1}


def test_long_items_match_by_passage(spark):
    item = words("long", 400, 10**6)
    texts = {1: " ".join(words(1, 50) + item[100:180] + words(2, 50)), 2: " ".join(words(3, 200))}
    assert {k for k, r in found(spark, texts, {7: " ".join(item)}).items() if r.contaminated} == {1}


def test_more_items_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 3)
    items = {k: " ".join(words(("b", k), 20, 10**6)) for k in range(8)}
    texts = {k: items[k] for k in range(8)} | {50: " ".join(words(9, 100))}
    assert {k: r.item_id for k, r in found(spark, texts, items).items() if r.contaminated} == {k: k for k in range(8)}


def test_edge_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, None), (None, "same text of five words"), (2, ""), (3, "...")], "item_id long, text string")
    assert D.candidates(edge(spark), none, Workspace(spark, "t")).count() == 0
    assert D.candidates(empty(spark), some, Workspace(spark, "t")).count() == 0
    assert {r.id for r in D.verdicts(D.candidates(edge(spark), some, Workspace(spark, "t"))).collect() if r.contaminated} == {5, 6}


def test_lcs_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert D.lcs(masks, len(a), b) == row[-1]


def test_retrieval_recall_against_full_cosine(spark):
    """Latent search finds what the whole TF-IDF space puts above the threshold."""
    items = {k: " ".join(words(("r", k), 35, 5000)) for k in range(30)}
    rng = random.Random(4)
    texts = {k: " ".join(words(("d", k), 60, 5000) + [x for x in items[k % 30].split() if rng.random() < 0.8]) for k in range(90)}
    got = found(spark, texts, items)
    assert sum(k in got and got[k].item_id == k % 30 for k in texts) >= 0.9 * len(texts)


def by_brute_force(texts, items):
    """Documents and items whose LCS around any passage is that of a contaminated one, without a search before."""
    out = set()
    for k, item in items.items():
        w = D.text_words(item).tolist()
        masks = {}
        for i, x in enumerate(w):
            masks[x] = masks.get(x, 0) | 1 << i
        for d, text in texts.items():
            t = D.text_words(text).tolist()
            starts = range(0, max(1, len(t) - D.CELL), D.CELL)
            if any(D.lcs(masks, len(w), t[max(0, s - len(w)) : s + 2 * D.CELL + len(w)]) >= D.LCS_ALONE * len(w) for s in starts):
                out.add(d)
    return out


def test_recall_of_short_and_frequent_items_against_brute_force(spark):
    rng = random.Random(8)
    usual = [f"usual{k}" for k in range(40)]  # in most passages: no weight
    mixed = lambda seed, n: [x if rng.random() < 0.6 else rng.choice(usual) for x in words(seed, n, 3000)]
    items = {k: " ".join(mixed(("short", k), 10 + k % 10)) for k in range(30)}
    texts = {1000 + k: " ".join(mixed(("plain", k), 240)) for k in range(60)}
    for k, item in items.items():
        for n in range(3):
            w = item.split()
            for i in rng.sample(range(len(w)), len(w) * 3 // 10):
                w[i] = f"other{rng.random()}"
            around = mixed((k, n), 200)
            texts[10 * k + n] = " ".join(around[:90] + w + around[90:])
    want = by_brute_force(texts, items)
    bad = {k for k, r in found(spark, texts, items).items() if r.contaminated}
    assert len(want) >= 90 and want <= bad


def test_null_ids_of_documents_and_items(spark, tmp_path):
    item, other = " ".join(words("null item", 30)), " ".join(words("other item", 30))
    rows = [(None, " ".join(words("around", 40)) + " " + item), (1, "clean words of nothing"), (2, other)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, item), (5, other), (6, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    found = {r.doc_id: (r.contaminated, r.item_id) for r in queries.op1_decontamination(spark, f"file://{tmp_path}").collect()}
    assert found == {None: (True, None), 1: (False, None), 2: (True, 5)}


def test_blocks_in_several_scans_give_the_same(spark, monkeypatch):
    items = {k: " ".join(words(("block", k), 14 + k)) for k in range(9)}
    texts = {k: " ".join(words(("text", k), 60)) + " " + items[k % 9] + " " + " ".join(words(("after", k), 30)) for k in range(20)} | {50: "nothing of the kind"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    verdicts = lambda: {r.id: (r.contaminated, r.item_id, r.lcs_ratio) for r in D.verdicts(D.candidates(docs(spark, texts), bench, Workspace(spark, "t"))).collect() if r.contaminated}
    whole = verdicts()
    assert {k: v[1] for k, v in whole.items()} == {k: k % 9 for k in range(20)}
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(D, "SCAN_BLOCKS", 2)
    assert verdicts() == whole


def test_a_long_item_keeps_its_answer(spark):
    """The answer of an item of several passages is its last sentence, wherever it stands within the item's length."""
    body, answer = words("long", 100), words("the answer", 6)
    item = " ".join(body) + ". " + " ".join(answer) + "."
    passages = D.item_passages(1, item)
    assert len(passages) > 1 and all(np.array_equal(a, D.text_words(" ".join(answer))) and n == 106 for _, _, a, n in passages)
    changed = [w if k % 5 < 3 else f"new{k}" for k, w in enumerate(body)]
    texts = {1: " ".join(changed + answer), 2: " ".join(changed)}
    found = {r.id: r.contaminated for r in D.verdicts(D.candidates(docs(spark, texts), spark.createDataFrame([(1, item)], "item_id long, text string"), Workspace(spark, "t"))).collect()}
    assert found == {1: True, 2: False}
