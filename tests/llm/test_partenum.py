import os
import random
import re

import numpy as np
import pytest

from plumbline.llm import partenum
from plumbline.llm.workspace import Workspace
from tests.llm.cases import docs, edge, empty, words


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(texts, width, percent):
    sets, root = {k: shingles(t, width) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(seed):
    rng, texts = random.Random(seed), {}
    for family in range(7):
        base = words((seed, family), rng.choice([6, 12, 25, 60, 150, 400]))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            texts[rng.randrange(10**6)] = " ".join(copy)
    chain = words((seed, "chain"), 200)
    for step in range(6):  # each links with the next, not with all
        chain = chain[6:] + words((seed, step), 6)
        texts[rng.randrange(10**6)] = " ".join(chain).upper()
    return texts


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80)])
def test_against_brute_force(spark, monkeypatch, seed, width, percent):
    monkeypatch.setattr(partenum, "BLOCK_MEMBERS", 3)
    texts = near_copies(seed) | {-5: None, -4: "", -3: "one two", -2: "One TWO", -1: "  "}
    rows = partenum.jaccard_components(docs(spark, texts).repartition(5), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, width, percent)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        plan = partenum.Plan(percent)
        for n in [2, 5, 9, 10, 11, 19, 20, 33, 100, 257, 1000]:
            for _ in range(20):
                s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                lose = int(n * (100 - percent) / 100 * rng.random())
                t = np.unique(np.concatenate((s[lose:], rng.integers(0, 2**63, rng.integers(0, 1 + max(0, n // 20))).astype(np.uint64))))
                if partenum.alike(s, t, percent):
                    a, b = (partenum.signatures(x, plan) for x in (s, t))
                    assert a[0] == b[0] or np.intersect1d(a[1], b[1]).size, (percent, n, lose)


def test_edge_rows_and_empty_table(spark):
    rows = partenum.jaccard_components(edge(spark)).collect()
    assert len(rows) == 11
    assert {r.doc_id: r.component_id for r in rows}[6] == 5
    assert partenum.jaccard_components(empty(spark)).count() == 0
    kept = partenum.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [None, 1, 2, 3, 4, 5, 7, 8, 9]))


def test_no_cross_join(spark):
    texts = {k: " ".join(words(0, 50) + [str(k)]) for k in range(30)}
    rows = partenum.jaccard_components(docs(spark, texts)).collect()
    assert {r.component_id for r in rows} == {0}


def test_rows_that_share_an_id_go_by_their_texts(spark):
    one, two, three, four = (" ".join(words(("shared", k), 40)) for k in range(4))
    rows = [(None, one), (None, two), (None, two), (None, None), (None, ""), (5, two + " more"), (6, three), (7, three), (7, four), (8, four)]
    kept = partenum.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [(None, one), (None, two), (None, None), (None, ""), (6, three), (7, four)]))


@pytest.mark.parametrize("members", [4, 512])
def test_families_about_the_threshold(spark, monkeypatch, members):
    """Copies whose likeness lies on both sides of the threshold, in one block and in many."""
    monkeypatch.setattr(partenum, "BLOCK_MEMBERS", members)
    rng, texts, base = random.Random(17), {}, words("threshold", 300)
    for k in range(60):
        copy = list(base)
        for place in rng.sample(range(300), rng.choice([4, 5, 6, 7])):
            copy[place] = f"other{k}x{place}"
        texts[k] = " ".join(copy)
    rows = partenum.jaccard_components(docs(spark, texts).repartition(4), 5, 80).collect()
    want = brute(texts, 5, 80)
    assert len({c for _, c in want.values()}) > 3
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_sketches_never_exceed_the_distance():
    rng = np.random.default_rng(5)
    for n in (3, 100, 129, 5000, 20_000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        t = np.unique(np.concatenate((s[n // 5 :], rng.integers(0, 2**63, n // 7).astype(np.uint64))))
        x, y = partenum.sketch(s), partenum.sketch(t)
        bits = partenum.folded([x, y], min(len(x), len(y)))
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(s, t))


def test_a_family_gives_a_pair_for_each_set_and_its_tables_go(spark, monkeypatch):
    """Near copies that share many signatures in ever other groups: pairs to check follow the sets, not their square."""
    rng, texts, base, pairs, roots, save = random.Random(23), {}, words("family", 300), [], set(), Workspace.save
    for k in range(80):
        copy = list(base)
        for place in rng.sample(range(300), 3):
            copy[place] = f"other{k}x{place}"
        texts[k] = " ".join(copy)

    def spy(self, df, table, *args, **named):
        out = save(self, df, table, *args, **named)
        roots.add(self.root.removeprefix("file://"))
        if table.endswith("-checked"):
            pairs.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "save", spy)
    rows = partenum.jaccard_components(docs(spark, texts).repartition(4), 5, 80).collect()
    assert {r.component_id for r in rows} == {0}
    assert sum(pairs) < len(texts)
    assert [os.listdir(r) for r in roots] == [["components"]]


@pytest.mark.parametrize("at_most", [0, 500_000])
def test_sketches_are_made_without_an_exchange_of_texts(spark, monkeypatch, at_most):
    """Whether ids are few enough to be broadcast or not, and whatever Spark itself would broadcast."""
    rng, texts, plans, save = random.Random(29), {}, [], Workspace.save
    for k, base in enumerate([words("open", 300)] * 40):
        copy = list(base)
        for place in rng.sample(range(300), rng.choice([4, 5, 6, 7])):
            copy[place] = f"other{k}x{place}"
        texts[k] = " ".join(copy)

    def spy(self, df, table, *args, **named):
        if table == "sketches":
            df = df()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            df = (lambda made: lambda: made)(df)
        return save(self, df, table, *args, **named)

    monkeypatch.setattr(partenum, "BROADCAST_IDS", at_most)
    monkeypatch.setattr(Workspace, "save", spy)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = partenum.jaccard_components(docs(spark, texts).repartition(4), 5, 80).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, 5, 80)
    (plan,) = plans
    lines = plan.splitlines()
    joins = [k for k, x in enumerate(lines) if "Join" in x]
    assert joins, plan
    # In the tree of the plan the join's first child holds the documents: sketches are made above the join when it is a
    # broadcast, and below its exchange when it isn't.
    maps = [k for k, x in enumerate(lines) if "MapInArrow" in x]
    exchanges = [k for k, x in enumerate(lines) if "Exchange hashpartitioning(id" in x and "ENSURE_REQUIREMENTS" in x]
    if at_most:
        assert "BroadcastHashJoin" in lines[joins[0]] and maps[0] < joins[0], plan
    else:
        assert joins[0] < exchanges[0] < maps[0], plan
