import collections
import hashlib
import random
import re
import struct
import zlib

import pytest
import xxhash

from pyspark.sql import functions as F

from plumbline.llm import sharding, syncmers
from tests.llm.cases import docs, edge, empty, words


def plain_best_fit(sizes, capacity):
    free, out = [], []
    for s in sizes:
        fits = [(f, b) for b, f in enumerate(free) if f >= s]
        if fits:
            f, b = min(fits)
            free[b] -= s
        else:
            b = len(free)
            free.append(max(capacity, s) - s)
        out.append(b)
    return out


def test_tree_packs_like_a_search():
    rng = random.Random(6)
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))), reverse=True)
        classes = sorted(collections.Counter(sizes).items(), reverse=True)
        runs = sharding.best_fit_decreasing(classes, 64)
        assert [b for r in runs for b, n in r for _ in range(n)] == plain_best_fit(sizes, 64)


def test_few_bins_at_the_least_capacity():
    classes = sorted(collections.Counter(random.Random(1).randrange(1, 1000) for _ in range(500)).items(), reverse=True)
    load = collections.Counter()
    for (size, _), runs in zip(classes, sharding.pack_into(classes, 8)):
        for b, n in runs:
            load[b] += size * n
    assert len(load) == 8 and max(load.values()) <= 1.01 * sum(load.values()) / 8  # the largest bin is what is minimised
    assert sharding.pack_into([], 8) == [] and sharding.pack_into([(5, 1)], 8) == [[(0, 1)]]


def test_groups_lie_where_the_packer_puts_them(spark, monkeypatch):
    """Loads of the shards against the plain packer at its least capacity, with many groups of one size."""
    monkeypatch.setattr(sharding, "HOT", 20)
    texts = [f"{k:03d}" + "x" * (k % 5 * 20) for k in range(300)] + ["same text"] * 90 + [None] * 5
    rows = sharding.assign(docs(spark, texts), 4).collect()
    sizes = sorted((sum(len((x or "").encode()) + 1 for x in texts if x == t) for t in set(texts)), reverse=True)
    capacity = -(-sum(sizes) // 4)
    while len(set(plain_best_fit(sizes, capacity))) > 4:
        capacity += 1
    want = collections.Counter()
    for size, b in zip(sizes, plain_best_fit(sizes, capacity)):
        want[b] += size
    got = collections.Counter()
    for r in rows:
        got[r.shard] += r.size
    assert got == want


def test_groups_stay_whole_and_slots_have_no_gaps(spark):
    texts = {k: " ".join(words(k % 90, 3 + k % 90)) for k in range(400)} | {1000: None, 1001: None, 1002: ""}
    rows = sharding.assign(docs(spark, texts), 8).collect()
    where, slots, load = {}, collections.defaultdict(list), collections.Counter()
    for r in rows:
        text = texts[r.doc_id]
        assert where.setdefault(text, r.shard) == r.shard
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) < 1.1 * sum(load.values()) / 8


def test_sharding_edge_rows(spark):
    rows = sharding.assign(edge(spark), 3).collect()
    assert len(rows) == 11 and {r.shard for r in rows} <= {0, 1, 2}
    assert sharding.assign(empty(spark), 3).count() == 0


def edited(texts):
    keys = sorted(texts)
    out = {}
    for i, k in enumerate(keys):
        x, y = texts[k] or "", texts[keys[i - 1]] or ""
        n = len(x)
        out[k] = x[: n - n // 3] + y[: n // 3]
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_print(text):
    """The fingerprint in plain Python."""
    single = "\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0e7f"
    tokens = [signed(xxhash.xxh64(t.encode(), seed=42).intdigest()) for t in re.findall(rf"[{single}]|[^{single} \t-\r]{{1,64}}", text or "")]
    if not tokens:
        return []
    t, out, last = [syncmers.EDGE] * 3 + tokens + [syncmers.EDGE] * 3, [], None
    for i in range(len(t) - 3):
        if min(t[i], t[i + 3]) <= min(t[i + 1], t[i + 2]):
            h = 42
            for x in t[i : i + 4]:
                h = xxhash.xxh64(struct.pack("<q", x), seed=h).intdigest()
            out.append((i - last if last is not None else 0, h))
            last = i
    return out


def brute_text(found):
    return "".join(f"{gap:X}{h:016X}"[:10] for gap, h in found)


def brute_likeness(a, b):
    x, y = ({(p[1], *q) for p, q in zip([(0, 0), *t], t)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 7)
    texts = {k * 3: " ".join(words(("s", k), 1 + 7 * k)) for k in range(40)} | {-9: "😀 ä short", -8: None, 500: "x", 502: "東京 とても長い文です。", 503: "y" * 300, 504: " \t"}
    texts[501] = texts[30]
    rows = {r.doc_id: r for r in syncmers.edited_fingerprints(docs(spark, texts)).collect()}
    want = edited(texts)
    assert {k: r.edited_sha256 for k, r in rows.items()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}
    assert rows[501].fingerprint == rows[30].fingerprint
    keys = sorted(texts)
    for i, k in enumerate(keys):
        mine, other, following = brute_print(texts[k]), brute_print(want[k]), brute_print(texts[keys[i - 1]])
        assert rows[k].fingerprint == brute_text(mine) and rows[k].edited_fingerprint == brute_text(other)
        assert rows[k].near_edited == pytest.approx(brute_likeness(mine, other)) and rows[k].near_next == pytest.approx(brute_likeness(mine, following))
    wide = [r for k, r in rows.items() if len(texts[k] or "") > 600]
    assert all(r.near_edited > 0.3 and r.near_next < 0.1 for r in wide)


def test_length_plays_no_part(spark):
    """One more character changes a fingerprint a little at every length, and a moved passage is still found."""
    for n in (195, 199, 200, 201, 5000):
        text = (" ".join(words(("n", n), n)))[:n]
        plain, longer, moved = (r.f for r in docs(spark, [text, text + "x", " ".join(words("before", 9)) + " " + text]).select(syncmers.links(syncmers.anchors(F.col("text"))).alias("f")).collect())
        pair = spark.createDataFrame([(plain, longer, moved)], "a array<int>, b array<int>, c array<int>").select(syncmers.likeness(F.col("a"), F.col("b")).alias("one"), syncmers.likeness(F.col("a"), F.col("c")).alias("two")).first()
        assert pair.one > 0.7 and pair.two > 0.5


def test_anchors_do_not_depend_on_context(spark):
    shared = words("anchor", 80)
    a, b = " ".join(words(1, 50) + shared), " ".join(words(2, 90) + shared + words(3, 10))
    rows = [{x["hash"] for x in r.a} for r in docs(spark, [a, b, " ".join(shared)]).select(syncmers.anchors(F.col("text")).alias("a")).collect()]
    inner = rows[2] & rows[0] & rows[1]
    assert len(inner) >= len(rows[2]) - 4
    assert inner


def test_fingerprint_plan_has_no_python(spark):
    plan = syncmers.fingerprints(docs(spark, ["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_syncmer_edge_rows(spark):
    rows = syncmers.edited_fingerprints(edge(spark)).collect()
    assert len(rows) == 11 and {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert syncmers.edited_fingerprints(empty(spark)).count() == 0
    one = syncmers.edited_fingerprints(docs(spark, {1: "abcdef"})).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
