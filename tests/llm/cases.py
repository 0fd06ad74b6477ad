"""Rows that every operator must stand: nulls, blanks, a very long text, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, starts string, key string, score double, shard int, slot int, label string, start long, n long, th string, kept string"


def words(seed, n, size=4000):
    rng = random.Random(repr(seed))
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edge_rows():
    long_text = " ".join(words(1, 30_000, 10**6))
    texts = [(None, "a null id here"), (1, None), (2, ""), (3, "   \n "), (4, long_text), (5, "same text of five words"), (6, "same text of five words"), (7, "twice"), (7, "twice"), (8, "one"), (9, "Ä ö 日本 😀")]
    return [(i, t, "en", "s", None, 1, "r", "x", "k", 0.5, 1, 2, "l", 3, 4, "t", "k") for i, t in texts]


def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] if not isinstance(texts, dict) else list(texts.items()), "doc_id long, text string")
