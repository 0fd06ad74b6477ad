"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed into a table of learned vectors; a document is the mean of its
vectors, a softmax layer gives the two classes, and both are trained by stochastic gradient descent in
numpy. As the softmax sees a mean, the trained model is one number for each hashed feature (the
difference of its two logits) plus a bias, which is what scoring broadcasts: 4 bytes times the table size.

Training reads at most MAX_LABELLED labelled texts, a bounded sample of labelled ids chosen by a hash and of their
different texts in order of id, whole; scoring reads every whole text.

Defined cases: null and empty texts have no features and get the score of the bias alone. Null labels, null ids and
ids with both labels don't train; with no label, or labels of one class, every score is that class's share (0.5 without
labels). Repeated rows are scored alike and train once; an empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textscan as T
from plumbline.llm.workspace import local_rows

MAX_LABELLED = 4000
#: Bytes of text at a time: features take about 70 bytes for each.
SLICE = 256 << 10
BITS, DIM, GRAMS = 17, 16, (2, 3, 4)
U = np.uint64


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of each word and each character n-gram of bytes inside a word;
    n-grams take the word's edges in, and letters count as they are (case tells quality)."""
    start, end, doc = T.word_bounds(data, offs)
    shift = U(64 - bits)
    found_doc, found = [doc], [T.span_hashes(data, start, end) >> shift]
    n = len(data)
    byte = T.mix(np.arange(256, dtype=U) + U(77))
    owner = np.searchsorted(offs, np.arange(n), side="right") - 1
    value = byte[np.where(T.SPACE[data], 0x20, data)]
    for k in GRAMS:
        if n < k:
            continue
        h = np.zeros(n - k + 1, dtype=U)
        for i in range(k):
            h = h * U(0x9E3779B97F4A7C15) + value[i : n - k + 1 + i]
        good = owner[: n - k + 1] == owner[k - 1 :]
        if k > 2:  # an n-gram may start or end with white space, not have it inside
            inner = np.zeros(n - k + 1, dtype=bool)
            for i in range(1, k - 1):
                inner |= T.SPACE[data[i : n - k + 1 + i]]
            good &= ~inner
        found_doc.append(owner[: n - k + 1][good])
        found.append(T.mix(h[good] + U(k)) >> shift)
    return np.concatenate(found_doc), np.concatenate(found).astype(np.int32)


def train(texts: list[str], labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = 12, rate: float = 0.6, seed: int = 7) -> tuple[np.ndarray, float]:
    """The logit difference of each feature, and the bias. Documents enter as counts of features,
    so an epoch costs the distinct features of a document once."""
    rng = np.random.default_rng(seed)
    share = float(np.mean(labels)) if len(labels) else 0.5
    if len(labels) == 0 or share in (0.0, 1.0):
        edge = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(1 << bits, np.float32), float(np.log(edge / (1 - edge)))
    rows = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        _, f = features(data, np.array([0, len(data)], dtype=np.int64), bits)
        rows.append(tuple(x.astype(np.int32) for x in np.unique(f, return_counts=True)))
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer = np.zeros((2, dim), np.float32)
    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    bias = np.array([np.log(1 - share), np.log(share)], np.float32)
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f, c = rows[k]
            lr = rate * (1 - steps / total)
            steps += 1
            if not len(f):
                continue
            w = (c / c.sum()).astype(np.float32)
            hidden = w @ table[f]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            back = layer.T @ p
            layer -= lr * np.outer(p, hidden)
            bias -= 0.1 * lr * p
            table[f] -= (lr * len(f) ** 0.5) * w[:, None] * back
    return (table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Trains on at most `limit` documents that labels (id, label) mark; docs may be narrowed by the
    caller to those it may learn from."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id is not null and __y in (0, 1)")
    marked = marked.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__high")).where("__y = __high").drop("__high")
    chosen = marked.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    spark = docs.sparkSession
    taken = local_rows(spark, [(r["__id"], int(r["__y"])) for r in chosen.collect()], "__id long, __y int")
    joined = docs.join(F.broadcast(taken), F.col(id_col).cast("long") == F.col("__id")).select("__id", F.col(text_col).cast("string").alias("t"), "__y")
    got = [(r["__id"], r["t"] or "", r["__y"]) for r in joined.distinct().orderBy("__id", "t").limit(limit).collect()]
    return train([t for _, t, _ in got], np.array([y for _, _, y in got], dtype=np.int64))


def _score(weights: np.ndarray, bias: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, data, offs in T.slices(batch.column("text"), SLICE):
                d, f = features(data, offs, bits)
                total = np.bincount(d, weights=weights[f], minlength=j - i)
                count = np.bincount(d, minlength=j - i)
                z = total / np.maximum(count, 1) + bias
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64())], ["row", "score"])
        T.tidy()

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """For each row: row (the columns named in keep, or all) and score, the probability of label 1."""
    names = docs.columns if keep is None else keep
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(_score(*model, BITS), f"row {kind}, score double")
