"""Language identification by interpolated Kneser-Ney character models.

Characters are lower-cased letters and marks; all else is one class, of which runs count once. A character takes
16 bits: code points of the basic plane stand for themselves, letters beyond it are hashed into the places that
are never letters. An n-gram of ORDER characters is a 64-bit number, so its prefixes and suffixes are shifts.

Counts of all training texts are gathered in the cluster, in SHARDS shards a language by the last character but
one, which all n-grams and contexts that one character's probability needs have in common. Each shard makes its
own part of the model, sorted arrays of n-grams with their log probabilities. The model grows with the
corpus and no order of it is ever left out: parts of together at most MAX_MODEL_BYTES are broadcast, and where
there are more, documents take one pass for each such load, which adds to their log likelihoods. What the driver
gathers is the loads one after another, and at most 65,536 characters a language.

A text is given the language of the lowest cross-entropy per character. Its score is the softmax of the
total log likelihoods of the whole text at a temperature; the temperature, and for each language the
cross-entropy above which a text is rejected (mean plus four deviations), are learned from labelled texts given to
calibrate, which should not be those of fit.

Defined cases: a null text or one without a letter is `und` with score 0. Without training texts all
are `und`. Ties go to the language that sorts first. Null labels don't train. Repeated rows are counted and scored
as often as they stand; null ids are rows like others; an empty table gives no rows. Very long texts are read whole.
Other columns play no part.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as X
from plumbline.llm import textscan as T
from plumbline.llm.workspace import Workspace, local_rows

ORDER, BITS = 4, 16
ALPHABET = 1 << BITS
MAX_MODEL_BYTES = 200 << 20
SHARDS = 64
#: n-grams that a task holds before it sends their counts, and new ones before it adds them up.
HELD, FRESH = 4_000_000, 1_000_000
#: Characters of a slice: n-grams take about 60 bytes each.
SLICE = 512 << 10
TEMPERATURES = tuple(2.0**k for k in range(-1, 11))
U = np.uint64
LEVELS = tuple(f"{kind}{n}" for n in range(2, ORDER + 1) for kind in ("k", "p", "s", "r"))


def mask(n: int) -> np.uint64:
    return U((1 << (BITS * n)) - 1)


_CLASS: list[np.ndarray] = []


def _letter(point: int) -> bool:
    return chr(point).isalpha() or unicodedata.category(chr(point))[0] == "M"


def _beyond(point: int) -> int:
    """A letter beyond the basic plane, among surrogates and private places."""
    return 0xD800 + (point * 2654435761 >> 7) % (0xF900 - 0xD800) if _letter(point) else 0


def _class_table() -> np.ndarray:
    """Class of each code point of the basic plane: 0 for all that isn't a letter."""
    table = np.zeros(ALPHABET, dtype=np.uint16)
    for point in range(ALPHABET):
        if not 0xD800 <= point < 0xF900 and _letter(point):
            low = ord(chr(point).lower()[0])
            table[point] = low if low < ALPHABET else point
    return table


def classes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each character, with runs of non-letters as one 0, and the offsets of documents in
    them; each document starts and ends with 0."""
    if not _CLASS:
        _CLASS.append(_class_table())
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    lead = (data & 0xC0) != 0x80
    chars = np.append(0, np.cumsum(lead))[offs]
    high = points >= ALPHABET
    kind = _CLASS[0][np.where(high, 0, points)]
    if high.any():
        some, inverse = np.unique(points[high], return_inverse=True)
        kind[high] = np.array([_beyond(int(p)) for p in some], dtype=np.uint16)[inverse]
    n = len(chars) - 1
    out = np.zeros(len(kind) + 2 * n, dtype=np.uint16)
    owner = np.repeat(np.arange(n), np.diff(chars))
    out[np.arange(len(kind)) + 2 * owner + 1] = kind
    heads = chars + 2 * np.arange(n + 1)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    keep[heads[:-1]] = True
    at = np.append(0, np.cumsum(keep))[heads]
    return out[keep], at


def grams(kind: np.ndarray, at: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character after a document's first, cut to the document (missing
    characters count as class 0), and its document."""
    n = len(kind)
    key = kind.astype(U)
    start = at[:-1][np.diff(at) > 0]
    for back in range(1, order):
        prior = np.zeros(n, dtype=U)
        prior[back:] = kind[:-back]
        for k in range(back):  # do not look into the document before
            prior[np.minimum(start + k, n - 1)[start + k < n]] = 0
        key |= prior << U(BITS * back)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inner = np.ones(n, dtype=bool)
    inner[start] = False
    return key[inner], owner[inner]


def shard_of(key: np.ndarray) -> np.ndarray:
    """Shard of n-grams, by their last character but one."""
    return (T.mix((key >> U(BITS)) & U(ALPHABET - 1)) % U(SHARDS)).astype(np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([k for k, _ in parts])
    c = np.concatenate([c for _, c in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[head], np.add.reduceat(c, head) if len(k) else c


COUNTS = "lang string, shard int, n long, k binary, c binary"
_COUNTS = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("k", pa.binary()), ("c", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to packed counts of n-grams by language and shard."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    fresh: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        rows = []
        for lang, parts in held.items():
            k, c = summed(parts)
            shard = shard_of(k)
            order = np.argsort(shard, kind="stable")
            k, c, shard = k[order], c[order], shard[order]
            cut = np.searchsorted(shard, np.arange(SHARDS + 1))
            for r in np.flatnonzero(np.diff(cut)):
                some = slice(cut[r], cut[r + 1])
                rows.append((lang, int(r), int(cut[r + 1] - cut[r]), X.planes(np.diff(k[some], prepend=U(0))), X.planes(c[some].astype(U))))
        held.clear(), fresh.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) if rows else [[]] * 5, _COUNTS.types)], schema=_COUNTS)

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for i, j, data, offs in T.slices(batch.column("text"), SLICE):
            key, owner = grams(*classes(data, offs))
            names = langs[i:j]
            for lang in set(names.tolist()):
                k, c = np.unique(key[(names == lang)[owner]], return_counts=True)
                held.setdefault(lang, []).append((k, c))
                fresh[lang] = fresh.get(lang, 0) + len(k)
                if fresh[lang] > FRESH:
                    held[lang], fresh[lang] = [summed(held[lang])], 0
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
                yield flush()
    yield flush()
    T.tidy()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(X.unplanes(row["k"], row["n"]), dtype=U), X.unplanes(row["c"], row["n"]).astype(np.int64)


def _add(table: pa.Table) -> pa.Table:
    """The sum of all packed counts of one language and shard."""
    rows = table.to_pylist()
    k, c = summed([_unpacked(r) for r in rows])
    T.tidy()
    return pa.Table.from_pylist([{"lang": rows[0]["lang"], "shard": rows[0]["shard"], "n": len(k), "k": X.planes(np.diff(k, prepend=U(0))), "c": X.planes(c.astype(U))}], schema=_COUNTS)


def orders(k: np.ndarray, c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """n-grams and counts of each order from ORDER down to 1; below the highest, continuation counts."""
    out = [(k, c)]
    for n in range(ORDER - 1, 0, -1):
        k, c = np.unique(out[-1][0] & mask(n), return_counts=True)
        out.append((k, c))
    return out


STATS = "lang string, once array<bigint>, twice array<bigint>, n long, k binary, c binary"
_STATS = pa.schema([("lang", pa.string()), ("once", pa.list_(pa.int64())), ("twice", pa.list_(pa.int64())), ("n", pa.int64()), ("k", pa.binary()), ("c", pa.binary())])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard: how many n-grams of orders 2 and more stand once and twice, and its part of the
    continuation counts of single characters."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            levels = orders(*_unpacked(row))
            upper = [c for _, c in levels[:-1][::-1]]
            k, c = levels[-1]
            rows.append({"lang": row["lang"], "once": [int((x == 1).sum()) for x in upper], "twice": [int((x == 2).sum()) for x in upper], "n": len(k), "k": X.planes(k), "c": X.planes(c.astype(U))})
        yield pa.RecordBatch.from_pylist(rows, schema=_STATS)


def _sum_stats(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    k, c = summed([(X.unplanes(r["k"], r["n"]), X.unplanes(r["c"], r["n"]).astype(np.int64)) for r in rows])
    one = {"lang": rows[0]["lang"], "n": len(k), "k": X.planes(k), "c": X.planes(c.astype(U))}
    return pa.Table.from_pylist([one | {x: np.sum([r[x] for r in rows], axis=0).tolist() for x in ("once", "twice")}], schema=_STATS)


def discount(once: float, twice: float) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


class Base:
    """What all parts of a language's model share: discounts of the orders from 2 on, and the order 1."""

    def __init__(self, once: list[int], twice: list[int], k: np.ndarray, c: np.ndarray):
        self.discounts = [discount(a, b) for a, b in zip(once, twice)]
        d = discount(float((c == 1).sum()), float((c == 2).sum()))
        self.keys, self.rest = k, float(np.log(d * len(k) / c.sum()))
        self.p = np.maximum(c - d, 0) / c.sum() + d * len(k) / c.sum() / ALPHABET
        self.logp = np.log(self.p)


PART = "lang string, shard int, size long, " + ", ".join(f"{c} binary" for c in LEVELS)
_PART = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("size", pa.int64()), *((c, pa.binary()) for c in LEVELS)])


def _parts(bases: dict[str, Base]):
    """Counts of a shard to its part of the model: for each order from 2 on sorted n-grams (k), their
    interpolated log probabilities (p), known contexts (s) and what each leaves for shorter n-grams (r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                base, out = bases[row["lang"]], {"lang": row["lang"], "shard": row["shard"]}
                below_k, below_p = base.keys, base.p
                for n, (k, c) in zip(range(2, ORDER + 1), orders(*_unpacked(row))[:-1][::-1]):
                    seen, inverse = np.unique(k >> U(BITS), return_inverse=True)
                    total = np.bincount(inverse, weights=c)
                    d = base.discounts[n - 2]
                    rest = d * np.bincount(inverse) / total
                    p = np.maximum(c - d, 0) / total[inverse] + rest[inverse] * below_p[np.searchsorted(below_k, k & mask(n - 1))]
                    out |= {f"k{n}": k.tobytes(), f"p{n}": np.log(p).astype(np.float32).tobytes(), f"s{n}": seen.tobytes(), f"r{n}": np.log(rest).astype(np.float32).tobytes()}
                    below_k, below_p = k, p
                out["size"] = sum(len(out[c]) for c in LEVELS)
                yield pa.RecordBatch.from_pylist([out], schema=_PART)
        T.tidy()

    return run


class Model:
    """The parts of all languages' models, in the shared folder, and what they have in common."""

    def __init__(self, langs: list[str], bases: dict[str, Base], parts: DataFrame, loads: list[list[tuple[str, int]]], work: Workspace):
        self.langs, self.bases, self.parts, self.loads, self.work = langs, bases, parts, loads, work
        self.limits: np.ndarray | None = None
        self.temperature = 8.0

    def load(self, which: int) -> Load:
        """Some parts, brought together by language: at most MAX_MODEL_BYTES, or one part."""
        units = self.loads[which]
        wanted = local_rows(self.work.spark, units, "lang string, shard int")
        rows = self.parts.join(F.broadcast(wanted), ["lang", "shard"]).collect()
        return Load(self.langs, self.bases, [r.asDict() for r in rows])


class Load:
    def __init__(self, langs: list[str], bases: dict[str, Base], rows: list[dict]):
        self.langs, self.bases, self.levels, self.shards = langs, bases, {}, {}
        for lang in langs:
            mine = [r for r in rows if r["lang"] == lang]
            if not mine:
                continue
            self.shards[lang] = np.isin(np.arange(SHARDS), [r["shard"] for r in mine])
            levels = []
            for n in range(2, ORDER + 1):
                level = []
                for a, b in (("k", "p"), ("s", "r")):
                    key = np.concatenate([np.frombuffer(r[f"{a}{n}"], U) for r in mine])
                    value = np.concatenate([np.frombuffer(r[f"{b}{n}"], np.float32) for r in mine])
                    by = np.argsort(key)
                    level += [key[by], value[by]]
                levels.append(level)
            self.levels[lang] = levels

    def log_p(self, lang: str, key: np.ndarray) -> np.ndarray:
        """Log probability of full n-grams: the longest suffix that is known, times what each longer
        known context leaves."""
        out, todo = np.zeros(len(key)), np.arange(len(key))
        for n in range(ORDER, 1, -1):
            k, logp, seen, rest = self.levels[lang][n - 2]
            part = key[todo] & mask(n)
            at = np.minimum(np.searchsorted(k, part), len(k) - 1)
            hit = k[at] == part
            out[todo[hit]] += logp[at[hit]]
            todo, part = todo[~hit], part[~hit]
            if not len(todo):
                return out
            context = part >> U(BITS)
            at = np.minimum(np.searchsorted(seen, context), len(seen) - 1)
            known = seen[at] == context
            out[todo[known]] += rest[at[known]]
        base, part = self.bases[lang], key[todo] & mask(1)
        at = np.minimum(np.searchsorted(base.keys, part), len(base.keys) - 1)
        out[todo] += np.where(base.keys[at] == part, base.logp[at], base.rest - np.log(ALPHABET))
        return out

    def add(self, total: np.ndarray, key: np.ndarray, owner: np.ndarray, strange: dict[str, np.ndarray]) -> None:
        """Adds to total (documents by languages) the log probabilities of the n-grams that this load has the
        shards of, and of those in strange. Each distinct n-gram of a slice is looked up once."""
        distinct, slot = np.unique(key, return_inverse=True)
        shard = shard_of(distinct)
        for i, lang in enumerate(self.langs):
            mine = strange[lang][shard] | (self.shards[lang][shard] if lang in self.levels else False)
            logp = np.zeros(len(distinct))
            if lang in self.levels:
                logp[mine] = self.log_p(lang, distinct[mine])
            elif mine.any():
                base, part = self.bases[lang], distinct[mine] & mask(1)
                at = np.minimum(np.searchsorted(base.keys, part), len(base.keys) - 1)
                logp[mine] = np.where(base.keys[at] == part, base.logp[at], base.rest - np.log(ALPHABET))
            total[:, i] += np.bincount(owner, weights=logp[slot], minlength=len(total))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Counts every text that has a label; None without any."""
    work = Workspace(docs.sparkSession, "language")
    train = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = work.save(lambda: train.mapInArrow(_count, COUNTS).groupBy("lang", "shard").applyInArrow(_add, COUNTS), "counts")
    stats = counts.mapInArrow(_stats, STATS).groupBy("lang").applyInArrow(_sum_stats, STATS).collect()  # characters of a language
    bases = {r["lang"]: Base(r["once"], r["twice"], X.unplanes(bytes(r["k"]), r["n"]), X.unplanes(bytes(r["c"]), r["n"]).astype(np.int64)) for r in stats}
    if not bases:
        return None
    parts = work.save(lambda: counts.mapInArrow(_parts(bases), PART), "parts")
    loads, room = [], 0
    for r in parts.select("lang", "shard", "size").orderBy("lang", "shard").collect():  # SHARDS rows a language
        if not loads or room + r["size"] > MAX_MODEL_BYTES:
            loads.append([])
            room = 0
        loads[-1].append((r["lang"], r["shard"]))
        room += r["size"]
    return Model(sorted(bases), bases, parts, loads, work)


SUMS = "n long, letters boolean, total binary"


def _sums(load, strange: dict[str, np.ndarray], first: bool):
    """Adds a load's log likelihoods to each document's total. strange: shards of each language that count with
    this load though its training texts have nothing in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load.value
        width = len(model.langs)
        for batch in batches:
            sizes, letters, totals = [], [], []
            before = None if first else batch.column("total").to_pylist()
            for i, j, data, offs in T.slices(batch.column("text"), SLICE):
                kind, at = classes(data, offs)
                key, owner = grams(kind, at)
                some = np.append(0, np.cumsum(kind != 0))
                total = np.zeros((j - i, width)) if first else np.array([np.frombuffer(x) for x in before[i:j]]).reshape(j - i, width)
                total = total.copy()
                model.add(total, key, owner, strange)
                sizes += np.bincount(owner, minlength=j - i).tolist()
                letters += (some[at[1:]] > some[at[:-1]]).tolist()
                totals += [t.tobytes() for t in total]
            kept = [batch.column(c) for c in batch.schema.names if c not in ("n", "letters", "total")]
            names = [c for c in batch.schema.names if c not in ("n", "letters", "total")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(letters, pa.bool_()), pa.array(totals, pa.binary())], [*names, "n", "letters", "total"])
        T.tidy()

    return run


def likelihoods(source: DataFrame, model: Model) -> DataFrame:
    """source (row, text) with n, the characters read, letters, whether there are any, and the total log
    likelihoods by language. One pass for each load of the model."""
    kind = source.schema["row"].dataType.simpleString()
    every, unseen = np.arange(SHARDS), {}
    for lang in model.langs:
        unseen[lang] = ~np.isin(every, [s for units in model.loads for name, s in units if name == lang])
    nothing = dict.fromkeys(model.langs, np.zeros(SHARDS, dtype=bool))
    work = Workspace(source.sparkSession, "likelihoods")
    for which in range(len(model.loads)):
        load = source.sparkSession.sparkContext.broadcast(model.load(which))
        source = source.mapInArrow(_sums(load, nothing if which else unseen, which == 0), f"row {kind}, text string, {SUMS}")
        if which + 1 < len(model.loads):
            source = work.save(source, f"pass{which}")
    return source.drop("text")


def _entropies(langs: list[str]):
    """Rows (row.lang, n, letters, total) to sums for calibration: of cross-entropies by language, and of the
    surprise about the true language at each temperature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs))
        surprise = np.zeros(len(TEMPERATURES))
        for batch in batches:
            size = batch.column("n").to_numpy(zero_copy_only=False)
            for lang, m, some, raw in zip(batch.column("row").field("lang").to_pylist(), size, batch.column("letters").to_pylist(), batch.column("total").to_pylist()):
                if not some or lang not in langs:
                    continue
                i, total = langs.index(lang), np.frombuffer(raw)
                entropy = -total[i] / m
                n[i], s[i], q[i] = n[i] + 1, s[i] + entropy, q[i] + entropy**2
                z = total - total.max()
                for t, temperature in enumerate(TEMPERATURES):
                    surprise[t] -= z[i] / temperature - np.log(np.exp(z / temperature).sum())
        yield pa.RecordBatch.from_pylist([{"n": n.tolist(), "s": s.tolist(), "q": q.tolist(), "t": surprise.tolist()}], schema=pa.schema([(c, pa.list_(pa.float64())) for c in "nsqt"]))

    return run


def calibrate(model: Model, docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Sets the temperature, and the rejection limit of each language, from labelled texts."""
    held = docs.select(F.struct(F.col(lang_col).cast("string").alias("lang")).alias("row"), F.col(text_col).cast("string").alias("text")).where(F.col("row.lang").isin(model.langs) & F.col("text").isNotNull())
    sums = likelihoods(held, model).mapInArrow(_entropies(model.langs), "n array<double>, s array<double>, q array<double>, t array<double>")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in "nsqt"]))
    rows = sums.select(each.alias("e")).select("e.c", F.posexplode("e.v").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"))
    got = {(r["c"], r["i"]): r["x"] for r in rows.collect()}
    limits = []
    for i in range(len(model.langs)):
        n, s, q = (got.get((c, i), 0.0) for c in "nsq")
        limits.append(s / n + 4 * max(0.0, q / n - (s / n) ** 2) ** 0.5 if n > 1 else np.inf)
    model.limits = np.array(limits)
    if any(got.get(("n", i)) for i in range(len(model.langs))):
        model.temperature = min(TEMPERATURES, key=lambda t: got[("t", TEMPERATURES.index(t))])
    return model


def _decide(langs: list[str], limits: np.ndarray | None, temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = len(batch)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            some = np.array(batch.column("letters").to_pylist(), dtype=bool)
            total = np.frombuffer(b"".join(batch.column("total").to_pylist())).reshape(rows, len(langs))
            best = total.argmax(axis=1) if rows else np.zeros(0, np.int64)
            top = total[np.arange(rows), best]
            score = 1 / np.exp((total - top[:, None]) / temperature).sum(axis=1)
            low = -top / np.maximum(n, 1)
            out = ~some | (low > limits[best] if limits is not None else False)
            names = [langs[b] if s else "und" for b, s in zip(best, some)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(low, mask=~some), pa.array(out, pa.bool_())], ["row", "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """For each row: row (columns named in keep, or all), lang_pred, score, cross_entropy and rejected,
    which says that the text is unlike what the language's training texts are."""
    names = docs.columns if keep is None else keep
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if model is None:
        return source.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    kind = source.schema["row"].dataType.simpleString()
    return likelihoods(source, model).mapInArrow(_decide(model.langs, model.limits, model.temperature), f"row {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
