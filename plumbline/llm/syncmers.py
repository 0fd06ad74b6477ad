"""Document fingerprints from closed syncmers, in column expressions alone.

A text is a sequence of tokens: its words, cut after LONGEST characters, and single characters of scripts that
are written without blanks. Of the k-mers of tokens those stay whose smallest inner s-mer, by hash, lies at
their first or last place. Whether one stays depends on the k-mer alone and not on what surrounds it, so equal
passages keep equal anchors wherever they stand. The sequence is closed by K - 1 edge marks on both sides, so
texts of any length, shorter than a k-mer too, are treated alike.

The fingerprint lists all anchors with their places. Two texts are matched by position: an anchor counts
together with the anchor before it and the distance of both, so what matches are runs of anchors that stand
alike, wherever the run stands in its text. The likeness is the Jaccard similarity of these links, by hashes of 32
bits, which are compared within two texts only.

Defined cases: null is empty; an empty text, or one of blanks, has the empty fingerprint. Two equal
fingerprints have likeness 1, an empty one and another 0. A null id is the smallest id. Rows that share an id
are ordered by the hash of their texts; rows equal in both are one place in the order, and each gets its own
result. Of a single text the next one is itself. An empty table gives no rows. Other columns play no part.
Texts are read whole; an array of hashes of one text's tokens is what is held at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.workspace import Workspace

#: Tokens of a k-mer (its s-mers are single tokens), characters of the longest token, rows of a range of ids.
K, LONGEST, RANGE_ROWS = 4, 64, 200_000
SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
BLANK = r"\x20\x09-\x0D"
TOKEN = rf"[{SINGLE}]|[^{SINGLE}{BLANK}]{{1,{LONGEST}}}"
#: Hash of the marks around a text: never smaller than a token's.
EDGE = (1 << 63) - 1


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, even where body uses it in other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens. Where all tokens are words, these are split, which gives the same as TOKEN."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(f"[{SINGLE}]")

    def tokens(words: Column) -> Column:
        return F.when(plain & ~F.exists(words, lambda w: F.octet_length(w) > LONGEST), words).otherwise(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))

    return F.transform(let(F.array_remove(F.split(text, f"[{BLANK}]+"), ""), tokens), lambda t: F.xxhash64(t))


def anchors(text: Column) -> Column:
    """Array of (place, hash) of the closed syncmers of a text, in order; places count tokens, and the first
    k-mer, of edge marks and the first token, has place 0."""
    edge = F.array(*[F.lit(EDGE)] * (K - 1))

    def of_tokens(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(t) - K)
        kept = F.filter(starts, lambda i: F.least(t[i], t[i + K - 1]) <= F.least(*[t[i + j] for j in range(1, K - 1)]))
        return F.transform(kept, lambda i: F.struct(i.alias("place"), F.xxhash64(*[t[i + j] for j in range(K)]).alias("hash")))

    none = F.expr("cast(array() as array<struct<place:int,hash:bigint>>)")
    return let(token_hashes(F.coalesce(text, F.lit(""))), lambda t: F.when(F.size(t) > 0, let(F.concat(edge, t, edge), of_tokens)).otherwise(none))


def gap(found: Column, i: Column) -> Column:
    """Distance of an anchor to the one before, 0 at the first: closed syncmers follow each other within K places."""
    return F.when(i == 0, 0).otherwise(found[i]["place"] - found[i - 1]["place"])


def printed(found: Column) -> Column:
    """Anchors as text: ten hexadecimal digits for each, one of its distance to the anchor before and the upper nine of
    its hash."""
    digits = lambda x: F.transform(x, lambda a, i: F.concat(F.hex(gap(x, i)), F.substr(F.lpad(F.hex(a["hash"]), 16, "0"), F.lit(1), F.lit(9))))
    return F.array_join(let(found, digits), "")


def fingerprint(text: Column) -> Column:
    return printed(anchors(text))


def links(found: Column) -> Column:
    """The distinct hashes of each anchor with its distance to the anchor before and that anchor."""
    return F.array_distinct(let(found, lambda x: F.transform(x, lambda a, i: F.hash(F.when(i == 0, F.lit(0).cast("long")).otherwise(x[i - 1]["hash"]), gap(x, i), a["hash"]))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the links of two texts; 1 where neither has any."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def next_keys(keys: DataFrame, work: Workspace) -> DataFrame:
    """keys (id, th), distinct, with the key after each in descending order (next_id, next_th); after the last
    comes the first. Ranges of keys are ordered on their own; their edges, one row a range, are joined."""
    ranges = max(1, -(-keys.count() // RANGE_ROWS))
    cut = keys.select("id", "th").repartitionByRange(ranges, F.desc("id"), F.desc("th"))
    cut = work.save(cut.select("id", "th", F.spark_partition_id().alias("range")), "ranges")
    order = W.partitionBy("range").orderBy(F.desc("id"), F.desc("th"))
    ahead = cut.select("id", "th", "range", F.lead(F.struct("id", "th")).over(order).alias("next"))
    firsts = cut.groupBy("range").agg(F.max(F.struct("id", "th")).alias("first"))
    along = W.orderBy("range")
    wrap = firsts.select("range", F.coalesce(F.lead("first").over(along), F.first("first").over(along)).alias("wrap"))  # a row a range
    near = F.coalesce("next", "wrap")
    return ahead.join(wrap, "range").select("id", "th", near["id"].alias("next_id"), near["th"].alias("next_th"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, anchors, fingerprint) of each row: all anchors with their places and 64-bit hashes."""
    found = docs.select(F.col(id_col), anchors(F.col(text_col).cast("string")).alias("anchors"))
    return found.select(id_col, "anchors", printed(F.col("anchors")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row with its own fingerprint, that of its text with the last third exchanged for the start
    of the next row's (descending id), and the likeness to that and to the next row's."""
    least = -(1 << 63)
    work = Workspace(docs.sparkSession, "syncmers")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = work.save(rows.groupBy("id", "th").agg(F.max(F.length("text")).alias("n")), "keys")
    wanted = next_keys(keys, work).join(keys, ["id", "th"])
    wanted = work.save(wanted.select(F.col("id").alias("for_id"), F.col("th").alias("for_th"), F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.floor(F.col("n") / 3).cast("int").alias("third")), "wanted")
    one = rows.join(wanted, ["id", "th"]).select(F.col("for_id").alias("id"), F.col("for_th").alias("th"), "third", "text")
    heads = one.select("id", "th", "third", F.substr("text", F.lit(1), F.col("third")).alias("head"), links(anchors(F.col("text"))).alias("next_links"))
    heads = heads.dropDuplicates(["id", "th"])
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("third")), F.col("head"))
    both = rows.join(heads, ["id", "th"]).select("id", "text", edited.alias("edited"), "next_links")
    both = both.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), anchors(F.col("text")).alias("own"), anchors(F.col("edited")).alias("other"), "next_links")
    both = both.select("id", "n_chars", "edited_sha256", "own", "other", links(F.col("own")).alias("own_links"), links(F.col("other")).alias("other_links"), "next_links")
    shared = [likeness(F.col("own_links"), F.col(c)).alias(n) for c, n in (("other_links", "near_edited"), ("next_links", "near_next"))]
    return both.select(F.when(F.col("id") != least, F.col("id")).alias(id_col), "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("other")).alias("edited_fingerprint"), *shared)
