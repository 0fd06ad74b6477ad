"""The query functions against plain Python, on a small table with nulls, empty texts, repeated rows and other scripts."""

import collections
import hashlib
import struct
import zlib

import pytest

from plumbline.llm import queries
from tests.llm.cases import words


def texts():
    out = {k: " ".join(words(("query", k), 5 + 9 * (k % 11))) for k in range(40)}
    return out | {50: None, 51: "", 52: "Ä ö 日本語 😀 text", 53: "  two  spaces ", 54: out[3], 55: "x" * 3000, 56: "line\nbreaks\n\nand\ttabs"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('queries')}"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts().items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_token_files(spark, folder):
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), 0, {}
    for i, t in sorted(texts().items()):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, folder).collect()} == want


def test_sentencepiece(spark, folder):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in queries.op2_sentencepiece(spark, folder).collect()}
    assert set(rows) == set(texts()) and all(r.parity for r in rows.values())
    for i, t in texts().items():
        assert rows[i].n_pieces == len(judge.encode(t or "")), i
        if rows[i].round_trip:
            assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_sharding(spark, folder):
    rows = queries.op7_sharding(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts()) and {r.law for r in rows} == {"bytes"}
    shard, slots = {}, collections.defaultdict(list)
    for r in rows:
        t = texts()[r.doc_id]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert shard.setdefault(t, r.shard) == r.shard and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fingerprints(spark, folder):
    rows = {r.doc_id: r for r in queries.op8_fingerprints(spark, folder).collect()}
    keys = sorted(texts())
    for at, i in enumerate(keys):
        t, other = texts()[i] or "", texts()[keys[at - 1]] or ""
        third = len(t) // 3
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - third] + other[:third]).encode()).hexdigest()
    assert rows[54].fingerprint == rows[3].fingerprint and rows[50].fingerprint == rows[51].fingerprint == ""


def test_repeats_and_components(spark, folder):
    assert all(r.n_removed == 0 or r.doc_id == 54 for r in queries.op6_substring_dedup(spark, folder).collect())
    assert {r.doc_id: r.component_id for r in queries.op10_jaccard_join(spark, folder).collect()} == {i: 3 if i == 54 else i for i in texts()}
