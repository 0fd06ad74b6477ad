import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest

from plumbline.llm import sentencepiece_model as S
from plumbline.llm import tokenfiles
from plumbline.llm.queries import vocabulary
from plumbline.llm.workspace import Workspace
from tests.llm.cases import edge, edge_rows, empty, words

ALPHABET = ["a", "b", "the", "The", " ", " ", "  ", "▁", "é", "\n", "\t", "日", "<s>", "/", "😀", " ", "　", "'s", "12", "!"]


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def fuzz(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_parity_with_sentencepiece():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    judge = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        codec = S.Codec(f.read(), 1)
    texts = fuzz(1, 1500) + ["", " ", "def f(x):\n    return  x"]
    flat, at = codec.encode(*buffers(texts))
    out, cut = codec.decode(flat, at)
    for t, i, j, a, b in zip(texts, at[:-1], at[1:], cut[:-1], cut[1:]):
        assert flat[i:j].tolist() == judge.encode(t)
        assert out[a:b].tobytes().decode(errors="replace") == judge.decode(flat[i:j].tolist())
    assert not codec.differ


def unigram():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, True
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)] + [("▁", -3, 1), ("a", -4, 1), ("b", -4.1, 1), ("ab", -5, 1), ("▁a", -4.5, 1), ("▁ab", -5.2, 1), ("ba", -5.1, 1), ("é", -6, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    return m.SerializeToString()


def test_unigram_models_keep_scores():
    import sentencepiece

    data = unigram()
    judge, codec = sentencepiece.SentencePieceProcessor(model_proto=data), S.Codec(data, 1)
    assert S.parse(data).kind == S.UNIGRAM
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  éx") for _ in range(rng.randrange(14))) for _ in range(400)]
    flat, at = codec.encode(*buffers(texts))
    assert [flat[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == judge.encode(texts)


def test_sentencepiece_edge_rows(spark):
    rows = S.encode(edge(spark), vocabulary("piece_bpe_32k.model")).collect()
    assert len(rows) == 11 and all(r.round_trip and r.parity for r in rows)
    assert {r.row.doc_id: r.ids for r in rows}[2] == [] and {r.row.doc_id: r.decoded for r in rows}[1] == ""
    assert S.encode(empty(spark), vocabulary("piece_bpe_32k.model")).count() == 0


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_byte_bpe_chunks_are_exact():
    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        coder = tokenfiles.byte_bpe(f.read(), 1)
    texts = fuzz(2, 1500) + ["a <|endoftext|> b", "x\x85 y", "\x1c \x1d"]
    flat, at = coder(*buffers(texts))
    assert [flat[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == library_ids(texts)


def test_files_round_trip(spark):
    texts = [(k, " ".join(words(k, 5 + k))) for k in range(60)] + [(100, None), (101, "")]
    random.Random(1).shuffle(texts)
    path = Workspace(spark, "t").path("files")
    tokenfiles.write(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), path, vocabulary("byte_bpe_50k.json"))
    rows = tokenfiles.starts(spark, path).join(tokenfiles.digests(spark, path), ["part", "row"]).orderBy("start").collect()
    start = 0
    for r, (key, text) in zip(rows, sorted(texts), strict=True):
        ids = library_ids([text or ""])[0] + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in tokenfiles.read_range(spark, path, 10, 12).orderBy("doc_id").collect()] == [10, 11]
    local = path.removeprefix("file://")
    meta = [pq.ParquetFile(f).metadata for f in ds.dataset(local).files]
    column = next(m for m in meta if m.num_rows).row_group(0).column(4)
    assert column.path_in_schema.startswith("ids") and column.has_dictionary_page and column.has_offset_index and column.has_column_index


def test_token_file_edge_rows(spark):
    path = Workspace(spark, "t").path("edge")
    tokenfiles.write(edge(spark), path, vocabulary("byte_bpe_50k.json"))
    rows = tokenfiles.starts(spark, path).collect()
    assert len(rows) == len(edge_rows()) and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    path = Workspace(spark, "t").path("none")
    tokenfiles.write(empty(spark), path, vocabulary("byte_bpe_50k.json"))
    assert tokenfiles.metadata(spark, path).count() == 0


def test_pieces_with_inner_markers_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(unigram())
    m.pieces.add(piece="a▁b", score=-1, type=1)
    with pytest.raises(ValueError):
        S.Codec(m.SerializeToString(), 1)


def test_later_tasks_of_a_worker_go_on_with_its_coder(monkeypatch):
    import tokenizers

    path, made, make = vocabulary("byte_bpe_50k.json"), [], tokenfiles.byte_bpe
    with open(path, "rb") as f:
        model = f.read()
    monkeypatch.setattr(tokenfiles, "byte_bpe", lambda *a: made.append(1) or make(*a))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = fuzz(11, 400) + [" ".join(words(k, 200, 10**6)) for k in range(20)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    run = tokenfiles._encode(model, 0, 1)
    out = [pa.Table.from_batches(run(iter([batch]))) for _ in range(2)]
    judge = tokenizers.Tokenizer.from_file(path)
    assert out[0].equals(out[1]) and len(made) == 1
    assert out[0].column("ids").to_pylist() == [[*judge.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert pa.Table.from_batches(tokenfiles._encode(model, 0, 1)(iter([batch]))).equals(out[0]) and len(made) == 2  # another write


def test_a_full_table_of_chunks_starts_anew():
    with open(vocabulary("byte_bpe_50k.json"), "rb") as f:
        coder = tokenfiles.byte_bpe(f.read(), 1)
    texts = fuzz(12, 300)
    want = coder(*buffers(texts))
    coder.most, coder.bits = 20, 6
    coder.reset()
    for _ in range(3):
        assert all(np.array_equal(x, y) for x, y in zip(coder(*buffers(texts)), want))
    assert coder.chunks > 20
