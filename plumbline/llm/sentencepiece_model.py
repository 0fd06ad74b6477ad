"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here. Its normaliser, metaspace marker, scores and byte fallback are
rebuilt as a tokenizers pipeline: unigram models keep their scores, BPE models turn scores into ranked
merges. No piece has the marker after another character, so texts are cut before each run of blanks and
distinct chunks are encoded in multithreaded batches. Each distinct chunk is verified against the
sentencepiece library; should the two differ, its ids hold and the document's parity is false.

Defined cases: null and empty texts have no ids and decode to an empty text. Bytes that aren't UTF-8
after decoding become U+FFFD. Ids of rows play no part, so ties and repeated rows are coded alike. Texts
are coded whole. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textscan as T
from plumbline.llm import tokens

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    def ids_of(self, kind: int) -> list[int]:
        return [i for i, p in enumerate(self.pieces) if p[2] == kind]


def parse(data: bytes) -> Model:
    """Field numbers are those of the public sentencepiece_model.proto."""
    model = Model([])
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif k == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """All ways to put a piece together from two pieces, best score first."""
    real = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = sorted(real.items(), key=lambda x: (-model.pieces[x[1]][1], x[1]))
    out = []
    for piece, _ in ranked:
        ways = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in real and piece[k:] in real]
        out += sorted(ways, key=lambda w: (real[w[0]], real[w[1]]))
    return out


def build(model: Model):
    """The tokenizers pipeline; it expects texts with the dummy prefix in front."""
    from tokenizers import AddedToken, Tokenizer, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = model.ids_of(UNKNOWN)
    if model.kind == BPE:
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[unknown[0]][0] if unknown else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown[0] if unknown else None, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} has no pieces to merge or score")
    tokenizer = Tokenizer(core)
    if model.escape:
        tokenizer.normalizer = normalizers.Replace(" ", MARK)
    own = [AddedToken(model.pieces[i][0], normalized=False) for i in model.ids_of(USER_DEFINED)]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def normaliser(model: Model):
    """What changes texts before the marker: the character map and the squeezing of blanks."""
    from tokenizers import Regex, normalizers

    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    return normalizers.Sequence(steps) if steps else None


class Codec:
    """Encodes and decodes slices of texts."""

    def __init__(self, data: bytes, workers: int = 2, verify: bool = True, made: str | None = None):
        """made: the tokenizer as text, where another process has put it together already."""
        tokens.threads(workers)
        self.model, self.verify, self.differ = parse(data), verify, set()
        if any(MARK in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)):
            raise ValueError("a piece has the marker inside: texts can't be cut into chunks")
        from tokenizers import Tokenizer

        self.tokenizer, self.before = Tokenizer.from_str(made) if made else build(self.model), normaliser(self.model)
        if verify:
            import sentencepiece

            # A later normaliser message is merged into the model's: no dummy prefix, no squeezing.
            self.judge = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a\x04\x18\x00\x20\x00")
        self.coder = tokens.ChunkCoder(tokens.one_by_one(self._encode), tokens.BLANK, tokens.after_no_marker)
        table = []
        for piece, _, kind in self.model.pieces:
            if kind == BYTE:
                table.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                table.append(b"")
            elif kind == UNKNOWN:
                table.append(" ⁇ ".encode())
            else:
                table.append(piece.replace(MARK, " ").encode())
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.count = np.fromiter(map(len, table), np.int64, len(table))
        self.start = np.cumsum(self.count) - self.count

    def _encode(self, strings: list[str]) -> list[list[int]]:
        ids = [x.ids for x in self.tokenizer.encode_batch(strings, add_special_tokens=False)]
        if self.verify:
            right = self.judge.encode(strings, num_threads=1)
            for k, (a, b) in enumerate(zip(ids, right)):
                if a != b:
                    self.differ.add(strings[k])  # the ids stay this backend's, and parity says so
        return ids

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their offsets."""
        if self.before is not None:
            raw = data.tobytes()
            texts = [self.before.normalize_str(raw[i:j].decode()).encode() for i, j in zip(offs[:-1], offs[1:])]
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            offs = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
        if self.model.dummy_prefix and len(data):
            some = np.diff(offs) > 0
            data = np.insert(data, offs[:-1][some], 0x20)
            offs = offs + np.append(0, np.cumsum(some))
        return self.coder(data, offs)

    def decode(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after the other, and their offsets."""
        counts = self.count[flat]
        ends = np.cumsum(counts)
        before = np.append(0, ends)
        where = np.repeat(self.start[flat] - (ends - counts), counts) + np.arange(before[-1])
        data, offs = self.bytes[where], before[at]
        if self.model.dummy_prefix and len(data):
            heads = offs[:-1][np.diff(offs) > 0]
            lost = heads[data[heads] == 0x20]
            gone = np.zeros(len(data), dtype=np.int64)
            gone[lost] = 1
            data = data[gone == 0]
            offs = offs - np.append(0, np.cumsum(gone))[offs]
        return data, offs


def _run(data: bytes, made: str, workers: int, verify: bool, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data, workers, verify, made)
        for batch in batches:
            row = batch.column("row")
            for i, j, raw, offs in T.slices(batch.column("text")):
                flat, at = codec.encode(raw, offs)
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                out, cut = codec.decode(flat, at)
                same = np.array_equal(out, raw) and np.array_equal(cut, offs)
                body = out.tobytes()
                texts = [body[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                if same:
                    equal = np.ones(j - i, dtype=bool)
                else:
                    whole = raw.tobytes()
                    equal = np.array([t == whole[a:b] for t, a, b in zip(texts, offs[:-1].tolist(), offs[1:].tolist())], dtype=bool)
                parity = np.ones(j - i, dtype=bool)
                if codec.differ:
                    whole = raw.tobytes()
                    parity = np.array([not any(c in " " + whole[a:b].decode() for c in codec.differ) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], dtype=bool)
                decoded = pa.array([t.decode(errors="replace") for t in texts] if want_text else [None] * (j - i), pa.string())
                yield pa.RecordBatch.from_arrays([row.slice(i, j - i), ids, decoded, pa.array(equal), pa.array(parity)], ["row", "ids", "decoded", "round_trip", "parity"])
        del codec
        T.tidy(cycles=True)

    return run


def encode(docs: DataFrame, model_file: str, text_col: str = "text", workers: int = 2, verify: bool = True, decoded: bool = True) -> DataFrame:
    """For each row: row (its columns), ids, decoded (the text made of the ids), round_trip (whether that
    is the text) and parity (whether the sentencepiece library gives the same ids)."""
    with open(model_file, "rb") as f:
        data = f.read()
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["row"].dataType.simpleString()
    made = build(parse(data)).to_str()  # once, as the list of merges takes more memory than all else in a worker
    return source.mapInArrow(_run(data, made, workers, verify, decoded), f"row {kind}, ids array<int>, decoded string, round_trip boolean, parity boolean")
