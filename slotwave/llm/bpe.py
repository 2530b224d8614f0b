"""Byte-level BPE through a sentencepiece model made directly from a rank file.

Every byte b is written as the character U+0100 + b, so each vocabulary entry becomes a piece
of such characters with score -rank. The model is serialised from the vocabulary alone (BPE
type, identity normalisation, no prefix, no white-space handling); nothing is trained. Texts
are cut by the pre-token pattern, each pre-token is encoded by itself, and decoding maps ids
back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, release

#: Pre-tokens remembered in a worker; beyond that the memory is emptied, which changes no result.
REMEMBERED = 100_000
#: Bytes of text whose pre-tokens are held at once.
BLOCK = 1 << 18


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a file of lines 'base64 rank'."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def mapped(data: bytes) -> str:
    return (np.frombuffer(data, np.uint8).astype("<u2") + 0x100).tobytes().decode("utf-16-le")


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown piece, piece r + 1 the token of rank r."""
    pieces = [_field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))]
    for rank, token in enumerate(tokens):
        pieces.append(_field(1, 2, _field(1, 2, mapped(token).encode()) + _field(2, 5, struct.pack("<f", -float(rank)))))
    trainer = _field(3, 0, _varint(2))
    normaliser = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return b"".join(pieces) + _field(2, 2, trainer) + _field(3, 2, normaliser)


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.cut = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.known: dict[str, bytes] = {}

    def learn(self, pre_tokens: set[str]) -> None:
        """Encodes those not known yet, in one call."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in pre_tokens if p not in self.known]
        raw = [p.encode() for p in new]
        text, at, ask = mapped(b"".join(raw)), 0, []
        for p, r in zip(new, raw, strict=True):
            rank = self.whole.get(r)
            if rank is not None:  # a pre-token that is itself a token stays whole
                self.known[p] = struct.pack("<I", rank)
            else:
                ask.append((p, text[at : at + len(r)]))
            at += len(r)
        for (p, _), ids in zip(ask, self.model.encode([x for _, x in ask], num_threads=1), strict=True):
            self.known[p] = (np.array(ids, "<u4") - np.uint32(1)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; equal texts are encoded once."""
        cut = {t: self.cut(t) for t in texts}
        self.learn({p for ps in cut.values() for p in ps})
        ids = {t: b"".join(map(self.known.__getitem__, ps)) for t, ps in cut.items()}
        return [ids[t] for t in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def _codec(name: str, tokens: list[bytes], pattern: str) -> Codec:
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(tokens, pattern)
    return _CODECS[name]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (uint32, little-endian), decoded (the bytes the ids stand for).

    With digests, ids_sha256 and decoded_sha256 stand for the two binary columns. A null text
    counts as an empty one: no tokens. Every row is encoded by itself, so equal rows give equal
    rows, and an empty table none; further columns of the input, whatever their names, are
    ignored. The vocabulary is one file of fixed size and is broadcast.
    """
    tokens = read_ranks(vocabulary)
    name = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        codec = _codec(name, shared.value, pattern)
        try:
            for batch in batches:
                for part in blocks(batch, "text", BLOCK):
                    ids = codec.encode([t or "" for t in part["text"].to_pylist()])
                    decoded = {x: codec.decode(x) for x in set(ids)}
                    back = [decoded[x] for x in ids]
                    n = pa.array([len(x) // 4 for x in ids], pa.int64())
                    if digests:
                        columns = [pa.array([hashlib.sha256(x).hexdigest() for x in xs]) for xs in (ids, back)]
                    else:
                        columns = [pa.array(xs, pa.binary()) for xs in (ids, back)]
                    yield pa.RecordBatch.from_arrays([part["doc_id"], n, *columns], names=["doc_id", "n_tokens", *names])
        finally:  # workers outlive their tasks and would keep the model through the stages that follow
            del codec
            _CODECS.clear()
            release()

    names, kind = (("ids_sha256", "decoded_sha256"), "string") if digests else (("ids", "decoded"), "binary")
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} {kind}, {names[1]} {kind}")
