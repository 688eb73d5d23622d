"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Every token of the rank file becomes a piece: its bytes mapped to one character each, its
score the negative rank, so that the library's best-scored merge is the lowest-ranked one.
The normaliser is the identity and no white space is treated. Pieces of the split pattern
are encoded one by one; a piece that is a token itself is that token. Decoding maps pieces
back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import pretokens
from skein.llm.tables import given, ship

SHIFT = 0x100  # byte b is the character chr(SHIFT + b)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 token, space, rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def mapped(token: bytes) -> str:
    return (np.frombuffer(token, dtype=np.uint8).astype("<u2") + SHIFT).tobytes().decode("utf-16-le")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """Serialised model; ids are ranks, the unknown piece comes last."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    unknown = "<unk>"
    pieces = [
        _bytes_field(1, _bytes_field(1, mapped(t).encode()) + b"\x15" + struct.pack("<f", -r))
        for r, t in enumerate(tokens)
    ]
    pieces.append(_bytes_field(1, _bytes_field(1, unknown.encode()) + b"\x15" + struct.pack("<f", 0) + _int_field(3, 2)))
    trainer = (
        _int_field(3, 2)  # model type: BPE
        + _int_field(4, len(pieces))
        + _int_field(40, len(tokens))  # id of the unknown piece
        + b"".join(_int_field(f, -1) for f in (41, 42, 43))  # no begin, end or padding piece
        + _bytes_field(45, unknown.encode())
    )
    normaliser = _bytes_field(1, b"identity") + b"".join(_int_field(f, 0) for f in (3, 4, 5))
    return b"".join(pieces) + _bytes_field(2, trainer) + _bytes_field(3, normaliser)


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.model.get_piece_size() - 1
        pieces = self.model.id_to_piece(list(range(n)))
        tokens = [(np.frombuffer(p.encode("utf-16-le"), dtype="<u2") - SHIFT).astype(np.uint8) for p in pieces]
        self.known = {p: i for i, p in enumerate(pieces)}
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(tokens)
        self.pieces = pretokens.PieceIds(self._encode)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        names = [mapped(p.encode()) for p in pieces]
        out = [[self.known[p]] if p in self.known else None for p in names]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.model.encode([names[i] for i in rest], num_threads=1), strict=True):
            out[i] = ids
        return pretokens.flattened(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pieces.ids(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return pretokens.spread(self.flat, self.offsets[ids], self.sizes[ids]).tobytes()


def _coded(batches: Iterator[pa.RecordBatch], proto, what: str) -> Iterator[pa.RecordBatch]:
    codec = Codec(proto.value)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for begin, end in pretokens.slices([len(t) for t in texts]):
            ids, bounds = codec.encode(texts[begin:end])
            keys = batch.column("doc_id").slice(begin, end - begin)
            own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            sizes = pa.array(np.diff(bounds), pa.int64())
            if what == "ids":
                values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys, values], ["doc_id", "ids"])
                continue
            decoded = [codec.decode(x) for x in own]
            columns = [
                keys,
                sizes,
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, what: str, schema: str) -> DataFrame:
    source = given(docs, doc_id=id_col, text=text_col)
    proto = docs.sparkSession.sparkContext.broadcast(model_proto(read_ranks(path)))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda batches: _coded(batches, proto, what), f"doc_id {kind}, {schema}")


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every row, ids being ranks of the rank file at ``path``.

    The model is a constant of the file's size and the only thing broadcast. Null and empty
    texts have no ids. Rows are independent: ids may repeat or be null; an empty table gives
    an empty result; other columns are ignored.
    """
    return _run(docs, path, id_col, text_col, "ids", "ids array<int>")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: ids and their decoding, as digests.

    Rows as in :func:`bpe_encode`; a null text counts as empty.
    """
    return _run(docs, path, id_col, text_col, "digests", "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _decoded(batches: Iterator[pa.RecordBatch], proto) -> Iterator[pa.RecordBatch]:
    codec = Codec(proto.value)
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids").slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = pa.array([codec.decode(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), text], ["doc_id", "decoded"])


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded binary`` from id lists; a null list decodes to nothing."""
    source = given(encoded, doc_id=id_col, ids=F.coalesce(encoded[ids_col], F.expr("CAST(array() AS array<int>)")))
    proto = encoded.sparkSession.sparkContext.broadcast(model_proto(read_ranks(path)))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda batches: _decoded(batches, proto), f"doc_id {kind}, decoded binary")


ship(pretokens, sys.modules[__name__])
