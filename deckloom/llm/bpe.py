"""Byte-level BPE encoding and decoding by a sentencepiece model that is serialised from a rank file.

Every entry of the rank file becomes a piece: its bytes mapped to printable characters, its score the negative rank, so
that sentencepiece merges in the order of ranks. The normaliser is the identity. Texts are cut into pre-tokens first and
each is encoded by itself; decoding maps ids back to pieces and pieces back to bytes. Nothing is trained.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, small_batches, with_report

#: Encoded pre-tokens kept by a worker, and the characters up to which a pre-token is kept.
CACHE_ENTRIES, CACHE_CHARS = 1 << 17, 64
#: Characters from which a text's pre-tokens are found bit by bit, and how many tokens at a time.
LONG_TEXT, STEP = 1 << 22, 1 << 18


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def byte_chars() -> str:
    """A printable character for each byte: the visible Latin-1 characters stand for themselves, others follow U+0100."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return "".join(chr(b if b in seen else next(other)) for b in range(256))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model. Piece 0 is the unknown piece; the piece of rank r has id r + 1."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must count up from 0")
    chars = byte_chars()
    # Numbers of the public model format: piece, score, type (1 normal, 2 unknown).
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = token.decode("latin-1").translate(chars)
        pieces.append(_field(1, _field(1, text.encode()) + _field(2, float(-rank)) + _field(3, 1)))
    # Model type 2 is BPE; unk is 0, bos, eos and pad do not exist.
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    # No dummy prefix, no removal of spaces, no escape of spaces.
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


def tokens_of(data: bytes) -> list[bytes]:
    """The bytes of each id, from its piece back through the map of bytes to characters."""
    chars = byte_chars()
    back = {ord(c): b for b, c in enumerate(chars)}
    pieces = (t.decode("latin-1").translate(chars) for t, _ in sorted(read_ranks(data).items(), key=lambda x: x[1]))
    return [p.translate(back).encode("latin-1") for p in pieces]


def decode(ids: list[int], tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


class Codec(dict):
    """Encodes by a rank file's bytes. As a dict it holds the ids of recent pre-tokens."""

    def __init__(self, data: bytes, pattern: str):
        import regex
        import sentencepiece

        super().__init__()
        self.ranks = read_ranks(data)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.pattern = regex.compile(pattern)
        self.chars = byte_chars()

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        rank = self.ranks.get(raw)  # a pre-token that is a token is not merged
        ids = [rank] if rank is not None else [i - 1 for i in self.model.encode(raw.decode("latin-1").translate(self.chars))]
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if len(text) < LONG_TEXT:
            return np.fromiter(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text))), np.int32)
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while piece := list(islice(found, STEP)):
            out.append(np.fromiter(chain.from_iterable(map(self.__getitem__, piece)), np.int32))
        return np.concatenate(out)


_codecs: dict[tuple, Codec] = {}


def _codec(key: tuple, data, pattern: str) -> Codec:
    """A worker process builds each codec once."""
    if key not in _codecs:
        _codecs[key] = Codec(data.value, pattern)
    return _codecs[key]


_tokens: dict[str, list[bytes]] = {}


def _table(key: str, data) -> list[bytes]:
    if key not in _tokens:
        _tokens[key] = tokens_of(data.value)
    return _tokens[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``, the array of token ids of the whole text, without special tokens, and on demand with
    ``decoded_col``, the bytes that ``bpe_decode`` makes of these ids, from the same task's worker.

    Equal to what tiktoken gives for the rank file and pattern. A null text counts as empty and has no ids; very long texts
    are encoded whole, some tokens at a time. Rows and repeats stay, no rows give no rows; columns of the names ``ids_col`` and
    ``decoded_col`` are replaced. The rank file is read where the driver runs and sent to the executors: its size is fixed by the
    vocabulary.
    """
    with open(ranks_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    new = [c for c in (ids_col, decoded_col) if c]
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    key = (ranks_path, pattern)

    def make():
        codec = _codec(key, data, pattern)

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            ids = [codec.encode(t.decode("utf-8", "replace")) if t else np.zeros(0, np.int32) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            found = [pa.ListArray.from_arrays(offsets, np.concatenate(ids) if ids else np.zeros(0, np.int32))]
            if decoded_col:
                tokens = _table(ranks_path, data)
                found.append(pa.array([decode(x.tolist(), tokens) for x in ids], pa.binary()))
            return found

        return work

    schema = "ids array<int>" + ", decoded binary" * bool(decoded_col)
    return with_report(docs, text_col, keep, make, schema).select(*columns_of(keep), F.col("ids").alias(ids_col), *[F.col("decoded").alias(c) for c in new[1:]])


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``, the bytes that ``ids_col`` stands for; null ids give no bytes.

    A column of the name ``out_col`` is replaced; rows and repeats stay, no rows give no rows.
    """
    small_batches(encoded.sparkSession)
    with open(ranks_path, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        tokens = _table(ranks_path, data)
        return pa.array([decode(x.values.to_numpy().tolist(), tokens) if x.is_valid else b"" for x in ids], pa.binary())

    return encoded.withColumn(out_col, decoded(F.col(ids_col)))
