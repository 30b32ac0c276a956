"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here, by the longest prefix that the model's compiled character map knows at each place, and every
normalised byte remembers the byte of the text that it comes from. A copy of the model whose own normaliser does nothing
encodes the result, so each piece's place in it is known, and the map of bytes carries it back to a span of the text.
Ids are those of the sentencepiece library for the model as it is; decoding is the library's.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _field
from .common import columns_of, small_batches, with_report

SPACE = "▁"
#: Characters of a normalised text that are encoded at a time at least, where the vocabulary lets a longer one be cut.
STEP = 1 << 20
#: Numbers of the public model format: piece types, and the fields of a model.
NORMAL, USER, BYTE = 1, 4, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3


def fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, kind, data[at : at + size]
            at += size


class CharMap:
    """A compiled character map: a double-array trie of byte strings, and what each is replaced with."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :]
        first = [b for b in range(1, 256) if self._child(self._base(0), b) is not None] if self.units else []
        #: A pattern of the bytes that a string of the trie may begin with; empty if it has none.
        self.begins = b"[" + b"".join(b"\\x%02x" % b for b in first) + b"]" if first else b""

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 1 << 9) >> 6))

    def _child(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """The number of bytes of the longest known string that begins at ``at``, 0 if none does, and its replacement."""
        base, size, value = self._base(0), 0, 0
        for i in range(at, len(data)):
            node = self._child(base, data[i])
            if node is None:
                break
            base = self._base(node)
            if self.units[node] >> 8 & 1:
                size, value = i + 1 - at, self.units[base] & 0x7FFFFFFF
        return size, self.texts[value : self.texts.index(b"\0", value)] if size else b""


class Normaliser:
    """Normalises bytes as a model asks, with the origin of each normalised byte."""

    def __init__(self, chars: bytes, dummy: bool, squeeze: bool, escape: bool, suffix: bool, user: list[bytes]):
        self.map, self.dummy, self.squeeze, self.suffix = CharMap(chars), dummy, squeeze, suffix
        self.mark = SPACE.encode() if escape else b" "
        # User-defined symbols are never normalised; the longest that begins at a place counts, before the map.
        names = [re.escape(u) for u in sorted(user, key=len, reverse=True)]
        self.user = re.compile(b"|".join(names)) if names else None
        self.begins = re.compile(b"|".join([*names, *([self.map.begins] if self.map.begins else [])])) if names or self.map.begins else None

    def segments(self, data: bytes) -> Iterator[tuple[int, bytes | None]]:
        """(end, replacement or None for itself): the text cut where the map or a user-defined symbol says something."""
        at = done = 0
        while found := self.begins.search(data, at):
            start = found.start()
            own = self.user.match(data, start) if self.user else None
            size, text = (own.end() - start, data[start : own.end()]) if own else self.map.longest(data, start)
            if not size:  # a character of its own
                at = start + 1
                while at < len(data) and data[at] & 0xC0 == 0x80:
                    at += 1
                continue
            if start > done:
                yield start, None
            at = done = start + size
            yield at, text
        if done < len(data):
            yield len(data), None

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each the byte of ``data`` where what it stands for begins; one more for the end."""
        raw = np.frombuffer(data, np.uint8)
        heads = (raw & 0xC0) != 0x80  # bytes that begin a part that is replaced as one
        starts = np.flatnonzero(heads).astype(np.int32).repeat(np.diff(np.flatnonzero(np.append(heads, True))))
        lead = len(data) - len(data.lstrip(b" "))  # where the text begins after parts that are one space each
        if self.begins:
            parts, origin, head, begin, lead = [], [], [], 0, 0
            for end, text in self.segments(data):
                if lead == begin:
                    spaces = len(data[begin:end]) - len(data[begin:end].lstrip(b" "))
                    lead += spaces if text is None else (end - begin) * (text == b" ")
                parts.append(data[begin:end] if text is None else text)
                origin.append(starts[begin:end] if text is None else np.full(len(text), begin, np.int32))
                head.append(heads[begin:end] if text is None else np.arange(len(text)) == 0)
                begin = end
            text, origin, heads = b"".join(parts), np.concatenate([*origin, np.zeros(0, np.int32)]), np.concatenate([*head, np.zeros(0, bool)])
        else:
            text, origin = data, starts
        flat = np.frombuffer(text, np.uint8)
        if self.squeeze:
            flat, origin = self._squeezed(flat, origin, heads)
        if not data or self.squeeze and not len(flat):
            return b"", np.array([len(data)], np.int32)
        return self._marked(flat, origin, lead if self.squeeze else 0, len(data))

    @staticmethod
    def _squeezed(flat: np.ndarray, origin: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without spaces at the beginning, and without those at a part's beginning that follow a space."""
        space, at = flat == 32, np.arange(len(flat))
        begin = np.maximum.accumulate(np.where(heads, at, 0))
        other = np.maximum.accumulate(np.where(~space, at, -1))  # the last byte so far that is no space
        after = (begin == 0) | space[np.maximum(begin - 1, 0)]
        keep = ~(space & (other < begin) & after)
        return flat[keep], origin[keep]

    def _marked(self, flat: np.ndarray, origin: np.ndarray, lead: int, end: int) -> tuple[bytes, np.ndarray]:
        """With space marks, without those at the end if spaces are squeezed, and with the dummy mark."""
        wide, text = len(self.mark), flat.tobytes().replace(b" ", self.mark)
        origin = np.concatenate([np.repeat(origin, np.where(flat == 32, wide, 1)), [end]])
        if self.dummy and not self.suffix:
            text, origin = self.mark + text, np.concatenate([np.full(wide, lead), origin])
        while self.squeeze and text.endswith(self.mark):
            text = text[:-wide]
        origin = origin[: len(text) + 1]
        if self.dummy and self.suffix:
            text, origin = text + self.mark, np.concatenate([origin, np.full(wide, origin[-1])])
        return text, origin.astype(np.int32)


class Codec:
    """Encodes by a model."""

    def __init__(self, data: bytes):
        import sentencepiece

        parts = list(fields(data))
        flags = {n: v for number, _, value in parts if number == TRAINER for n, _, v in fields(value)}
        norm = {n: v for number, _, value in parts if number == NORMALIZER for n, _, v in fields(value)}
        pieces = [{n: v for n, _, v in fields(value)} for number, _, value in parts if number == PIECES]
        words = [(p[1], p.get(3, NORMAL)) for p in pieces]
        user = [w for w, kind in words if kind == USER]
        # Fields: 24 spaces as suffixes, 35 byte fallback; 2 map, 3 dummy prefix, 4 extra spaces, 5 escape.
        suffix, self.fallback = bool(flags.get(24, 0)), bool(flags.get(35, 0))
        self.normal = Normaliser(norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)), suffix, user)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=self._plain(parts))
        self.sizes = np.array([1 if kind == BYTE else len(w) for w, kind in words], np.int32)
        # No piece holds a space mark after something else: then no merge crosses the place before such a mark.
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        whole = any(crossing.search(w.decode("utf-8", "replace")) for w, _ in words) or (SPACE.encode(), NORMAL) not in words
        self.cuts = self.fallback and not user and not whole
        self.cut = re.compile(f"(?<!{SPACE})(?={SPACE})")

    @staticmethod
    def _plain(parts: list) -> bytes:
        """The model with a normaliser that does nothing."""
        made = [_field(n, v if k != 5 else struct.unpack("<f", v)[0]) for n, k, v in parts if n != NORMALIZER]
        return b"".join(made) + _field(NORMALIZER, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a normalised text and the bytes of each piece."""
        if self.fallback:
            ids = self.inner.encode(text, return_type="numpy")
            return ids, self.sizes[ids]
        found = self.inner.encode(text, return_type="proto").pieces if text else []
        return np.array([p.id for p in found], np.int32), np.array([p.end - p.begin for p in found], np.int32)

    def parts(self, text: str) -> Iterator[str]:
        """A long text cut where no merge can cross."""
        at = 0
        while self.cuts and len(text) - at > STEP and (found := self.cut.search(text, at + STEP)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, data: bytes, end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, and where each begins and ends in it."""
        data = data.decode("utf-8", "replace").encode()  # bytes that are no UTF-8
        normal, origin = self.normal(data)
        found = list(map(self.pieces, self.parts(normal.decode())))
        ids, sizes = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
        at = np.zeros(len(ids) + 1, np.int32)
        np.cumsum(sizes, out=at[1:])
        begins, ends = origin[at[:-1]], origin[at[1:]]
        if end:
            last = self.library.eos_id()
            if last < 0:
                raise ValueError("the model has no end id")
            stop = np.array([len(data)], np.int32)
            ids, begins, ends = np.append(ids, np.int32(last)), np.concatenate([begins, stop]), np.concatenate([ends, stop])
        return ids, begins, ends


_codecs: dict[str, Codec] = {}


def _codec(key: str, data) -> Codec:
    """A worker process builds each codec once."""
    if key not in _codecs:
        _codecs[key] = Codec(data.value)
    return _codecs[key]


def _sent(df: DataFrame, path: str):
    """The model's bytes, read where the driver runs; their size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def sentencepiece_encode(docs: DataFrame, model_path: str, text_col: str = "text", end: bool = True) -> DataFrame:
    """``docs`` with ``ids``, and ``begins`` and ``ends``: the span of bytes of the text that each piece stands for.

    Ids equal those of the sentencepiece library for the model, without sampling, followed by the end id if ``end``. Spans
    count from 0; they follow one another without gaps, but for spaces that the model takes away. Of the byte pieces of one
    character the last has its span, the others an empty one before it; an end id has an empty span at the text's end. A
    null text counts as empty. Rows and repeats stay; no rows give no rows; columns of the three names are replaced, others
    keep their names. Texts are encoded whole, whatever their length.
    """
    data = _sent(docs, model_path)
    keep = [c for c in docs.columns if c.lower() not in ("ids", "begins", "ends")]

    def make():
        codec = _codec(model_path, data)

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            found = [codec.encode(t or b"", end) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32)
            flat = [np.concatenate([np.zeros(0, np.int32), *(x[i] for x in found)]) for i in range(3)]
            return [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in flat]

        return work

    found = with_report(docs, text_col, keep, make, "ids array<int>, begins array<int>, ends array<int>")
    return found.select(*columns_of(keep), "ids", "begins", "ends")


def sentencepiece_decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``, the text that the library decodes ``ids_col`` to; null ids give an empty text.

    A column of the name ``out_col`` is replaced. Rows and repeats stay; no rows give no rows.
    """
    small_batches(encoded.sparkSession)
    data = _sent(encoded, model_path)

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        model = _codec(model_path, data).library
        return pa.array([model.decode(x.values.to_numpy()) if x.is_valid and len(x.values) else "" for x in ids], pa.string())

    return encoded.withColumn(out_col, decoded(F.col(ids_col)))
