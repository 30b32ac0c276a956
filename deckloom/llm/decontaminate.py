"""Benchmark decontamination by Wu-Manber search for many passages at once.

The patterns are word windows of the benchmark items. For patterns of one length a shift table over blocks of words says
how far the window may move on without passing an occurrence; where it says 0, the hashes of the window's last and first
block select the few patterns to compare directly. A text is scanned once; no rows are shuffled.

Benchmark items go to the executors in shards of bounded size. With one shard the rows pass through in a single step. With
more a filter comes first: a bit set of hashes of a few words out of every window of all items, of bounded size, which drops
almost all texts in one pass. Only texts that may hold a window meet the shards, whose tables a task builds once and which
are given up before the next one is sent; hits of all shards are put together by row. So a benchmark of any size needs the
memory of the filter and of one shard, on the driver and in a task, and texts are read twice whatever the number of shards.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, small_batches, with_report, written

WINDOW_WORDS = 13
#: Words of a block, and hashes of blocks.
BLOCK, TABLE = 3, 1 << 20
#: Bytes of item text in a shard, on average; an item is never cut.
SHARD_BYTES = 4 << 20
#: Hit texts whose items are sent to all executors at most.
SENT_HITS = 1 << 16
#: Words of a block of the filter, bits for every four bytes of items, places of a block among them, and the logarithms of
#: its least and largest size in bits. At the largest size 1 GB of items lets about one text of 400 words in twenty pass.
FILTER_BLOCK, FILTER_BITS, FILTER_PLACES, FILTER_SIZES = 8, 16, 6, (16, 30)
#: Lower-cases A-Z and turns all but 0-9, a-z and bytes of other letters into spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Shard:
    """Shift tables and buckets for the windows of some items."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[bytes, set[str]] = {}
        number = self.vocabulary.setdefault
        for item, text in items:
            ids = np.array([number(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            m, raw = min(window, len(ids)), ids.tobytes()
            for i in range(len(ids) - m + 1 if m else 0):
                self.owners.setdefault(raw[4 * i : 4 * (i + m)], set()).add(item)
        by_length: dict[int, list[bytes]] = {}
        for p in self.owners:
            by_length.setdefault(len(p) // 4, []).append(p)
        self.lengths = [(m, *self._tables(m, own)) for m, own in sorted(by_length.items())]

    @staticmethod
    def hashes(ids: np.ndarray, block: int) -> np.ndarray:
        """Of the block that starts at each position."""
        h, n = np.zeros(ids.shape[-1] - block + 1, np.uint64) if ids.ndim == 1 else np.zeros((len(ids), ids.shape[1] - block + 1), np.uint64), ids.shape[-1]
        for k in range(block):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[..., k : n - block + 1 + k].astype(np.uint64)
        return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)

    def _tables(self, m: int, patterns: list[bytes]) -> tuple[int, np.ndarray, dict[int, list[bytes]]]:
        block = min(BLOCK, m)
        h = self.hashes(np.frombuffer(b"".join(patterns), np.int32).reshape(-1, m), block)
        shift = np.full(TABLE, m - block + 1, np.uint8 if m < 256 else np.int32)
        for k in range(h.shape[1]):  # from the first block to the last: the least shift is set last
            shift[h[:, k]] = m - block - k
        buckets: dict[int, list[bytes]] = {}
        for p, last, first in zip(patterns, h[:, -1].tolist(), h[:, 0].tolist()):
            buckets.setdefault(last * TABLE + first, []).append(p)
        return block, shift, buckets

    def scan(self, words: list[bytes], hits: bytearray, items: set[str]) -> None:
        """Marks the words inside occurrences in ``hits`` and adds the items that have any."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        raw, n, h, was = ids.tobytes(), len(words), None, 0
        for m, block, shift, buckets in self.lengths:
            if m > n:
                break
            if block != was:
                h, was = self.hashes(ids, block), block
            steps, one = shift[h].tolist(), b"\1" * m
            i, end = m - block, n - block  # i: where the window's last block starts
            while i <= end:
                if step := steps[i]:
                    i += step
                    continue
                start = i - m + block
                for p in buckets.get(int(h[i]) * TABLE + int(h[start]), ()):
                    if raw[4 * start : 4 * (start + m)] == p:
                        hits[start : start + m] = one
                        items |= self.owners[p]
                i += 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def block_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of the ``size`` words from each position on."""
    h, n = np.full(max(len(hashes) - size + 1, 0), size, np.uint64), len(hashes)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k] if len(h) else h
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def passage_keys(words: list[bytes], window: int) -> np.ndarray:
    """For every window of an item the hash of a block in it: of the blocks of a window the one with the least hash, so that
    neighbouring windows share theirs; of a shorter item its first block."""
    m = min(window, len(words))
    if not m:
        return np.zeros(0, np.uint64)
    blocks = block_hashes(word_hashes(words), min(FILTER_BLOCK, m))
    if m < window:
        return blocks[:1]
    return np.unique(np.lib.stride_tricks.sliding_window_view(blocks, window - min(FILTER_BLOCK, m) + 1).min(1))


class Filter:
    """Tells texts that can hold no window of any item; few others pass. ``sizes`` are the words of the blocks that are set."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes

    @staticmethod
    def places(keys: np.ndarray, log_bits: int) -> list[np.ndarray]:
        mask = np.uint64((1 << log_bits) - 1)
        step = keys >> np.uint64(32) | np.uint64(1)
        return [keys + np.uint64(i) * step & mask for i in range(FILTER_PLACES)]

    def may_hold(self, words: list[bytes]) -> bool:
        hashes, log_bits = word_hashes(words), len(self.bits).bit_length() - 1 + 6
        for size in self.sizes:
            keys = block_hashes(hashes, size)
            found = np.ones(len(keys), bool)
            for at in self.places(keys, log_bits):
                found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            if found.any():
                return True
        return False


def _filter(items: DataFrame, window: int, size: int):
    """The filter of all items, about ``size`` bytes of text, as a broadcast variable of 2**FILTER_SIZES[1] bits at most."""
    log_bits = min(max((size // 4 * FILTER_BITS).bit_length(), FILTER_SIZES[0]), FILTER_SIZES[1])
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words_of(t or b"") for t in batch.column(0).to_pylist()]
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(passage_keys(w, window) for w in own)]))
            at = np.unique(np.concatenate(Filter.places(keys, log_bits)))
            slots, first = np.unique(at >> np.uint64(6), return_index=True)
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(masks.view(np.int64))], ["slot", "mask"])
            lengths = np.array(sorted({min(FILTER_BLOCK, len(w)) for w in own if w}), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(-lengths), pa.array(np.zeros(len(lengths), np.int64))], ["slot", "mask"])  # sizes below zero

    got = items.select("text").mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row for each 64 bits at most
    slots, masks = got["slot"].to_numpy(), got["mask"].to_numpy().view(np.uint64)
    bits = np.zeros(1 << log_bits - 6, np.uint64)
    bits[slots[slots >= 0]] = masks[slots >= 0]
    # Slot 0 is one of bits: sizes begin at 1.
    return items.sparkSession.sparkContext.broadcast(Filter(bits, sorted(-slots[slots < 0].astype(int))))


def _sent(items: DataFrame, shards: int, k: int):
    """Items of the k-th shard, about SHARD_BYTES of text, as a broadcast variable."""
    own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) if shards > 1 else items
    return items.sparkSession.sparkContext.broadcast([(r.item, bytes(r.text)) for r in own.collect()])


def _is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _in_one_pass(docs: DataFrame, keep: list[str], text_col: str, items: DataFrame, window: int) -> DataFrame:
    sent = _sent(items, 1, 0)

    def make():
        shard = Shard(sent.value, window)

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            counts, n_hit, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [set() for _ in texts]
            for i, t in enumerate(texts):
                words = words_of(t or b"")
                hits = bytearray(len(words))
                shard.scan(words, hits, found[i])
                counts[i], n_hit[i] = len(words), hits.count(1)
            return [pa.array(counts), pa.array(n_hit), pa.array([sorted(s) for s in found], pa.list_(pa.string()))]

        return work

    return with_report(docs, text_col, keep, make, "n_words long, n_hit long, items array<string>")


def _in_passes(docs: DataFrame, keep: list[str], text_col: str, items: DataFrame, window: int, shards: int, size: int) -> DataFrame:
    doc = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)]).alias("doc")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), doc, docs[text_col].cast("string").alias("text")), "passage-rows")
    counted = with_report(rows, "text", ["row", "doc"], lambda: lambda texts: [pa.array([len(words_of(t or b"")) for t in texts], pa.int64())], "n_words long")
    counted = counted.select(F.col("doc.c0").alias("row"), F.col("doc.c1").alias("doc"), "n_words")
    sieve = _filter(items, window, size)
    may = with_report(rows, "text", ["row", "text"], lambda: lambda texts: [pa.array([bool(t) and sieve.value.may_hold(words_of(t)) for t in texts], pa.bool_())], "may boolean")
    may = written(may.where("may").select(F.col("doc.c0").alias("row"), F.col("doc.c1").alias("text")), "passage-candidates")
    found = None
    for k in range(shards):
        sent = _sent(items, shards, k)

        def make(sent=sent):
            shard = Shard(sent.value, window)

            def work(texts: list[bytes | None]) -> list[pa.Array]:
                runs, own = [], []
                for t in texts:
                    words = words_of(t or b"")
                    hits, names = bytearray(len(words)), set()
                    shard.scan(words, hits, names)
                    runs.append([{"at": m.start(), "to": m.end()} for m in re.finditer(b"\1+", hits)])
                    own.append(sorted(names))
                return [pa.array(runs, pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32())]))), pa.array(own, pa.list_(pa.string()))]

            return work

        hit = with_report(may, "text", ["row"], make, "runs array<struct<at:int,to:int>>, items array<string>").where(F.size("runs") > 0)
        hit = written(hit.select(F.col("doc.c0").alias("row"), "runs", "items"), "passage-hits")
        found = hit if found is None else found.unionByName(hit)
        sent.unpersist()
    # Runs of all shards in order: what lies beyond the last end so far is new.
    step = lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["to"] - F.greatest(r["at"], acc["end"]))).alias("n"), F.greatest(r["to"], acc["end"]).alias("end"))
    union = F.aggregate(F.array_sort(F.flatten(F.collect_list("runs"))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))
    hits = found.groupBy("row").agg(union.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = written(hits, "passage-sums")
    joined = counted.join(F.broadcast(hits) if hits.count() <= SENT_HITS else hits.hint("merge"), "row", "left")
    return joined.select("doc", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """A struct ``doc`` of the columns ``keep``, and n_words, n_hit, items (ids sorted as strings), contaminated.

    A word is hit if it lies inside any occurrence of a window: ``window`` consecutive words of an item, or all words of a
    shorter one. A document is contaminated if at least a twentieth of its words, and at least one, is hit. Texts and
    items that are null or have no words are never hit; an empty benchmark hits nothing; very long texts are read whole.
    A null item id counts as the id "". Items of equal text all count. Rows, repeated ones too, stay as they are; no rows
    give no rows. ``keep`` may name columns of any name; other columns are ignored.
    """
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"), benchmark[item_text_col].cast("string").cast("binary").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    if shards == 1:
        found = _in_one_pass(docs, keep, text_col, items, window)
    else:
        found = _in_passes(docs, keep, text_col, written(items, "passages"), window, shards, size)
    return found.withColumn("contaminated", _is_contaminated(F.col("n_words"), F.col("n_hit")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns, whatever their names.

    Nulls, empty and very long texts, ties and repeated rows are treated as by ``contamination``.
    """
    return contamination(docs, benchmark, docs.columns, **options).where("not contaminated").select(*columns_of(docs.columns))
