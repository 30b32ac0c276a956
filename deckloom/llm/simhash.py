"""Near duplicates by SimHash fingerprints, compared bit-sliced.

Fingerprints are reduced to distinct values, so copies of any number cost one row. Two fingerprints with at most
``radius`` differing bits agree in all but ``radius`` of ``radius + 2`` bit blocks, hence in some pair of blocks: each
pair of blocks is a bucket key and no link is lost. Inside a bucket the fingerprints stand as 64 vertical bit planes; one
word of a plane holds a bit of 64 fingerprints, and a carry-save counter made of a few words counts 64 distances at once.
Word blocks whose 64 distances have all passed the radius are abandoned.

A bucket gives a spanning forest of its links, never all its pairs. Buckets with very many distinct fingerprints are
dealt out again: as their members differ in at most ``radius`` of the remaining bits, these are cut into ``radius + 1``
blocks, one of which agrees. With a radius of 2 about 21 bits are then open, so a bucket has at most 2 ** 22 values (32 MB).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stays, written
from .components import connected_components

RADIUS = 2
SHINGLE_WORDS = 3
#: Distinct fingerprints from which a bucket is dealt out by further bits.
HOT_BUCKET = 4096
#: Pairs of a fingerprint and a word of 64 others that are compared at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash over XXH64 (seed 42) of word shingles, repeats included; no words: 0."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 65536):  # a bounded piece of a very long text at a time
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[i : i + 65536], ends[i : i + 65536])), np.uint64, min(65536, n - i))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed long; a null text has no words."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def _masks(radius: int) -> list[int]:
    """Bit masks of the bucket keys: every pair of radius + 2 blocks of the 64 bits."""
    at = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(at, at[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _split(mask: int, parts: int) -> list[int]:
    """The bits that ``mask`` lacks, in ``parts`` blocks, each added to the mask."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in own) for own in np.array_split(rest, parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_within(fps: np.ndarray, sizes: np.ndarray, radius: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices of ``fps`` that belong to one group and differ in at most ``radius`` bits.

    ``fps`` holds the groups one after another, ``sizes`` their sizes. Each group starts a new word of the bit planes.
    """
    words = -(-sizes // 64)
    first, base = np.cumsum(sizes) - sizes, np.cumsum(words) - words
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(fps)) - first[group]
    lane = base[group] * 64 + place
    lanes = np.zeros(int(words.sum()) * 64, np.uint64)
    lanes[lane] = fps
    used = np.zeros(len(lanes), np.uint8)
    used[lane] = 1
    owner = np.zeros(len(lanes), np.int64)
    owner[lane] = np.arange(len(fps))
    used = np.packbits(used, bitorder="little").view(np.uint64)
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)
    counters = max(1, radius.bit_length())
    start = (1 << counters) - (radius + 1)  # radius + 1 steps overflow the counter
    todo = words[group] - place // 64  # the words from a fingerprint's own to its group's last
    upto = np.cumsum(todo)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, int(upto[-1]) if len(upto) else 0, chunk):
        n = np.arange(at, min(at + chunk, int(upto[-1])))
        query = np.searchsorted(upto, n, side="right")
        word = base[group[query]] + place[query] // 64 + (n - (upto[query] - todo[query]))
        own = fps[query]
        count = [np.full(len(n), ones if start >> k & 1 else 0, np.uint64) for k in range(counters)]
        over = ~used[word]
        for p in range(64):
            carry = planes[p][word] ^ (np.uint64(0) - (own >> np.uint64(p) & np.uint64(1)))
            for k in range(counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if p % 8 == 7 and len(word):
                live = over != ones
                if not live.all():
                    query, word, own, over = query[live], word[live], own[live], over[live]
                    count = [c[live] for c in count]
        hit, k = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(word) else (np.zeros(0, int),) * 2
        a, b = query[hit], owner[word[hit] * 64 + k]
        yield a[a < b], b[a < b]


def forest(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(members, roots): the links of every group as stars, of which a group of m members has at most m - 1."""
    root = np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links_within(fps, sizes, radius):
        new = root[a] != root[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(root)))
    return fps[other], fps[root[other]]


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3

        def out(kept: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            change = np.flatnonzero((np.diff(kept[0]) != 0) | (np.diff(kept[1]) != 0)) + 1
            sizes = np.diff(np.concatenate([[0], change, [len(kept[0])]]))
            u, v = forest(kept[2].view(np.uint64), sizes, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            cols = tuple(np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns))
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])) if len(cols[0]) else ()
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            rest = tuple(c[cut:] for c in cols)
            if cut:
                yield out(tuple(c[:cut] for c in cols))
        if len(rest[0]):
            yield out(rest)

    return run


def _in_buckets(keyed: DataFrame, radius: int) -> DataFrame:
    dealt = keyed.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_bucket_links(radius), "u long, v long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column fp, distinct) as far as pairs within ``radius`` bits do."""
    masks = _masks(radius)
    keys = F.inline(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks]))
    keyed = fps.select("fp", keys)
    counts = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(keyed.join(counts.hint("merge"), ["mask", "key"]), "buckets")
    finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in _split(m, radius + 1)]))])
    hot = buckets.where(F.col("n") > hot_bucket).select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))
    hot = hot.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).distinct()
    return _in_buckets(buckets.where(F.col("n") <= hot_bucket), radius).unionByName(_in_buckets(hot, radius)).distinct()


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for the distinct fingerprints of ``fps`` (column fp)."""
    distinct = written(fps.select("fp").distinct(), "distinct-fingerprints")
    parts = connected_components(fingerprint_links(distinct, radius))
    return distinct.join(parts.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits), component_id.

    ``component_id`` is the smallest id reachable over links of fingerprints with at most ``radius`` differing bits; null
    ids count for nothing there, so it is null only where all ids are. Words are runs of anything but space and 0x09 to
    0x0D after lower-casing A-Z; very long texts are read whole. A null or empty text has fingerprint 0 and links like any
    other. Repeated rows give repeated rows; other columns, whatever their names, are ignored; no rows give no rows.
    """
    own = written(fingerprints(docs, id_col, text_col), "fingerprints")
    lows = own.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = written(_components(own, radius).join(lows.hint("merge"), "fp"), "rooted-fingerprints")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    found = rooted.join(least.hint("merge"), "root").select("fp", "component_id")
    return own.join(found.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id, null after all others.

    Rows are told apart by themselves, not by their ids, which may repeat or be null; of rows with the smallest id one
    stays. Texts are treated as by ``simhash_components``. Columns of ``docs`` may have any names.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc")), "fingerprint-rows")
    at = {c: F.col(f"doc.c{i}") for i, c in enumerate(docs.columns)}
    own = fingerprints(rows.select("row", at[text_col].alias("text")), "row", "text").withColumnRenamed("doc_id", "row")
    own = written(own.join(rows.select("row", at[id_col].isNull().alias("none"), at[id_col].alias("id")).hint("merge"), "row"), "fingerprints")
    grouped = written(own.join(_components(own, radius).hint("merge"), "fp").select("root", "none", "id", "row"), "fingerprint-groups")
    best = written(grouped.groupBy("root").agg(F.min(F.struct("none", "id", "row")).alias("x")).select("root", F.col("x.row").alias("best")), "fingerprint-best")
    gone = written(grouped.join(best.hint("merge"), "root").where("row <> best").select("row"), "fingerprint-dropped")
    return stays(rows, gone, "row", "left_anti").select(*[c.alias(n) for n, c in at.items()])
