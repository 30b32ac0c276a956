"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

Equal sets are reduced to one, which carries a SimHash fingerprint of its shingles. MinHash bands say which sets may be near:
a pair at the threshold shares none of the ``BANDS`` bands with a chance of (1 - 0.8 ** ROWS) ** BANDS = 0.00007, a closer pair
with less. Sets that bands connect, directly or by others, are a cluster. The sets of a cluster go to one task, each once;
there fingerprints are compared bit-sliced, as in ``simhash``, within ``RADIUS`` bits (two sets at the threshold differ in 10
bits on average, unlike ones in 32), and pairs that are left and not yet connected are checked on their sets. So a link is
never false, and a task hands on a spanning forest of its links, never all its pairs. A cluster that is too large for a task is
dealt out in parts, and each part meets each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_KEYS, small_batches, stays, written
from .components import connected_components
from .simhash import links_within

SHINGLE_WORDS = 5
#: The similarity from which texts are near copies, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 5
#: Bits in which the fingerprints of near copies may differ.
RADIUS = 24
#: Rows, and bytes of their sets, of a part of a cluster.
PART_ROWS, PART_BYTES = 1 << 14, 32 << 20
_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Shingles whose values under all hash functions are held at a time.
PIECE = 1 << 12


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of word shingles; a shorter text is one shingle, a text without words has none."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts)))


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band, made of ROWS minima."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), PIECE):
        low = np.minimum(low, (own[i : i + PIECE, None] * FACTORS + TERMS).min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is 1 if more than half of the shingles have it."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(own), PIECE):
        total += np.unpackbits(own[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(own), bitorder="little").view(np.int64)[0])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for b in batches:
        yield b.column(0), [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "digest", "fp", "keys"]
    for row, sets in _each(batches):
        keys = [bands(s).view(np.int64) if len(s) else [] for s in sets]
        digests, fps = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array([fingerprint(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([row, digests, fps, pa.array(keys, pa.list_(pa.int64()))], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"").tobytes() for t in b.column(3)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own, pa.binary())], ["row", "cluster", "fp", "own"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    few, most = sorted((len(a), len(b)))
    if few * LEAST[1] < most * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (few + most - both) * LEAST[0]


def forest(sizes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of similar sets that connect each group as far as all its links do; groups stand one after another."""
    root, links = np.arange(len(fps)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links_within(fps.view(np.uint64), sizes, RADIUS):
        open_ = root[a] != root[b]
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            u, v = find(x), find(y)
            if u != v and similar(sets[x], sets[y]):
                root[max(u, v)] = min(u, v)
                links.append((x, y))
        while (root[root] != root).any():
            root = root[root]
    return links


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (cluster, p, q, row, fp, own) that stand next to each other with the same first three columns."""
    numbers, sets = [np.zeros(0, np.int64)] * 5, []

    def out(cols: list[np.ndarray], own: list[np.ndarray]) -> pa.RecordBatch:
        change = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:3]], axis=0)) + 1
        links = forest(np.diff(np.concatenate([[0], change, [len(own)]])), cols[4], own)
        u, v = cols[3][[x for x, _ in links]], cols[3][[y for _, y in links]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    for batch in batches:
        numbers = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(numbers, batch.columns[:5])]
        sets += [np.frombuffer(s.as_buffer().to_pybytes(), np.uint64) for s in batch.column(5)]
        other = np.flatnonzero(np.any([c != c[-1] for c in numbers[:3]], axis=0)) if sets else ()
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if cut:
            yield out([c[:cut] for c in numbers], sets[:cut])
            numbers, sets = [c[cut:] for c in numbers], sets[cut:]
    if sets:
        yield out(numbers, sets)


def _links(texts: DataFrame, clusters: DataFrame, part_rows: int) -> DataFrame:
    """Links (u, v) between the near copies among rows (row, cluster, fp) with their texts (row, text)."""
    asked = texts.select("row", "text").join(clusters.hint("merge"), "row") if clusters.count() > SENT_KEYS else texts.select("row", "text").join(F.broadcast(clusters), "row")
    sets = written(asked.select("row", "cluster", "fp", "text").mapInArrow(_sets, "row long, cluster long, fp long, own binary"), "sets")
    totals = sets.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("own")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / part_rows, F.col("bytes") / PART_BYTES)).cast("int")
    large = written(totals.select("cluster", parts.alias("parts")).where("parts > 1"), "large-clusters")  # one for many thousand rows or many megabytes
    dealt = sets.join(F.broadcast(large), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own_part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cluster", F.least("own_part", "other").cast("long").alias("p"), F.greatest("own_part", "other").cast("long").alias("q"), "row", "fp", "own")
    grouped = dealt.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
    return written(grouped.mapInArrow(_compared, "u long, v long"), "near-links")


def near_copy_groups(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(row, group) for every row of ``rows`` (row, text); ``group`` is a row of the same group of near copies."""
    small_batches(rows.sparkSession)
    texts = rows.select("row", F.col("text").cast("string").cast("binary").alias("text"))
    own = written(texts.mapInArrow(_signed, "row long, digest binary, fp long, keys array<long>"), "signatures")
    first = written(own.groupBy("digest").agg(F.min(F.struct("row", "fp", "keys")).alias("x")).select("digest", "x.row", "x.fp", "x.keys"), "distinct-sets")
    keyed = first.select("row", F.posexplode("keys").alias("band", "key"))
    lowest = written(keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("row").alias("low")).where("n > 1"), "buckets")
    edges = keyed.join(lowest.hint("merge"), ["band", "key"]).where("row <> low").select(F.col("low").alias("u"), F.col("row").alias("v"))
    clusters = connected_components(edges).withColumnsRenamed({"node": "row", "root": "cluster"})
    clusters = written(clusters.join(first.select("row", "fp").hint("merge"), "row"), "clusters")
    found = connected_components(_links(texts, clusters, part_rows)).withColumnRenamed("node", "row")
    grouped = first.join(found.hint("merge"), "row", "left").select("digest", F.coalesce("root", "row").alias("group"))
    return own.select("row", "digest").join(grouped.hint("merge"), "digest").select("row", "group")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies: the one with the smallest id, null after all others.

    Groups are the components of the links between near copies. Words are runs of anything but space and 0x09 to 0x0D
    after lower-casing A-Z; texts of any length are read whole. Texts without words, null ones too, are copies of each
    other. Rows are told apart by themselves, not by their ids, which may repeat or be null. Other columns stay as they
    are, whatever their names. Without rows there is none to return.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("doc")), "near-rows")
    at = {c: F.col(f"doc.c{i}") for i, c in enumerate(docs.columns)}
    groups = near_copy_groups(rows.select("row", at[text_col].alias("text")))
    ids = rows.select("row", at[id_col].isNull().alias("none"), at[id_col].alias("id"))
    known = written(groups.join(ids.hint("merge"), "row"), "near-groups")
    best = written(known.groupBy("group").agg(F.min(F.struct("none", "id", "row")).alias("x")).select("group", F.col("x.row").alias("best")), "near-best")
    gone = written(known.join(best.hint("merge"), "group").where("row <> best").select("row"), "near-dropped")
    return stays(rows, gone, "row", "left_anti").select(*[c.alias(n) for n, c in at.items()])
