"""Vector compression to product codes, with equal-average search for the nearest codebook entry.

A vector is cut into equal parts, and each part is replaced by the index of the nearest entry of its position's codebook.
By the Cauchy-Schwarz inequality two parts of d components whose sums differ by g are at least g * g / d apart (squared).
So a codebook is sorted by its entries' sums, the search begins at a part's own sum, goes outward on both sides, and ends
once g * g / d strictly exceeds the best distance so far. Everything is whole numbers, so no result depends on the order of
work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SENT_KEYS, small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows from which a label's rows are joined by sending its total out: at most 1 / HOT_SHARE labels are as frequent.
HOT_SHARE = 0.001


def most(dim: int) -> int:
    """The largest component up to which squared distances of parts of ``dim`` components fit into 64 bits."""
    return (1 << 28) // dim


class Book:
    """A codebook for one position: entries in the order of their component sums, then of their indices."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(1)
        self.index = np.lexsort((np.arange(len(sums)), sums))
        self.sums, self.entries, self.dim = sums[self.index], entries[self.index], entries.shape[1]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each part the index of the nearest entry, the lowest of several, and the squared distance.

        All parts go outward in step; those whose search has ended leave.
        """
        far, k = np.int64(1) << 30, len(self.sums)
        sums = parts.sum(1)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        best, found = np.full(len(parts), (np.int64(1) << 60) // self.dim), np.full(len(parts), k)
        rows = np.arange(len(parts))
        while len(rows):
            s, lo, hi = sums[rows], low[rows], high[rows]
            down = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], far)
            up = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, far)
            gap = np.minimum(down, up)
            go = (gap < far) & (gap * gap <= best[rows] * self.dim)
            rows, lo, hi, left = rows[go], lo[go], hi[go], (down <= up)[go]
            at = np.where(left, lo, hi)
            low[rows], high[rows] = lo - left, hi + ~left
            apart = ((parts[rows] - self.entries[at]) ** 2).sum(1)
            index = self.index[at]
            nearer = (apart < best[rows]) | (apart == best[rows]) & (index < found[rows])
            best[rows[nearer]], found[rows[nearer]] = apart[nearer], index[nearer]
        return found, best


def assigned(vectors: np.ndarray, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of whole vectors, a column for each position, and their squared distances."""
    dim = vectors.shape[1] // len(books)
    found = [b.nearest(np.ascontiguousarray(vectors[:, p * dim : (p + 1) * dim])) for p, b in enumerate(books)]
    return np.stack([x[0] for x in found], 1), np.stack([x[1] for x in found], 1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def _part_sums(codes: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of the parts that it is nearest to.

    A task adds up its parts in a table of the size of the codebooks, so what is shuffled does not grow with its rows, and
    what reaches the driver is one row for each entry.
    """
    parts, entries, dim = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, dim), np.int64), np.zeros((parts, entries), np.int64)
        search = [Book(b) for b in books]
        for batch in batches:
            vectors = _matrix(batch.column(0), parts * dim)
            found, _ = assigned(vectors, search)
            for p in range(parts):
                counts[p] += np.bincount(found[:, p], minlength=entries)
                np.add.at(sums[p], found[:, p], vectors[:, p * dim : (p + 1) * dim])
        p, e = np.nonzero(counts)
        if len(p):
            made = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e])]
            yield pa.RecordBatch.from_arrays([*made, *(pa.array(sums[p, e, i]) for i in range(dim))], ["part", "entry", "n", *(f"s{i}" for i in range(dim))])

    partial = codes.select("ints").mapInArrow(run, "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(dim)))
    total = partial.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(dim)))])
    after = books.copy()
    for r in total.collect():  # at most parts * entries rows
        after[r[0], r[1]] = np.array(r[3:], np.int64) // r[2]
    return after


def _finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` without ``vector_col``, with ``codes`` (an index for each part) and ``error``; and the codebooks.

    Components are floor(256 * x). A position's codebook begins as that part of the ``entries`` rows with the smallest ids
    (null ids last, equal ids by their vectors) and is moved ``rounds`` times to the means of the parts nearest to each
    entry; entries that no part is nearest to stay. Ties go to the lower index. ``error`` is the sum of the squared
    distances of all parts.

    Rows go whose vector is null or holds a null, NaN or infinite component. The length of vectors is the most frequent one
    that divides into the parts, the shorter of two; rows of another length (empty vectors too), or with a component of
    which a squared distance would not fit into 64 bits, stay with null codes and error. Repeated rows count each. Fewer
    rows than ``entries`` give smaller codebooks; no rows give none. Other columns keep their names; ``codes`` and
    ``error`` are replaced.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    keep = [c for c in vectors.columns if c.lower() not in (vector_col.lower(), "codes", "error")]
    wide = vectors.filter(_finite(vectors[vector_col])).select(
        F.struct(*[vectors[c].alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), vectors[id_col].alias("id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE)).alias("ints"),
    )
    rows = written(wide, "vectors")
    sizes = rows.groupBy(F.size("ints").alias("dims")).count().filter((F.col("dims") > 0) & (F.col("dims") % parts == 0))
    found = sizes.orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = found[0].dims if found else parts
    bound = most(dims // parts)
    fits = (F.size("ints") == dims) & F.forall("ints", lambda x: (x >= -bound) & (x <= bound))
    fit = rows.filter(fits)
    first = fit.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()  # the first codebooks
    books = np.array([r.ints for r in first], np.int64).reshape(len(first), parts, dims // parts).swapaxes(0, 1)
    for _ in range(rounds if first else 0):
        books = _part_sums(fit, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        for batch in batches:
            good = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            codes, error = np.zeros((len(good), parts), np.int32), np.zeros(len(good), np.int64)
            if good.any():
                codes[good], apart = assigned(_matrix(batch.column(1).filter(pa.array(good)), dims), search)
                error[good] = apart.sum(1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), parts).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(error), pa.array(good)], ["row", "codes", "error", "fits"])

    asked = rows.select("row", "ints", fits.alias("fits"))
    done = asked.mapInArrow(run, f"row {asked.schema['row'].dataType.simpleString()}, codes array<int>, error long, fits boolean")
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)]
    return done.select(*own, F.when(F.col("fits"), F.col("codes")).alias("codes"), F.when(F.col("fits"), F.col("error")).alias("error")), books


def code_text(codes: Column) -> Column:
    """Two hex digits for each index."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")


def with_group_error(coded: DataFrame, label_col: str = "label", out_col: str = "label_error") -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of the same label; null labels are one group.

    Rows without a code add nothing; a group of such rows alone has none. Repeated rows count each, no rows give no rows, and
    ``out_col`` is replaced. Sums are made before the shuffle. Totals of up to a million labels are sent out; of more, those of the labels that hold
    a thousandth of all rows or more each are, and the other labels, which are small, are joined by sorting.
    """
    label = F.struct(F.col(label_col).isNull().alias("none"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("value"))
    row = F.struct(*[F.col(c) for c in coded.columns if c.lower() != out_col.lower()])
    done = written(coded.select(row.alias("row"), label.alias("label")), "codes")
    totals = written(done.groupBy("label").agg(F.sum("row.error").alias("total"), F.count(F.lit(1)).alias("rows")), "label-errors")
    n, rows = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if n <= SENT_KEYS:
        found = done.join(F.broadcast(totals), "label")
    else:
        hot = F.broadcast(totals.filter(F.col("rows") >= rows * HOT_SHARE))
        found = done.join(hot, "label").unionByName(done.join(hot.select("label"), "label", "left_anti").join(totals.hint("merge"), "label"))
    return found.select("row.*", F.col("total").alias(out_col))
