"""Fill-in-the-middle transformation as a pipeline of Arrow compute functions.

A batch's texts are split into lists of units, the lists flattened with the indices of their parents, each unit numbered
within its text, units filtered by their role (prefix, middle, suffix), the lists rebuilt and their pieces joined. No
function works on a single row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, those that stay plain, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: A unit in UTF-8: letters A-Z in a row, or one other character. A byte out of place is a unit of its own.
UNIT = rb"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*|[\x80-\xBF]"
#: A byte that UTF-8 never has.
CUT = b"\xff"


def draws(key: Column, seed: str = "1:") -> list[Column]:
    """Four numbers below 2**32 that depend on ``key`` alone: the beginning of a digest of ``seed`` and the key."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def as_text(data: pa.Array) -> pa.Array:
    """Bytes as a text; Spark's strings are taken as they are."""
    return pc.cast(data, options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))


def units(texts: pa.Array) -> pa.ListArray:
    """Lists of the units of each text."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\0" + CUT), CUT)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)  # what follows the last cut is empty
    return _lists(flat, parents, full, len(texts))


def _lists(flat: pa.Array, parents: pa.Array, mask: pa.Array, rows: int) -> pa.ListArray:
    """A list for each row of the entries under ``mask``, in their order."""
    counts = np.bincount(parents.filter(mask).to_numpy(zero_copy_only=False), minlength=rows)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat.filter(mask))


def cut(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The number of units of each text, and its prefix, middle and suffix."""
    lists = units(texts)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    first, last = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begins = pa.array(lists.offsets.to_numpy(zero_copy_only=False)[:-1].astype(np.int64))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), begins.take(parents))
    before, until = pc.less(ordinal, pa.array(first).take(parents)), pc.less(ordinal, pa.array(last).take(parents))
    masks = [before, pc.and_not(until, before), pc.invert(until)]
    return n, [pc.binary_join(_lists(flat, parents, m, len(texts)), b"") for m in masks]


def arranged(texts: pa.Array, h: list[np.ndarray]) -> pa.StructArray:
    """n, form, output, prefix_chars and middle_chars of a batch of texts (bytes, without nulls) and their four numbers."""
    n, (prefix, middle, suffix) = cut(texts, h[0], h[1])
    marked = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
    plain = pc.or_(marked, pa.array((n == 0) | (h[2] % 100 >= 100 - PLAIN)))
    late = pa.array(h[3] % 100 < SUFFIX_FIRST)
    nothing = b""
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, nothing)
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, nothing)
    form = pc.if_else(plain, "plain", pc.if_else(late, "spm", "psm"))
    output = pc.if_else(plain, texts, pc.if_else(late, spm, psm))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(as_text(p)).cast(pa.int64())) for p in (prefix, middle)]
    return pa.StructArray.from_arrays([pa.array(n), form, as_text(output), *chars], ["n", "form", "output", "prefix_chars", "middle_chars"])


def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that were arranged: a piece ends where the next mark begins, as no arranged text holds a mark."""
    late, plain = pc.equal(forms, "spm"), pc.equal(forms, "plain")
    parts = {}
    for name, first, second in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        # Texts of other forms may have any number of marks: they are left out before the splits.
        rest, found = pc.if_else(pc.equal(forms, name), outputs, first + second + MIDDLE), []
        for mark in (first, second, MIDDLE):
            halves = pc.split_pattern(rest, mark, max_splits=1)
            found.append(pc.list_element(halves, 0))
            rest = pc.list_element(halves, 1)
        parts[name] = found[1], found[2], rest
    psm, spm = parts["psm"], parts["spm"]
    back = pc.if_else(late, pc.binary_join_element_wise(spm[1], spm[2], spm[0], b""), pc.binary_join_element_wise(psm[0], psm[2], psm[1], b""))
    return pc.if_else(plain, outputs, back)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:") -> DataFrame:
    """``docs`` with ``fim``: n (units of the text), form (plain, psm or spm), output, prefix_chars and middle_chars.

    Where a text is cut and its form depend on its id and ``seed`` alone. Plain are empty texts, texts that hold a mark and
    a tenth of the others; of these the lengths of the pieces are null. A null text counts as empty, a null id as an empty
    one; rows of one id are cut at the same draws. Rows and repeats stay; no rows give no rows; a column named ``fim`` is
    replaced. Texts are taken whole; a task works on some megabytes of text at a time, and on a longer text by itself.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("n long, form string, output string, prefix_chars long, middle_chars long")
    def made(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        hs = [h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)]
        texts = pc.fill_null(text, b"")
        done = [arranged(texts.slice(at, rows), [h[at : at + rows] for h in hs]) for at, rows in pieces(texts)]
        return pa.concat_arrays(done) if done else arranged(texts, hs)

    return docs.withColumn("fim", made(docs[text_col].cast("string").cast("binary"), *draws(docs[id_col], seed)))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of, exactly; null counts as an empty plain text."""

    @F.arrow_udf("string")
    def made(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        outputs, forms = pc.fill_null(outputs, b""), pc.fill_null(forms, "plain")
        done = [rebuilt(outputs.slice(at, rows), forms.slice(at, rows)) for at, rows in pieces(outputs)]
        return as_text(pa.concat_arrays(done) if done else outputs)

    return made(output.cast("binary"), form)
