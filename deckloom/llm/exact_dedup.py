"""Exact duplicates by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name, the block's rank in
the order of all distinct blocks; then adjacent names are paired and the pairs are named by their rank in the same way,
until each document has a single name. Blocks are ordered by their first bytes, then by a 128-bit key of the whole, so
ranks depend on the texts alone, not on how Spark deals them out. Two documents of equal depth share a name exactly when
their texts are equal: names come from comparing the blocks and pairs themselves, never from trusting a hash.

What is shuffled: each distinct block once (copies are combined before the shuffle), otherwise numbers. To bring a name
back to its rows a 128-bit key stands for the block. The key is proven free of collisions on the data at hand, since the
naming has seen all blocks with their keys; should two blocks ever share a key, the naming is done again with other seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, text_or_empty, without_space, written

#: Bytes of a block. Larger blocks mean fewer levels, smaller ones smaller rows.
BLOCK_BYTES = 8192
#: First bytes of a block by which blocks are ordered before their keys are looked at.
PREFIX_BYTES = 16
SEEDS = ((0, 1), (2, 3), (4, 5), (6, 7))


def _blocks(norm: Column, size: int, seeds: tuple[int, int]) -> Column:
    """Array of (k1, k2, block); an empty text has one empty block."""

    def one(n: Column, i: Column) -> Column:
        block = F.substring(n, i * size + 1, F.lit(size))
        return F.struct(F.xxhash64(F.lit(seeds[0]), block).alias("k1"), F.xxhash64(F.lit(seeds[1]), block).alias("k2"), block.alias("block"))

    last = lambda n: F.greatest(F.lit(0), F.ceil(F.octet_length(n) / size).cast("int") - 1)
    # The outer transform binds the text, so that it is normalised once and not for each block.
    return F.transform(F.array(norm), lambda n: F.transform(F.sequence(F.lit(0), last(n)), lambda i: one(n, i)))[0]


def _named_pairs(cur: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level: adjacent names become pairs, distinct pairs get names by their rank."""
    pairs = cur.groupBy("row_id", "n", F.shiftright("pos", 1).alias("pos")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left_name"),
        F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right_name"),
    )
    return pairs, ranked(pairs.select("left_name", "right_name").distinct(), ["left_name", "right_name"], "name", "pair-names")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, level, name.

    Texts are equal when identical after deleting white space (space, 0x09 to 0x0D). Of equal texts the row with the
    most code points in the original text stays, then the one with the smallest id (a null id comes last).
    ``(level, name)`` identifies the text. Nulls count as empty texts, which are all equal. If rows repeat with one id,
    each is a row of its own and one of them stays. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    norm = without_space(F.col("text")).cast("binary")
    for seeds in SEEDS:
        cut = _blocks(norm, block_bytes, seeds)
        distinct = base.select(F.inline(cut)).distinct()
        first = written(distinct.select(F.substring("block", 1, PREFIX_BYTES).alias("first"), "k1", "k2"), "blocks")
        named = ranked(first, ["first", "k1", "k2"], "name", "block-names").drop("first")
        if named.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seeds were free of collisions")
    keys = F.transform(cut, lambda b: F.struct(b["k1"].alias("k1"), b["k2"].alias("k2")))
    rows = written(
        base.select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2(norm, 256).alias("text_sha256"),
            keys.alias("keys"),
        ),
        "block-rows",
    )
    spread = rows.select("row_id", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).select("row_id", "n", F.col("pos").cast("long").alias("pos"), "key.k1", "key.k2")
    cur = spread.join(named.hint("merge"), ["k1", "k2"]).select("row_id", "n", "pos", "name")
    longest = rows.agg(F.max(F.size("keys"))).head()[0] or 1
    if longest > 1:
        cur = written(cur, "block-level")
    found = cur.where("n = 1").select("row_id", F.lit(0).alias("level"), "name")
    level = 0
    while longest > 1:
        level += 1
        pairs, names = _named_pairs(cur.where("n > 1"))
        cur = pairs.join(names.hint("merge"), ["left_name", "right_name"]).select("row_id", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "name")
        longest = (longest + 1) // 2
        if longest > 1:
            cur = written(cur, "block-level")
        found = found.unionByName(cur.where("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
    found = written(found.join(rows.select("row_id", "doc_id", "n_chars", "text_sha256").hint("merge"), "row_id"), "block-identity")
    best = found.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("best"),
    )
    best = written(best, "block-best")  # read back, so that a large group's rows can be split in the join
    return found.join(best.hint("merge"), ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256", "level", "name"
    )
