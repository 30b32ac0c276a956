"""Running totals and numbers of groups that may hold a third of all rows.

Rows are summed up by buckets first, small ranges of their order; only totals of buckets are put in order group by group.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slots of word hashes whose counts stand for the words' frequencies; the table is sent to all executors.
RARITY_SLOTS = 1 << 18


def rarest_first(sets: DataFrame, hashes: Column | None = None) -> Column:
    """The column ``hashes`` of ``sets``, or another one with such hashes, in one order of all, about by rarity: how often the
    words of a slot occur (a column ``df``, if there is one, says how often a row counts) is sent out as one byte for each slot,
    and equal ones go by hash."""
    slot = lambda h: F.pmod(h, F.lit(RARITY_SLOTS)).cast("int")
    n = F.sum("df") if "df" in sets.columns else F.count("*")
    often = sets.select(F.explode("hashes").alias("h"), *(["df"] if "df" in sets.columns else [])).groupBy(slot(F.col("h")).alias("slot")).agg(n.alias("df"))
    levels = bytearray(RARITY_SLOTS)  # of fixed size
    for r in often.collect():
        levels[r.slot] = min(255, int(12 * math.log(r.df)))
    return F.sort_array(F.transform(F.col("hashes") if hashes is None else hashes, lambda h: F.struct(F.substring(F.lit(bytes(levels)), slot(h) + 1, F.lit(1)).alias("level"), h.alias("h"))))["h"]


@contextlib.contextmanager
def where_dealt(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile joins tables that are dealt out by some of the join's keys as they lie."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bucketed(df: DataFrame, group: list[str], bucket: list[Column], size: Column) -> tuple[DataFrame, DataFrame, list[str]]:
    names = [f"__b{i}" for i in range(len(bucket))]
    d = df.withColumns(dict(zip(names, bucket))).withColumn("__size", size)
    sums = d.groupBy(*group, *names).agg(F.sum("__size").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy(*group).orderBy(*names).rowsBetween(W.unboundedPreceding, -1))
    return d, sums.withColumn("__before", F.coalesce(before, F.lit(0))), names


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[f"__o_{n}"]) for n in names])


def before_overflow(df: DataFrame, group: list[str], order: list, size: Column, limit: int, bucket: list[Column]) -> DataFrame:
    """Rows of each group, in order, up to the first one that makes the total exceed the limit, with ``used``.

    ``bucket`` has columns that rise with ``order``. Only rows of buckets that begin below the limit are sorted.
    """
    d, sums, names = _bucketed(df, group, bucket, size)
    keys = [*group, *names]
    near = sums.where(F.col("__before") <= limit).select(*[F.col(k).alias(f"__o_{k}") for k in keys])
    few = d.join(near.hint("merge"), _same(d, near, keys), "left_semi")
    used = F.sum("__size").over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return few.withColumn("used", used).where(F.col("used") <= limit).drop("__size", *names)


def numbered(df: DataFrame, group: list[str], order: list, bucket: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the number of each row within its group from 1: its number in its bucket and those before."""
    d, sums, names = _bucketed(df, group, bucket, F.lit(1))
    keys = [*group, *names]
    start = sums.select(*[F.col(k).alias(f"__o_{k}") for k in keys], "__before")
    own = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    n = d.withColumn("__own", own)
    found = n.join(start.hint("merge"), _same(n, start, keys))
    return found.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__size", "__before", *names, *[f"__o_{k}" for k in keys])
