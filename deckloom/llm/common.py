"""Small helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that count as white space in these operators: space and 0x09 to 0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Bytes of a batch that Spark sends to a Python task, and of text that the task works on at a time; a longer text
#: stands alone.
BATCH_BYTES, PIECE_BYTES = 8 << 20, 4 << 20
#: Keys of 8 bytes that are sent to all executors at most.
SENT_KEYS = 1 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may do without the setting: it gets a new temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, its ids stay, lost executors cost nothing.

    Its size on disk is known to the planner, so automatic broadcasts of it rest on a measured size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """``df`` as a written table with ``name``, each row's place in the order of all rows, from 0.

    Rows are sorted in ranges; a range's places begin after the rows of all ranges before it. Equal rows apart, places
    depend on the rows alone and not on how they are dealt out. The driver sees one number for each range.
    """
    spark = df.sparkSession
    at = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), label)
    before, starts = 0, []
    for part, n in sorted((r[0], r[1]) for r in at.groupBy(F.shiftright("__at", 33)).count().collect()):
        starts.append((part, before - (part << 33)))
        before += n
    shift = F.broadcast(spark.createDataFrame(starts, "__part long, __shift long"))  # a row for each range
    return at.withColumn("__part", F.shiftright("__at", 33)).join(shift, "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def stays(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """``df`` left_semi or left_anti joined with ``keys``, a written table of one long column ``on``.

    Up to SENT_KEYS keys, counted first, are sent to the executors, so that the rows of ``df`` do not move; more are joined
    by sorting.
    """
    few = keys.count() <= SENT_KEYS
    return df.join(F.broadcast(keys) if few else keys.hint("merge"), on, how)


def without_space(text: Column) -> Column:
    for c in ASCII_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def text_or_empty(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, by default 64 MB, of which a task holds several copies."""
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", spark.conf.get(BATCH_SETTING, "64m").lower()).groups()
    now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    if now > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows): runs of rows with about PIECE_BYTES of text, so that what is made of them stays small as well."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(lengths) // PIECE_BYTES
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]).tolist()
    return ((a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def with_report(docs: DataFrame, text_col: str, keep: list[str], make: Callable[[], Callable[[list], list]], schema: str) -> DataFrame:
    """A struct ``doc`` of the columns ``keep``, and the columns of ``schema`` worked out from the whole text in one pass.

    ``make()`` is called once in each task and gives a function from a list of texts (bytes, or None) to one Arrow array
    for each column. Batches are bounded in bytes. The rows never move.
    """
    small_batches(docs.sparkSession)
    doc = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)]).alias("doc")
    asked = docs.select(doc, docs[text_col].cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for start, rows in pieces(b.column(1)):
                part = b.slice(start, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *work(part.column(1).to_pylist())], names)
            del b
            pa.default_memory_pool().release_unused()

    out = f"doc {asked.schema['doc'].dataType.simpleString()}, {schema}"
    names = ["doc", *[x.split()[0] for x in schema.split(", ")]]
    return asked.mapInArrow(run, out)


def columns_of(keep: list[str], only: list[str] | None = None) -> list[Column]:
    """The columns of ``doc`` under their own names."""
    return [F.col(f"doc.c{i}").alias(c) for i, c in enumerate(keep) if only is None or c in only]
