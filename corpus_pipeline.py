"""A corpus from raw documents to token ids, stage by stage; each stage is written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm.bpe import bpe_encode
from deckloom.llm.common import table, written
from deckloom.llm.decontaminate import decontaminate
from deckloom.llm.line_dedup import line_dedup, shared_lines
from deckloom.llm.near_copies import drop_near_copies
from deckloom.llm.quality import keep_good

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


# All stages: a null text counts as empty, texts are read whole whatever their length, rows are told apart by themselves, so
# ids may repeat or be null; columns keep their names and values, whatever the names; no rows give no rows.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject.

    Texts of fewer than five words, null and empty ones too, get the share of good documents as their score; a score of
    exactly 0.5 stays. Repeated rows go or stay together.
    """
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; n_chars follows the text.

    A null text stays null, a text may become empty. A line on exactly the least number of sites goes. Repeated rows stay
    and count once.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = line_dedup(plain, at["text"], at["source"], rule=shared_lines).select(*[F.col(x).alias(c) for c, x in at.items()])
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, Jaccard similarity of at least 0.8.

    Of a group the smallest id stays, null after all others, and one row of it. Texts without words, null ones too, are
    copies of each other.
    """
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination.

    Null and empty texts and an empty benchmark hit nothing; a document of which exactly a twentieth is hit goes.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the digest of the decoded bytes; a null or empty text has no ids."""
    found = bpe_encode(docs, RANKS, PATTERN, decoded_col="decoded")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontaminate", benchmark), ("bpe", tokens)]

#: The first stage's model can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
