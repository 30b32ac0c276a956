"""The registered queries of these operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .common import table
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .fill_middle import fill_middle, restore
from .html_extract import html_extract
from .line_dedup import line_dedup
from .oracle import SQL as SQL
from .quality import quality_classifier
from .sentencepieces import sentencepiece_decode, sentencepiece_encode
from .simhash import simhash_components
from .toxicity import toxicity
from .url_filter import url_filter
from .vector_codes import code_text, vector_codes, with_group_error
from .warc import derivatives, responses


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern).drop("text")
    return bpe_decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derivatives(responses(table(spark, sf_dir, "pages")))
    return found.select("record_type", "record_id", "refers_to", "target_uri", "content_type", F.octet_length("block").cast("long").alias("content_length"), "block_digest", "payload_digest", "source_headers")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc.c0", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated").withColumnRenamed("c0", "doc_id")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select(F.col("page.c0").alias("page_id"), F.col("page.c1").alias("url"), "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    return sentencepiece_decode(encoded, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_xxhash64"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = with_group_error(coded)
    return found.select("vec_id", code_text(F.col("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_simhash": op6_simhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_html_extract": op9_html_extract,
    "op10_toxicity": op10_toxicity,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_fill_middle": op12_fill_middle,
    "op13_vector_codes": op13_vector_codes,
}
