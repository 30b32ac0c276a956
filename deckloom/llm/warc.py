"""WARC records and their derivatives.

From each response record come a metadata record and a plain-text conversion record. Both name the response by
WARC-Refers-To and keep its target and date; the metadata carry the source's HTTP headers, the payload digest and the
outgoing links' number, the conversion its own digest and that of its source. All is done by column functions.

Records are rows until they are written, one after another in each partition's file, so that files of any number are
written and read in parallel; a file is read by one task, record by record, each as long as its Content-Length says. Digests
are labelled SHA-256; identifiers are UUIDs made from all that a record says, so that repeated runs agree.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
EOL = "\r\n"
#: Taken out before tags are: elements without text, then comments.
NO_TEXT = (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->")
#: Bytes of records that the reader hands on at a time, and records of a file that is written.
BATCH_BYTES, FILE_RECORDS = 4 << 20, 20000
FIELDS = ("record_type", "record_id", "refers_to", "target_uri", "record_date", "content_type", "block_digest", "payload_digest", "block")


def uuid_of(*parts: Column) -> Column:
    """An identifier of the parts, each told from the next by its length."""
    h = F.md5(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def unescaped(text: Column) -> Column:
    """Text with all character references decoded; only texts that have any go through Python."""
    decode = F.udf(lambda x: x if x is None else html.unescape(x), "string", useArrow=True)
    return F.when(F.contains(text, F.lit("&")), decode(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


def bare_text(source: Column) -> Column:
    """HTML without markup; references stand as they are."""
    for pattern in NO_TEXT:
        source = F.regexp_replace(source, pattern, " ")
    return F.regexp_replace(source, r"<[^>]*>", " ")


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\x0B\f]+", " "))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each page, its block the HTTP message.

    Null columns count as empty texts; very long pages are taken whole. Pages that differ in id, URL or HTML have different
    identifiers, repeated rows the same. Other columns are ignored; no rows give none.
    """
    url, html = F.coalesce(pages[url_col].cast("string"), F.lit("")), F.coalesce(pages[html_col].cast("string"), F.lit(""))
    own = pages.select(F.coalesce(pages[id_col].cast("string"), F.lit("")).alias("id"), url.alias("target_uri"), html.alias("payload"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(EOL + EOL))
    return own.select(
        F.lit("response").alias("record_type"),
        uuid_of(F.lit("response"), F.col("id"), F.col("target_uri"), F.sha2(F.col("payload").cast("binary"), 256)).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        "target_uri",
        F.lit(date).alias("record_date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        digest(F.concat(head, "payload")).alias("block_digest"),
        digest(F.col("payload")).alias("payload_digest"),
        F.concat(head, "payload").alias("block"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response of ``records`` (columns FIELDS); other types give none.

    Without an empty line in its block a response is all headers and has an empty payload. A missing payload digest is
    worked out. Nulls count as empty; very long records are taken whole. Repeated records give repeated derivatives with
    the same identifiers. Other columns are ignored; no rows give none.
    """
    own = records.where(records["record_type"] == "response").select(*FIELDS)
    block = F.coalesce("block", F.lit(""))
    cut = F.instr(block, EOL + EOL)
    own = own.withColumn("http_headers", F.when(cut > 0, F.substring(block, F.lit(1), cut - 1)).otherwise(block)).withColumn("payload", F.when(cut > 0, F.substring(block, cut + 4, F.length(block))).otherwise(""))
    own = own.withColumn("payload_digest", F.coalesce("payload_digest", digest(F.col("payload"))))
    links = F.regexp_count("payload", F.lit(r"(?i)<a\s[^>]*href"))
    fields = F.concat(
        F.lit("source-payload-digest: "), "payload_digest", F.lit(f"{EOL}source-block-digest: "), F.coalesce("block_digest", digest(block)), F.lit(f"{EOL}outlinks: "), links.cast("string"), F.lit(f"{EOL}source-http: "),
        F.replace("http_headers", F.lit(EOL), F.lit(f"{EOL}source-http: ")), F.lit(EOL),
    )
    own = own.select("record_id", "target_uri", "record_date", "payload_digest", "http_headers", fields.alias("fields"), unescaped(bare_text(F.col("payload"))).alias("plain"))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), F.col("fields").alias("out")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), one_spaced(F.col("plain")).alias("out")),
    )
    source = F.struct("record_id", "target_uri", "record_date", "payload_digest", "http_headers").alias("source")
    each = own.select(source, F.inline(kinds))
    return each.select(
        F.col("kind").alias("record_type"),
        uuid_of(F.col("kind"), F.col("source.record_id")).alias("record_id"),
        F.col("source.record_id").alias("refers_to"),
        F.col("source.target_uri").alias("target_uri"),
        F.col("source.record_date").alias("record_date"),
        "content_type",
        digest(F.col("out")).alias("block_digest"),
        F.col("source.payload_digest").alias("payload_digest"),
        F.col("out").alias("block"),
        F.col("source.http_headers").alias("source_headers"),
    )


def _safe(value: Column, uri: bool = False) -> Column:
    """A header value on one line: line ends are percent-encoded in a URI, spaces elsewhere."""
    for sign, code in (("\r", "%0D"), ("\n", "%0A")):
        value = F.replace(value, F.lit(sign), F.lit(code if uri else " "))
    return value


def record_text(records: DataFrame) -> DataFrame:
    """(value): each record as it stands in a file, without the last line end."""

    def header(name: str, value: Column, uri: bool = False) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), _safe(value, uri), F.lit(EOL))).otherwise("")

    block = F.coalesce("block", F.lit(""))
    lines = [
        header("WARC-Type", F.col("record_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Refers-To", F.col("refers_to")), header("WARC-Target-URI", F.col("target_uri"), True),
        header("WARC-Date", F.col("record_date")), header("WARC-Block-Digest", F.col("block_digest")), header("WARC-Payload-Digest", F.col("payload_digest")), header("Content-Type", F.col("content_type")),
    ]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL))
    return records.select(F.concat(F.lit(VERSION + EOL), *lines, size, block, F.lit(EOL)).alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip", file_records: int = FILE_RECORDS) -> None:
    """WARC files of at most ``file_records`` records, at least one for each partition.

    Nulls count as absent headers and empty blocks. Values that hold line ends cannot add headers: line ends are
    percent-encoded in the target and become spaces elsewhere. Other columns are ignored; no rows give a file without
    records.
    """
    record_text(records).write.option("maxRecordsPerFile", file_records).text(path, compression=compression, lineSep=EOL)


def _records(stream) -> Iterator[tuple]:
    """The records of an open file: FIELDS, the block as bytes. A broken head or a short block ends the file."""
    names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-block-digest", "warc-payload-digest")
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                return
            continue  # empty lines between records
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            head.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
        if not head.get("content-length", "").isdigit():
            return
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            return
        yield *(head.get(n) or None for n in names), block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows)]
        columns[6] = [d or "sha256:" + hashlib.sha256(b).hexdigest() for d, b in zip(columns[6], columns[8])]
        columns[8] = [b.decode("utf-8", "replace") for b in columns[8]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], list(FIELDS))

    for batch in batches:
        for content in batch.column(0):
            raw = io.BytesIO(content.as_buffer())
            rows, size = [], 0
            for r in _records(gzip.GzipFile(fileobj=raw) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else raw):
                rows.append(r)
                size += len(r[-1])
                if size >= BATCH_BYTES:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, gzipped or not, with the columns FIELDS.

    A record is as long as its Content-Length, whatever its payload holds. A missing block digest is worked out from the
    block's bytes; bytes that are no UTF-8 are replaced in ``block`` only. What follows a record that is cut off or has no
    length is not read. A task holds one file in memory, so files should have at most some hundred megabytes.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, ", ".join(f"{f} string" for f in FIELDS))
