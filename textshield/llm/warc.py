"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256. Record headers are stored exactly as they are, apart from the
payloads, with the digest that joins them. Reading checks every stored payload against its digest and joins the
original records together again. WARC files can be taken in and put out.
"""

from __future__ import annotations

import gzip
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textshield import runtime
from textshield.llm import rows

#: Payloads from this size on are stored as a revisit where another record has them.
LEAST_SHARED = 100

RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _measured(pages: DataFrame, url: str, body: str, key: str) -> DataFrame:
    """Identifier, url, payload, its digest and size, and the locator of each row."""
    named = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"))
    return rows.with_locator(named, "locator").withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})


def _urn(page: Column) -> Column:
    """A record's identifier."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _header() -> Column:
    """A record's header as a column: name and value lines, ended by an empty line."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    again = F.col("record_type") == REVISIT
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(line("Content-Type", F.lit("text/html; charset=utf-8"))),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, folder: str, url: str = "url", body: str = "html", key: str = "page_id") -> str:
    """Store one record for each row: headers in folder/headers, each distinct payload once in folder/payloads.

    Of rows with equal payloads of LEAST_SHARED bytes or more, the one with the smallest identifier (null last; of
    repeated ones the first place) is a response and the others revisit it. A null body is empty, a null url has no
    line. Other columns are not stored. The payloads are written by one pass over the input without a shuffle, unless
    more copies exist than may be sent to the tasks.
    """
    runtime.prepare(pages.sparkSession)
    full = _measured(rows.settled(pages), url, body, key)
    slim = runtime.written(full.drop("payload"), "archive-slim")
    first = slim.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "locator")).alias("first"))
    typed = slim.join(first, "digest").withColumn("copy", F.col("locator") != F.col("first.locator"))
    typed = typed.withColumn("record_type", F.when(F.col("copy") & (F.col("bytes") >= LEAST_SHARED), REVISIT).otherwise(RESPONSE))
    typed = runtime.written(typed.withColumn("refers_to", F.when(F.col("record_type") == REVISIT, F.col("first.page_id"))).drop("first"), "archive-typed")
    typed.select(_header().alias("header"), "digest").write.parquet(f"{folder}/headers")
    copies = typed.where("copy").select(F.col("locator").alias("__copy"))
    stored = full.select("locator", "digest", "payload").join(runtime.if_small(copies), F.col("locator") == F.col("__copy"), "left_anti")
    stored.select("digest", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return folder


def archive_records(records: DataFrame, folder: str, header: str = "header", block: str = "block") -> str:
    """Store records that came from elsewhere (import_warc): their headers exactly, each distinct block once.

    Blocks are stored under their own SHA-256, whatever the header says of a digest. A null block is empty, repeated
    records stay, each with its header. Read back with read_archive; the folder may be one that write_archive filled.
    """
    runtime.prepare(records.sparkSession)
    full = rows.with_locator(rows.settled(records.select(F.col(header).alias("header"), F.coalesce(F.col(block), F.lit(b"")).alias("payload"))), "locator")
    slim = runtime.written(full.select("header", "locator", F.sha2("payload", 256).alias("digest")), "archive-records")
    slim.select("header", "digest").write.mode("append").parquet(f"{folder}/headers")
    there = records.sparkSession.createDataFrame([], "digest string")
    if runtime.exists(records.sparkSession, f"{folder}/payloads"):
        there = records.sparkSession.read.schema("digest string, payload binary").parquet(f"{folder}/payloads").select("digest")
    first = slim.groupBy("digest").agg(F.min("locator").alias("locator")).join(there, "digest", "left_anti")
    stored = full.join(runtime.if_small(runtime.written(first, "archive-first")), "locator")
    stored.select("digest", "payload").write.mode("append").option("compression", "zstd").parquet(f"{folder}/payloads")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: header, payload (a revisit's is that of its response), record_type, page_id, refers_to, digest.

    Repeated records come back as often as they were stored, an empty archive gives none, and a record from elsewhere has
    no page_id unless its identifier is of the form that write_archive gives. Fails if stored bytes do not have the digest
    that they are stored under.
    """
    kept = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    checked = kept.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")).alias("payload"))
    heads = spark.read.schema("header string, digest string").parquet(f"{folder}/headers")
    field = lambda name, what: F.nullif(F.regexp_extract("header", f"(?i)\r\n{name}:[ \t]*{what}[ \t]*\r\n", 1), F.lit(""))
    page = "<urn:page:(-?[0-9]*)>"
    parsed = heads.select(
        "header",
        "digest",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Record-ID", page).cast("long").alias("page_id"),
        field("WARC-Refers-To", page).cast("long").alias("refers_to"),
    )
    return parsed.join(checked, "digest")


def query(pages: DataFrame) -> DataFrame:
    """Write the archive to the shared folder, read it back, and measure what came back."""
    spark = pages.sparkSession
    back = read_archive(spark, write_archive(pages, runtime.shared_dir(spark, "archive")))
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


def export_warc(spark: SparkSession, folder: str, to: str) -> None:
    """Write an archive's records as (gzipped) WARC files, for payloads that are UTF-8 text: revisits have no block."""
    back = read_archive(spark, folder)
    block = F.when(F.col("record_type") == REVISIT, F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    back.select(F.concat("header", block).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(to)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*([0-9]+)[ \t]*\r\n", re.I)


def split_warc(content: bytes) -> list[tuple[str, bytes]]:
    """Header (with its empty line) and block of each record of a WARC file, which may be gzipped as a whole or by record."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    out, at = [], 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.index(b"\r\n\r\n", at) + 4
        n = _LENGTH.search(content, at, end)
        size = int(n[1]) if n else 0
        out.append((content[at:end].decode("utf-8", "replace"), content[end : end + size]))
        at = end + size
    return out


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (header, block) of WARC files; each file is read whole, so its size must fit a task."""
    runtime.prepare(spark)

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                found = split_warc(content)
                for at in range(0, len(found), 200):
                    part = found[at : at + 200]
                    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in part]), pa.array([b for _, b in part], pa.binary())], ["header", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, block binary")


ORACLE = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), r AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM r
"""
