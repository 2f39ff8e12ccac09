"""WARC archives: writing, reading, and resolving repeated payloads into revisit records.

`archive_pages` writes one response record per page, `resolve_revisits` reads archives, shuffles only headers by payload
digest, and writes new archives in which every repeated payload is a revisit of the response with the smallest page_id
(ties: smallest record id). Revisits found in the input are pointed at that response too; one whose digest no response
carries keeps its old reference. All headers are written afresh.

Archives are gzip files below one folder, written and read by Spark alone, so the folder may be in any store. A record
ends with two line ends, which is the separator the text writer puts after each row.

Null payloads are empty. A null page_id sorts before all others; a null url leaves its header out; line ends in a url
are percent-encoded. Repeated rows are records of their own. Empty tables give an empty folder that reads as no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage, new_stage_path

RECORDS_PER_FILE = 10_000
EPOCH = "1970-01-01T00:00:00Z"
# Fixed values of the format.
END = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADER_SCHEMA = (
    "record_id string, record_type string, page_id bigint, url string, date string, "
    "payload_digest string, payload_bytes bigint, refers_to_record string"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(
    record_id: str, record_type: str, page_id, url: str | None, date: str | None, digest: str, size, payload: bytes, refers_to: str | None = None
) -> bytes:
    """One record without the two line ends after it; a revisit carries the HTTP head only."""
    block = HTTP_HEAD + (payload if record_type == "response" else b"")
    fields = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date or EPOCH),
        ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if record_type == "revisit" else None),
        ("WARC-Refers-To", refers_to and f"<{refers_to}>"),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", size),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + END + block


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, payload) of each record; lengths alone say where a record ends."""
    at = 0
    while at < len(data):
        stop = data.index(END + END, at)
        lines = data[at:stop].decode().split("\r\n")
        headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        start, size = stop + 4, int(headers["content-length"])
        block = data[start : start + size]
        yield headers, block[block.index(END + END) + 4 :]
        at = start + size + 4


def _write(records: DataFrame, path: str) -> None:
    """Bytes go through the text writer unchanged; its row separator closes each record."""
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


def archive_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                record_bytes(uuid.UUID(hex=r["key"]).urn, "response", r["page_id"], r["url"], EPOCH, payload_digest(r["payload"]), len(r["payload"]), r["payload"])
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    rows = pages.select(
        F.md5(F.concat_ws(" ", F.monotonically_increasing_id(), F.col(page_id), F.col(url))).alias("key"),
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    _write(rows.mapInArrow(build, "record binary"), path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record; with `payloads`, also the bytes of responses."""

    def bare(value: str | None) -> str | None:
        return value and value.strip("<>")

    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip([*(field.split()[0] for field in HEADER_SCHEMA.split(", ")), "payload"], types, strict=True)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for batch in batches for c in batch.column(0).to_pylist()):
            out = []
            for h, payload in parse_records(gzip.decompress(content)):
                is_response = h["warc-type"] == "response"
                page, size = h.get("x-page-id"), len(payload) if is_response else h.get("x-payload-length")
                digest = payload_digest(payload) if is_response else h["warc-payload-digest"].removeprefix("sha1:")
                out.append((
                    bare(h["warc-record-id"]), h["warc-type"], page and int(page), h.get("warc-target-uri"), h.get("warc-date"),
                    digest, size if size is None else int(size), bare(h.get("warc-refers-to")), payload if is_response and payloads else None,
                ))
            columns = [pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            table = pa.RecordBatch.from_arrays(columns, schema=schema)
            yield table if payloads else table.select(schema.names[:-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(rows, HEADER_SCHEMA + (", payload binary" if payloads else ""))


def resolve_revisits(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Write the records of `source` to `target`, payloads of at least `min_bytes` once each."""
    headers = read_archives(spark, source)
    responses = headers.filter((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    originals = responses.groupBy("payload_digest").agg(F.min(F.struct("page_id", "record_id")).alias("o")).select(
        "payload_digest", F.col("o.record_id").alias("original")
    )
    # Written, so that the side with a hot digest can be split in the join.
    originals = cut_lineage(originals, "warc-originals")
    decided = headers.join(originals, "payload_digest", "left").select(
        "record_id",
        F.when(F.col("original") != F.col("record_id"), F.col("original")).otherwise(F.col("refers_to_record")).alias("refers_to"),
    )
    records = read_archives(spark, source, payloads=True).drop("refers_to_record").join(decided, "record_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                record_bytes(
                    r["record_id"], "revisit" if r["refers_to"] else "response", r["page_id"], r["url"], r["date"],
                    r["payload_digest"], r["payload_bytes"], r["payload"] or b"", r["refers_to"],
                )
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    # Payloads of repeats stay behind.
    records = records.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    _write(records.mapInArrow(build, "record binary"), target)


@query(
    "op5_warc_revisits",
    """
    WITH p AS (
      SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
    ), h AS (
      SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p
    ), d AS (
      SELECT page_id, payload_bytes,
             list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (1 + (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)))::BIGINT, 1)), 'string_agg', '') AS payload_digest
      FROM h
    ), o AS (
      SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_page FROM d
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_page THEN first_page END AS refers_to
    FROM o
    """,
)
def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, resolved = new_stage_path(spark, "warc-raw"), new_stage_path(spark, "warc-resolved")
    archive_pages(table(spark, sf_dir, "pages"), raw)
    resolve_revisits(spark, raw, resolved)
    records = read_archives(spark, resolved)
    originals = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    return records.join(originals, "refers_to_record", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
