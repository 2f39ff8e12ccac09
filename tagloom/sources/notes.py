"""Text-file sources: note folders and draft queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.sources.logs import WRITES


def scan_notes(spark: SparkSession, path: str, bucket: Column | None = None) -> DataFrame:
    """One row per text file: path, bucket (its folder unless given), body, title, ordered tags, file time and size."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("content"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_size").alias("size"),
    )
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    name = F.regexp_replace(F.try_element_at(F.split("path", "/"), F.lit(-1)), r"\.[a-z]+$", "")
    return files.select(
        "path",
        (bucket if bucket is not None else folder).alias("bucket"),
        "content",
        X.strip_tag_line(F.col("content")).alias("body"),
        F.coalesce(X.heading(F.col("content")), name).alias("title"),
        X.parse_last_tag_line(F.col("content")).alias("tags"),
        X.text_hash(F.col("content")).alias("checksum"),
        "mtime",
        "size",
    )


def newest_per_bucket(notes: DataFrame) -> DataFrame:
    """(bucket, path, tail): newest note of each bucket and its closing line."""
    newest = notes.groupBy("bucket").agg(F.max_by(F.struct("path", "content"), F.struct("mtime", "path")).alias("n"))
    return newest.select("bucket", "n.path", X.continuation_tail(F.col("n.content")).alias("tail"))


def last_write(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event").isin(*WRITES)).groupBy("bucket").agg(F.max("ts").alias("last_write_at"))


def draft_queue(spark: SparkSession, path: str) -> DataFrame:
    """Pending drafts: draft_id from the file name, header fields from `key: value` lines, then the texts."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))

    def header(key: str) -> Column:
        return F.regexp_extract("value", rf"(?m)^{key}:[ \t]*(.*)$", 1)

    def section(name: str) -> Column:
        return X.strip(F.regexp_extract("value", rf"(?s)## {name}\n(.*?)(?:\n## |\z)", 1))

    return raw.select(
        F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("draft_id"),
        header("bucket").alias("bucket"),
        header("session").alias("session_id"),
        header("turn").cast("int").alias("turn"),
        header("at").cast("timestamp").alias("at"),
        section("user").alias("user_text"),
        section("assistant").alias("assistant_text"),
    )


def match_drafts(requests: DataFrame, drafts: DataFrame) -> DataFrame:
    """(request, draft_id, status): requests name a draft by any part of its id; several hits are ambiguous."""
    from tagloom.operators.joins import find_by_substring

    found = find_by_substring(requests.withColumnRenamed("request", "needle"), drafts.select(F.col("draft_id").alias("title")))
    return found.select(F.col("needle").alias("request"), F.col("title").alias("draft_id"), "status")
