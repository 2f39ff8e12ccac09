"""Canonical tables (notes, chunks, tags, ordered tag edges) and scans over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.session import broadcast_if_fits


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def note_files(spark: SparkSession, folder: str, bucket: str | None = None) -> DataFrame:
    """One row per note; a bucket filter reaches the parquet scan."""
    files = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderpriority").alias("bucket"),
        F.col("o_orderdate").alias("updated_at"),
    )
    return files if bucket is None else files.filter(F.col("bucket") == bucket)


def first_lines(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """(file_id, tag_id, first_line): the distinct tags of a file and the first line of each; of some `files` (file_id) only, if given."""
    lines = read_table(spark, folder, "lineitem").withColumnsRenamed({"l_orderkey": "file_id", "l_partkey": "tag_id"})
    return (
        (lines if files is None else lines.join(broadcast_if_fits(files.select("file_id").distinct()), "file_id", "left_semi"))
        .groupBy("file_id", "tag_id")
        .agg(F.min("l_linenumber").alias("first_line"))
    )


def file_tags(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Ordered tag edges (file_id, tag_id, position), position 1-based; of some `files` only, if given.

    Repeats of a tag collapse to their first occurrence before anything is ranked, so a file of a
    million repeated rows ranks only its distinct tags.
    """
    order = Window.partitionBy("file_id").orderBy("first_line", "tag_id")
    return first_lines(spark, folder, files).select("file_id", "tag_id", F.row_number().over(order).alias("position"))


def tags(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("tag_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")
    )


def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id"), F.col("embedding").alias("vector"), F.col("label")
    )


def vector_scan(df: DataFrame, column: str = "vector", dim: int | None = None, bucket: str | None = None) -> DataFrame:
    """Usable vectors only: present, of the expected length, and not all zero."""
    keep = F.col(column).isNotNull()
    if dim is not None:
        keep &= F.size(column) == dim
    norm2 = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    out = df.filter(keep).filter(norm2 > 1e-24)
    return out if bucket is None else out.filter(F.col("bucket") == bucket)


def vector_count(spark: SparkSession, folder: str) -> int:
    return read_table(spark, folder, "embeddings").count()


def tag_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(tag_id, vec_id): tags share the vectors of the embeddings table cyclically."""
    n = vector_count(spark, folder)
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("tag_id"), (F.col("p_partkey") % n).alias("vec_id")
    )


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, file_id, bucket, vec_id): one chunk per note."""
    n = vector_count(spark, folder)
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("chunk_id"),
        F.col("o_orderkey").alias("file_id"),
        F.col("o_orderpriority").alias("bucket"),
        (F.col("o_orderkey") % n).alias("vec_id"),
    )


def text_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Text notes: documents with their source as bucket and one synthetic minute per id as clock."""
    return read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("bucket"),
        F.col("text").alias("content"),
        F.col("lang"),
        F.expr("timestampadd(MINUTE, cast(doc_id as int), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("updated_at"),
    )
