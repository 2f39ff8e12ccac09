"""Table sinks: note and tag upserts, archive moves, embedding cache, drafts, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.session import cut_lineage


def upsert_tags(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tags by unique name: ids stay, a given vector replaces the old one, new names get the next ids.

    New ids are spread over partitions: name-hash buckets are numbered on their own and shifted by bucket totals.
    """
    given = incoming.groupBy("name").agg(F.min("vector").alias("new_vector"))
    known = existing.join(given, "name", "full_outer")
    old = known.filter("tag_id IS NOT NULL").select("tag_id", "name", F.coalesce("new_vector", "vector").alias("vector"))
    fresh = known.filter("tag_id IS NULL").select("name", F.col("new_vector").alias("vector")).withColumn("b", F.pmod(F.xxhash64("name"), F.lit(1024)))
    sizes = fresh.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    # at most 1024 rows meet in this window
    offsets = sizes.select("b", (F.sum("c").over(Window.orderBy("b")) - F.col("c")).alias("offset"))
    top = F.coalesce(existing.agg(F.max("tag_id").alias("m")).scalar(), F.lit(0))
    numbered = fresh.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("name"))).join(F.broadcast(offsets), "b").withColumn("top", top)
    return old.unionByName(numbered.select((F.col("top") + F.col("offset") + F.col("r")).cast("bigint").alias("tag_id"), "name", "vector"))


def tag_edges(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """(file_id, tag_id, position) from tag-name lists: positions start at 1, a repeated name keeps its first place."""
    rows = notes.select("file_id", F.posexplode("tags").alias("p", "name")).groupBy("file_id", "name").agg((F.min("p") + 1).alias("position"))
    return rows.join(tags.select("tag_id", "name"), "name").select("file_id", "tag_id", "position")


def upsert_notes(tables: dict[str, DataFrame], incoming: DataFrame) -> dict[str, DataFrame]:
    """New files, chunks, file_tags and tags after replacing notes by path.

    tables: files (file_id, path, bucket, checksum, updated_at), chunks (chunk_id, file_id, chunk_index, content, vector),
    file_tags, tags. incoming: file_id, path, bucket, checksum, updated_at, content, vector, tags (names). A path already
    stored keeps its file id. Tags that lose their last note through this rewrite are removed; older orphans stay.
    """
    files, chunks, edges, tags = (tables[k] for k in ("files", "chunks", "file_tags", "tags"))
    latest = incoming.groupBy("path").agg(F.max_by(F.struct(*[c for c in incoming.columns if c != "path"]), F.struct("updated_at", "file_id")).alias("n")).select("path", "n.*")
    known = files.select("path", F.col("file_id").alias("known_id"))
    notes = cut_lineage(latest.join(known, "path", "left").withColumn("file_id", F.coalesce("known_id", "file_id")).drop("known_id"), "upsert")
    touched = notes.select("file_id")
    new_tags = upsert_tags(tags, notes.select(F.explode("tags").alias("name")).withColumn("vector", F.lit(None).cast(tags.schema["vector"].dataType)))
    new_edges = tag_edges(notes, new_tags)
    kept_edges = edges.join(touched, "file_id", "left_anti")
    all_edges = kept_edges.unionByName(new_edges.select(*edges.columns))
    lost = edges.join(touched, "file_id", "left_semi").select("tag_id").distinct().join(all_edges.select("tag_id"), "tag_id", "left_anti")
    return {
        "files": files.join(touched, "file_id", "left_anti").unionByName(notes.select(*files.columns)),
        "chunks": chunks.join(touched, "file_id", "left_anti").unionByName(
            notes.select(F.col("file_id").alias("chunk_id"), "file_id", F.lit(0).alias("chunk_index"), "content", "vector").select(*chunks.columns)
        ),
        "file_tags": all_edges,
        "tags": new_tags.join(lost, "tag_id", "left_anti"),
    }


def write_touched_buckets(df: DataFrame, path: str, bucket: str = "bucket") -> None:
    """Rewrite only the bucket partitions present in the frame."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def archive_notes(tables: dict[str, DataFrame], retired: DataFrame, ledger: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(remaining tables with ledger, archive rows): retired notes (file_id) leave every table."""
    ids = retired.select("file_id").distinct()
    gone = tables["files"].join(ids, "file_id", "left_semi").join(tables["chunks"].select("file_id", "content"), "file_id", "left")
    rest = {k: tables[k].join(ids, "file_id", "left_anti") for k in ("files", "chunks", "file_tags")}
    return {**rest, "tags": tables["tags"], "ledger": ledger.join(ids, "file_id", "left_anti")}, gone


def update_note(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """Replace notes in place by file id: path and bucket stay, content and tags come from `changes`."""
    known = tables["files"].select("file_id", "path", "bucket")
    return upsert_notes(tables, changes.select("file_id", "checksum", "updated_at", "content", "vector", "tags").join(known, "file_id"))


def merge_notes(tables: dict[str, DataFrame], merged: DataFrame, sources: DataFrame, ledger: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write merged notes and archive their sources.

    merged is an upsert batch whose content already names its origins; sources (file_id, into_id). A source that is also
    the target (keep mode) is rewritten, not archived.
    """
    after = upsert_notes(tables, merged)
    retired = sources.filter("file_id <> into_id").select("file_id")
    return archive_notes(after, retired, ledger)


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """(vectors, additions): look texts up by hash and dimension, embed each distinct missing text once, in batches."""
    from tagloom.functions.text import text_hash

    hashed = texts.withColumn("sha", text_hash(F.col("text")))
    usable = cache.filter(F.size("vector") == dim).select("sha", "vector")
    misses = hashed.select("sha", "text").dropDuplicates(["sha"]).join(usable.select("sha"), "sha", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                piece = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"sha": piece["sha"], "vector": embed(piece["text"].tolist())})

    additions = cut_lineage(misses.mapInPandas(run, "sha string, vector array<float>"), "embedded")
    both = usable.unionByName(additions)
    return hashed.join(both, "sha").drop("sha"), additions


def pending_drafts(turns: DataFrame, owners: DataFrame, user_chars: int = 600, assistant_chars: int = 900) -> DataFrame:
    """Draft rows of collected turns in the bucket that owns their session."""
    return turns.join(owners, "session_id").select(
        F.sha2(F.concat_ws("|", "session_id", "turn"), 256).substr(1, 12).alias("draft_id"), "bucket", "session_id", "turn",
        F.substring("user_text", 1, user_chars).alias("user_text"), F.substring("assistant_text", 1, assistant_chars).alias("assistant_text"), "at",
    )


def append_drafts(drafts: DataFrame, path: str) -> None:
    drafts.write.mode("append").partitionBy("bucket").parquet(path)


def write_report(findings: DataFrame, path: str) -> None:
    """Findings replace the previous report, so repeated runs converge."""
    findings.write.mode("overwrite").parquet(path)


def write_baseline(summary: DataFrame, path: str) -> None:
    summary.withColumn("generated", F.current_timestamp()).write.mode("overwrite").json(path)


def read_baseline(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
