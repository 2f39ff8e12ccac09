"""Event-time aggregates over log and usage streams. All functions also run on static frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tagloom.operators.ledger import regime
from tagloom.session import new_stage_path


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A parquet table read as a stream of files; the table is one file or a folder of files."""
    path = f"{folder}/{table}.parquet"
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(stored.schema)
    if any(f.endswith(f"/{table}.parquet") for f in stored.inputFiles()):
        return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return stream.parquet(path)


def drain(stream: DataFrame, label: str, mode: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[dict]]:
    """Run a stream over everything available into the shared folder: rows with their batch number, and the progress.

    Each batch overwrites its own folder, so a repeated batch after a failure leaves no second copy.
    """
    spark = stream.sparkSession
    out, check = new_stage_path(spark, label), new_stage_path(spark, f"{label}-state")

    def write(batch: DataFrame, number: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    job = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    job.awaitTermination()
    if job.exception():
        raise job.exception()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(out), job.recentProgress


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key of an update-mode result."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


def dropped_by_watermark(progress: list[dict]) -> int:
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p["stateOperators"])


def event_counts(events: DataFrame, keys: list[str], time: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and value sums per key and tumbling or sliding window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), *keys, "n", "total"
    )


def activity_sessions(events: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of activity per key, closed by a gap. Append mode on a stream; complete mode only for short runs."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n"
    )


def omega_histogram(samples: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Five-bin histogram and regime counts of observability samples per bucket and window."""
    cell = F.least(F.lit(4), F.floor(F.col("omega") / 0.2))
    g = samples.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "bucket")
    return g.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(cell == i).alias(f"bin{i}") for i in range(5)], *[F.count_if(regime(F.col("omega")) == r).alias(r) for r in ("collapsed", "sparse", "dense")]
    ).select(F.col("w.start").alias("start"), "bucket", "n", *[f"bin{i}" for i in range(5)], "collapsed", "sparse", "dense")


def usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Usage ledger rows from (bucket, event_id, file_id, kind, at); repeated deliveries inside the watermark count once."""
    once = events.withWatermark("at", late)
    once = once.dropDuplicatesWithinWatermark(["event_id", "file_id", "kind"]) if events.isStreaming else once.dropDuplicates(["event_id", "file_id", "kind"])
    passive, active = F.col("kind") == "passive", F.col("kind") == "active"
    return once.groupBy("bucket", "file_id").agg(
        F.count_if(passive).alias("passive"), F.count_if(active).alias("active"),
        F.max(F.when(passive, F.col("at"))).alias("last_passive_at"), F.max(F.when(active, F.col("at"))).alias("last_active_at"),
    )


def merge_ledger(current: DataFrame, update: DataFrame) -> DataFrame:
    """Ledger after one update-mode batch: updated rows replace the stored ones."""
    return current.join(update.select("bucket", "file_id"), ["bucket", "file_id"], "left_anti").unionByName(update.select(*current.columns))


def substantive_turns(messages: DataFrame, minimum: int = 400, late: str = "1 day") -> DataFrame:
    """Turns worth a draft: a long enough assistant report and no note written in the turn.

    Input (session_id, turn, at, role, text, wrote). One state row per open turn and day.
    """
    role, text = F.col("role"), F.col("text")
    g = messages.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "session_id", "turn")
    t = g.agg(
        F.max_by(text, F.when(role == "user", F.length(text))).alias("user_text"), F.max_by(text, F.when(role == "assistant", F.length(text))).alias("assistant_text"),
        F.max("at").alias("at"), F.bool_or("wrote").alias("wrote"),
    )
    return t.filter((F.length("assistant_text") >= minimum) & ~F.col("wrote")).select("session_id", "turn", "at", "user_text", "assistant_text")
