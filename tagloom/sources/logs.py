"""Log-line and session-event sources. Each parser takes rows with a `value` column, from files or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: line layouts
LINE = r"^\[([\dT:.\-]+)Z\] \[(\w+)\] ([^ ]+)(.*)$"
GATE = r"gate=\{([^}]*)\}"
# fixed values: events that stand for a write
WRITES = ("memo_write", "note-write")

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("time", T.LongType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("source", T.StructType([T.StructField("kind", T.StringType())])),
                    T.StructField("content", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))),
                    T.StructField("name", T.StringType()),
                    T.StructField("callId", T.StringType()),
                    T.StructField("arguments", T.StringType()),
                    T.StructField("isError", T.BooleanType()),
                    T.StructField("message", T.StructType([T.StructField("content", T.ArrayType(T.StructType([T.StructField("toolCallId", T.StringType()), T.StructField("isError", T.BooleanType())])))])),
                ]
            ),
        ),
    ]
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def parse_log(lines: DataFrame) -> DataFrame:
    """ts, level, event, key=value fields as a map, reason, ids, gate flag, elapsed time and session; other lines drop out."""
    hit = lines.filter(F.col("value").rlike(LINE)).select(
        *[c for c in lines.columns if c != "value"],
        *[F.regexp_extract("value", LINE, i).alias(n) for i, n in enumerate(("ts", "level", "event", "rest"), 1)],
    )
    fields = F.str_to_map(F.trim(F.regexp_replace("rest", GATE, "")), F.lit(" "), F.lit("="))
    kept = F.map_filter(fields, lambda k, v: v.isNotNull() & (F.length(k) > 0))
    parsed = hit.withColumns({"ts": F.to_timestamp_ntz(F.col("ts")), "fields": kept, "gate": F.regexp_extract("rest", GATE, 1)})
    f = F.col("fields")
    return parsed.select(
        *[c for c in lines.columns if c != "value"],
        "ts", "level", "event", "fields",
        f["reason"].alias("reason"),
        F.filter(F.split(F.coalesce(f["ids"], F.lit("")), ","), lambda x: F.length(x) > 0).alias("ids"),
        F.contains("gate", F.lit("passed:true")).alias("gate_passed"),
        f["elapsedMs"].try_cast("bigint").alias("elapsed_ms"),
        f["omega"].try_cast("double").alias("omega"),
        f["session"].alias("session"),
    )


def parse_health(lines: DataFrame) -> DataFrame:
    """Health snapshots: ts, round, components, hub name and share, mean observability, uncovered and used counts."""
    def at(pattern, i=1):
        return F.regexp_extract("value", pattern, i)

    return lines.filter(F.col("value").rlike(r"^\[[^\]]+\] round=\d+")).select(
        *[c for c in lines.columns if c != "value"],
        F.to_timestamp_ntz(at(r"^\[([\dT:.\-]+)Z?\]")).alias("ts"),
        at(r"round=(\d+)").try_cast("bigint").alias("round"),
        at(r"components=(\d+)").try_cast("bigint").alias("components"),
        F.nullif(at(r"hub=([^: ]+):"), F.lit("")).alias("hub"),
        at(r"hub=[^: ]+:(\d+)/").try_cast("bigint").alias("hub_files"),
        at(r"hub=[^: ]+:\d+/(\d+)").try_cast("bigint").alias("files"),
        at(r"omegaMean=([\d.]+)").try_cast("double").alias("omega_mean"),
        at(r"uncovered=(\d+)/").try_cast("bigint").alias("never_recalled"),
        at(r"used=(\d+)/").try_cast("bigint").alias("used"),
    )


def latest_health(snapshots: DataFrame, until) -> DataFrame:
    """Last snapshot per bucket at or before the cutoff."""
    cols = [c for c in snapshots.columns if c not in ("bucket",)]
    return snapshots.filter(F.col("ts") <= until).groupBy("bucket").agg(F.max_by(F.struct(*cols), F.struct("ts", "round")).alias("s")).select("bucket", "s.*")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session events from JSON lines; the session is the file name."""
    raw = spark.read.schema(SESSION_SCHEMA).json(path)
    return flatten_session(raw.withColumn("session_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl?$", 1)))


def stream_sessions(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.readStream.schema(SESSION_SCHEMA).json(path)
    return flatten_session(raw.withColumn("session_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl?$", 1)))


def parse_sessions(lines: DataFrame) -> DataFrame:
    """Same rows from a `value` column of JSON text."""
    parsed = lines.withColumn("e", F.from_json("value", SESSION_SCHEMA))
    return flatten_session(parsed.select("session_id", "e.*"))


def flatten_session(raw: DataFrame) -> DataFrame:
    texts = F.transform(F.coalesce("data.content", F.array()), lambda c: F.coalesce(c["text"], F.lit("")))
    # A result names its call in the first block of its message that has one.
    answer = F.try_element_at(F.filter("data.message.content", lambda c: c["toolCallId"].isNotNull()), F.lit(1))
    return raw.select(
        "session_id",
        "type",
        F.timestamp_millis("time").cast("timestamp_ntz").alias("at"),
        F.col("data.source.kind").alias("kind"),
        F.array_join(texts, "").alias("text"),
        F.col("data.name").alias("name"),
        F.coalesce("data.callId", answer["toolCallId"]).alias("call_id"),
        F.coalesce("data.isError", answer["isError"], F.lit(False)).alias("is_error"),
    )
