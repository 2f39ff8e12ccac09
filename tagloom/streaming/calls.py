"""Tool calls and their results, matched by call id within a time bound. Works on streams and on static frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calls_and_results(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of flattened session events; a result names the call it answers."""
    calls = events.filter((F.col("type") == "tool/call") & F.col("call_id").isNotNull()).select("session_id", "call_id", "name", "at")
    results = events.filter((F.col("type") == "tool/result") & F.col("call_id").isNotNull())
    return calls, results.select("session_id", "call_id", "at", F.coalesce("is_error", F.lit(False)).alias("is_error"))


def answered_calls(calls: DataFrame, results: DataFrame, bound: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """session_id, call_id, name, at, ms and is_error of each call; both null without a result within `bound`.

    calls (session_id, call_id, name, at), results (session_id, call_id, at, is_error); a call has one result at most. On a
    stream a call is held until its result comes or the watermark passes its bound, then it is given as unanswered."""
    c = calls.withWatermark("at", late)
    r = results.select(F.col("session_id").alias("r_session"), F.col("call_id").alias("r_call"), F.col("at").alias("r_at"), "is_error").withWatermark("r_at", late)
    inside = (F.col("r_at") >= F.col("at")) & (F.col("r_at") <= F.col("at") + F.expr(f"INTERVAL {bound}"))
    met = c.join(r, (F.col("session_id") == F.col("r_session")) & (F.col("call_id") == F.col("r_call")) & inside, "left_outer")
    ms = F.unix_millis(F.col("r_at").cast("timestamp")) - F.unix_millis(F.col("at").cast("timestamp"))
    return met.select("session_id", "call_id", "name", "at", ms.alias("ms"), "is_error")


def tool_counts(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, answered and unanswered ones, errors, and the mean and longest latency per key."""
    answered = F.col("ms").isNotNull()
    return calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(answered).alias("answered"), F.count_if(~answered).alias("unanswered"),
        F.count_if(answered & F.col("is_error")).alias("errors"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"),
    )
