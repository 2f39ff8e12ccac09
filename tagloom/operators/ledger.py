"""Aggregates over usage ledgers, observation samples, logs and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.functions.time import micros
from tagloom.operators.order_stats import Rank, order_statistics
from tagloom.operators.running import running, top_n
from tagloom.sources.logs import WRITES

# fixed values: regime limits of the observability score
COLLAPSED_BELOW = 0.12
SPARSE_BELOW = 0.45


def regime(omega: Column) -> Column:
    return F.when(omega < COLLAPSED_BELOW, "collapsed").when(omega < SPARSE_BELOW, "sparse").otherwise("dense")


def tag_frequency(tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    counts = file_tags.groupBy("tag_id").agg(F.count_distinct("file_id").alias("files"))
    return tags.join(counts, "tag_id", "left").withColumn("files", F.coalesce("files", F.lit(0)))


def bucket_tag_counts(files: DataFrame, file_tags: DataFrame) -> DataFrame:
    """(bucket, tag_id, files, total, ratio): both numerator and denominator local to the bucket."""
    totals = files.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"))
    local = file_tags.join(files.select("file_id", "bucket"), "file_id").groupBy("bucket", "tag_id").agg(
        F.count_distinct("file_id").alias("files")
    )
    return local.join(totals, "bucket").withColumn("ratio", F.col("files") / F.col("total"))


def hub_columns(counts: DataFrame, ratio: float = 1 / 3, minimum: int = 3) -> DataFrame:
    """Two hub tests: by ratio alone, and by ratio with a minimum number of notes."""
    return counts.withColumns(
        {
            "hub_by_ratio": F.col("files") / F.col("total") >= ratio,
            "hub_by_count": (F.col("files") >= minimum) & (F.col("files") >= F.col("total") * ratio),
        }
    )


def omega_distribution(samples: DataFrame, window: int = 50) -> DataFrame:
    """Newest `window` samples per bucket: count, mean, extremes, five bins and regime counts."""
    recent = top_n(samples, ["bucket"], [F.desc("at"), F.desc("sample_id")], window)
    cell = F.least(F.lit(4), F.floor(F.col("omega") / 0.2))
    return recent.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("omega").alias("mean"),
        F.min("omega").alias("low"),
        F.max("omega").alias("high"),
        *[F.count_if(cell == i).alias(f"bin{i}") for i in range(5)],
        *[F.count_if(regime(F.col("omega")) == r).alias(r) for r in ("collapsed", "sparse", "dense")],
    )


def usage_ledger(events: DataFrame) -> DataFrame:
    """(bucket, file_id, passive, active, last times) from (bucket, event_id, file_id, kind, at); a note counts once per event."""
    once = events.groupBy("bucket", "event_id", "file_id", "kind").agg(F.max("at").alias("at"))
    passive, active = F.col("kind") == "passive", F.col("kind") == "active"
    return once.groupBy("bucket", "file_id").agg(
        F.count_if(passive).alias("passive"),
        F.count_if(active).alias("active"),
        F.max(F.when(passive, F.col("at"))).alias("last_passive_at"),
        F.max(F.when(active, F.col("at"))).alias("last_active_at"),
    )


def usage_view(files: DataFrame, ledger: DataFrame, now: Column, stale_days: float = 14.0) -> DataFrame:
    """Per bucket: notes ever and never used, share, stale notes."""
    last = F.greatest(F.col("last_passive_at"), F.col("last_active_at"))
    total = F.coalesce("passive", F.lit(0)) + F.coalesce("active", F.lit(0))
    rows = files.join(ledger, ["bucket", "file_id"], "left").withColumns({"used": total > 0, "last": last, "now": now})
    stale = F.col("used") & (micros(F.col("now")) - micros(F.col("last")) > int(stale_days * 86400e6))
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("used").alias("ever_used"),
        F.count_if(~F.col("used")).alias("never_used"),
        (F.count_if("used") / F.count(F.lit(1))).alias("share"),
        F.count_if(stale).alias("stale"),
    )


def top_used(ledger: DataFrame, n: int = 5) -> DataFrame:
    totals = ledger.withColumn("total", F.col("passive") + F.col("active"))
    return top_n(totals, ["bucket"], [F.desc("total"), F.asc("file_id")], n).select("bucket", "rank", "file_id", "total")


def uncovered(files: DataFrame, recalled: DataFrame, warn: float = 0.5) -> DataFrame:
    never = files.join(recalled, ["bucket", "file_id"], "left_anti").groupBy("bucket").agg(F.count(F.lit(1)).alias("never"))
    totals = files.groupBy("bucket").agg(F.count(F.lit(1)).alias("files"))
    return totals.join(never, "bucket", "left").select(
        "bucket", "files", F.coalesce("never", F.lit(0)).alias("never"),
        (F.coalesce("never", F.lit(0)) / F.col("files")).alias("ratio"),
        (F.coalesce("never", F.lit(0)) / F.col("files") > warn).alias("warn"),
    )


def latency_distribution(df: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """n, floored mean, index p50 (n div 2), index p95 (from 5 values on, else the maximum) and maximum."""
    n = F.col("n")
    p95 = F.when(n >= 5, F.greatest(F.lit(0), F.floor(F.lit(0.95) * n).cast("bigint") - 1)).otherwise(n - 1)
    picks = order_statistics(
        df, keys, ms, [Rank("p50", 0.5, F.floor(n / 2)), Rank("p95_low", 0.95, p95), Rank("p95_max", 1.0, n - 1)]
    )
    rest = df.filter(F.col(ms).isNotNull()).groupBy(*keys).agg(F.floor(F.sum(ms) / F.count(ms)).cast("bigint").alias("mean"), F.max(ms).alias("max"))
    return picks.join(rest, keys).select(*keys, "n", "mean", "p50", F.when(n >= 5, F.col("p95_low")).otherwise(F.col("max")).alias("p95"), "max")


def event_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Injection, gate and write counters per key from parsed log rows (event, reason)."""
    def n(cond):
        return F.count_if(cond)

    ev, why = F.col("event"), F.coalesce(F.col("reason"), F.lit(""))
    skip = ev == "inject-skip"
    counted = log.groupBy(*keys).agg(
        n(ev == "inject").alias("injects"),
        n(skip & F.contains(why, F.lit("gate-below"))).alias("gate_blocks"),
        n(skip & ~F.contains(why, F.lit("gate-below")) & F.contains(why, F.lit("identical"))).alias("identical"),
        n(skip & ~F.contains(why, F.lit("gate-below")) & ~F.contains(why, F.lit("identical"))).alias("other_skips"),
        n(ev.isin(*WRITES)).alias("writes"),
        n(ev == "write-nudge").alias("nudges"),
    )
    tried = F.col("injects") + F.col("gate_blocks")
    return counted.withColumn("block_rate", F.when(tried > 0, F.col("gate_blocks") / tried))


def normalised_entropy(df: DataFrame, keys: list[str], mass: str) -> DataFrame:
    """(keys, n, entropy over ln n, hhi) of positive masses."""
    rows = df.filter(F.col(mass) > 0)
    # sum(p ln p) = sum(m ln m) / S - ln S needs a single pass with partial sums
    m = F.col(mass)
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(m).alias("s"), F.sum(m * F.log(m)).alias("ml"), F.sum(m * m).alias("m2")
    )
    raw = F.log("s") - F.col("ml") / F.col("s")
    return agg.select(
        *keys, "n", F.when(F.col("n") > 1, raw / F.log(F.col("n").cast("double"))).otherwise(0.0).alias("entropy"),
        (F.col("m2") / (F.col("s") * F.col("s"))).alias("hhi"),
    )


def queue_stats(drafts: DataFrame, now: Column) -> DataFrame:
    """Pending drafts, age of the oldest in hours and check states per bucket."""
    pending = F.col("state") != "approved"
    return drafts.withColumn("now", now).groupBy("bucket").agg(
        F.count_if(pending).alias("pending"),
        F.round((micros(F.max("now")) - micros(F.min(F.when(pending, F.col("at"))))) / 3600e6, 6).alias("oldest_hours"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("discard", "manual", "ok")],
    )


def trimmed_mean(values: Column) -> Column:
    """Mean after dropping a tenth (at least one) from both ends; the middle element when nothing is left."""
    n = F.size(values)
    cut = F.greatest(F.lit(1), F.floor(n * 0.1).cast("int"))
    ordered = F.array_sort(values)
    kept = F.when(n - 2 * cut > 0, F.slice(ordered, cut + 1, F.greatest(n - 2 * cut, F.lit(0))))
    mean = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)
    return F.when(n > 0, F.coalesce(mean, F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)))


def last_n_values(df: DataFrame, keys: list[str], order: list[Column], value: str, n: int) -> DataFrame:
    """(keys, values): the newest n values per key as an array."""
    recent = top_n(df, keys, order, n)
    return recent.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col(value).alias("v"))))["v"].alias("values"))


def composition_share(df: DataFrame, keys: list[str], part: str, size: Column) -> DataFrame:
    sums = df.groupBy(*keys, part).agg(F.sum(size).alias("chars"))
    totals = sums.groupBy(*keys).agg(F.sum("chars").alias("total"))
    return sums.join(totals, keys).select(*keys, part, "chars", (F.col("chars") / F.col("total")).alias("share"))


def summary_delta(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer comparison of two summaries: old, new and difference for each value."""
    a = old.select(key, *[F.col(v).alias(f"old_{v}") for v in values])
    b = new.select(key, *[F.col(v).alias(f"new_{v}") for v in values])
    joined = a.join(b, key, "full_outer")
    return joined.select(key, *[c for v in values for c in (f"old_{v}", f"new_{v}")], *[(F.col(f"new_{v}") - F.col(f"old_{v}")).alias(f"delta_{v}") for v in values])


def gate_rules(df: DataFrame) -> DataFrame:
    """Misses on positives and false passes on negatives for each gate rule; columns user, assistant, window, label."""
    u, a, w = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("user", "assistant", "window"))
    top, gap = F.greatest(u, a), w - u
    # fixed values: thresholds of the compared rules
    rules = {
        "user_055": u >= 0.55,
        "user_042": u >= 0.42,
        "either_055": top >= 0.55,
        "user_or_gap": (u >= 0.55) | (gap > 0.25),
        "either_or_gap": (top >= 0.55) | (gap > 0.25),
        "user_055_assistant_062": (u >= 0.55) | (a >= 0.62),
    }
    exploded = df.select("label", F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in rules]), F.array(*rules.values()))).alias("rule", "passed"))
    return exploded.groupBy("rule").agg(
        F.count_if((F.col("label") == 1) & ~F.col("passed")).alias("misses"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if((F.col("label") == 0) & F.col("passed")).alias("false_passes"),
        F.count_if(F.col("label") == 0).alias("negatives"),
    )


def cumulative_domain(df: DataFrame, keys: list[str], mass: str, ident: str, ratio: float, cap: int | None = None, floor: int = 0) -> DataFrame:
    """Rows kept by descending mass until the rows before them hold `ratio` of the total.

    With `cap`, at most that many rows; the first `floor` rows always stay. Slices of the running sum are powers
    of two of the mass, so a field of any size is spread over tasks.
    """
    rows = df.filter(F.col(mass) > 0).withColumn("_neg", -F.col(mass))
    totals = rows.groupBy(*keys).agg(F.sum(mass).alias("_total"))
    ran = running(
        rows, keys, ["_neg", ident], F.floor(-F.log2(F.col(mass)) * 2),
        {"_upto": ("sum", F.col(mass)), "_pos": ("count_before", F.lit(1))},
    )
    keep = (F.col("_upto") - F.col(mass)) / F.col("_total") < ratio - 1e-12
    if floor:
        keep |= F.col("_pos") < floor
    if cap is not None:
        keep &= F.col("_pos") < cap
    return ran.join(totals, keys).filter(keep).select(*df.columns, (F.col("_pos") + 1).alias("position"), (F.col(mass) / F.col("_total")).alias("share"))


def spontaneity(events: DataFrame) -> DataFrame:
    """Last nudge before each write and the gap in seconds; a write does not reset the nudge. Input (session, id, at, kind)."""
    seen = running(events, ["session"], ["at", "id"], F.date_trunc("day", F.col("at")), {"nudge_at": ("last", F.when(F.col("kind") == "nudge", F.col("at")))})
    return seen.filter(F.col("kind") == "write").select(
        "session", "id", "nudge_at", ((micros(F.col("at")) - micros(F.col("nudge_at"))) / 1e6).alias("gap_s")
    )


def generation_changes(df: DataFrame, keys: list[str], order: list[str], slice_expr: Column, signature: str) -> DataFrame:
    """Rows whose signature differs from the one before them."""
    seen = running(df, keys, order, slice_expr, {"before": ("prev", F.col(signature))})
    return seen.filter(~F.col(signature).eqNullSafe(F.col("before")))


def row_loss(snapshots: DataFrame) -> DataFrame:
    """Rounds in which a bucket lost notes. Input (bucket, round, files); few rounds per bucket."""
    w = Window.partitionBy("bucket").orderBy("round")
    return snapshots.withColumn("before", F.lag("files").over(w)).filter(F.col("files") < F.col("before"))
