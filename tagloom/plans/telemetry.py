"""Log and session analytics: calibration, segmentation experiments, attribution, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagloom.functions.columns import zero
from tagloom.functions.vectors import cosine
from tagloom.operators.ledger import event_counts, latency_distribution, regime
from tagloom.operators.running import running, top_n


def window_report(log: DataFrame, sessions: DataFrame, since: Column) -> DataFrame:
    """Event counters and injection latency per bucket from a point in time on, next to session counts."""
    recent = log.filter(F.col("ts") >= since)
    lat = latency_distribution(recent.filter("event = 'inject'"), ["bucket"], "elapsed_ms").select("bucket", F.col("n").alias("timed"), "p50", "p95")
    s = sessions.groupBy("bucket").agg(F.count(F.lit(1)).alias("sessions"), F.sum("user_messages").alias("user_messages"))
    return event_counts(recent, ["bucket"]).join(lat, "bucket", "left").join(s, "bucket", "left")


def segment_turns(vectors: DataFrame, threshold: float = 0.70) -> DataFrame:
    """(session_id, turn, segment): a segment ends where the cosine to the previous message drops below the threshold.

    Turns are ordered by their numbers alone; vectors (arrays, or structs of slots and weights) meet entry by entry."""
    block = F.floor(F.col("turn") / 1024)
    turns = vectors.filter(F.col("vector").isNotNull()).select("session_id", "turn")
    before = running(turns, ["session_id"], ["turn"], block, {"before": ("prev", F.col("turn"))})
    if isinstance(vectors.schema["vector"].dataType, StructType):
        entries = vectors.select("session_id", "turn", F.explode(F.arrays_zip("vector.slots", "vector.weights")).alias("e")).select("session_id", "turn", F.col("e.slots").alias("slot"), F.col("e.weights").alias("w"))
    else:
        entries = vectors.select("session_id", "turn", F.posexplode("vector").alias("slot", "w"))
    entries = entries.withColumn("w", F.col("w").cast("double")).filter("w <> 0")
    squares = entries.groupBy("session_id", "turn").agg(F.sum(F.col("w") * F.col("w")).alias("square"))
    mine = entries.join(before.filter("before IS NOT NULL"), ["session_id", "turn"])
    theirs = entries.withColumnsRenamed({"turn": "before", "w": "v"})
    dots = mine.join(theirs, ["session_id", "before", "slot"]).groupBy("session_id", "turn").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    known = before.join(squares, ["session_id", "turn"], "left").join(dots, ["session_id", "turn"], "left")
    known = known.join(squares.withColumnsRenamed({"turn": "before", "square": "square_before"}), ["session_id", "before"], "left")
    near = zero(F.col("dot") / (F.sqrt("square") * F.sqrt("square_before")))
    cut = F.when(F.col("before").isNotNull() & (F.round(near, 9) < threshold), 1).otherwise(0)
    marked = known.select("session_id", "turn", cut.alias("cut"))
    return running(marked, ["session_id"], ["turn"], block, {"segment": ("sum", F.col("cut"))}).select("session_id", "turn", "segment")


def segment_merge(hits: DataFrame, decay: float = 0.75, keep: int = 3) -> DataFrame:
    """(session_id, chunk_id, score): hits of the newest segments, older ones fading, best per chunk.

    Input (session_id, segment, chunk_id, score).
    """
    last = hits.groupBy("session_id").agg(F.max("segment").alias("last"))
    aged = hits.join(last, "session_id").withColumn("age", F.col("last") - F.col("segment")).filter(F.col("age") < keep)
    return aged.groupBy("session_id", "chunk_id").agg(F.max(F.col("score") * F.pow(F.lit(decay), F.col("age"))).alias("score"))


def width_sweep(turns: DataFrame, widths: tuple[int, ...] = (1, 2, 3, 4, 6)) -> DataFrame:
    """(session_id, turn, width, query_text) for several look-back widths."""
    from tagloom.functions.text import query_fields

    out = None
    for w in widths:
        part = query_fields(turns, w).withColumn("width", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return out


def attribution(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """(name, verdict): whether one deployed version covers a window from end to end.

    windows (name, start, end); runs (version, start, end) with open ends null. A window is `same` when exactly one
    version overlaps it and spans it, `unknown` without any run, else `mismatch`. Versions are few; windows are the
    streamed side.
    """
    w = windows.select("name", F.col("start").alias("ws"), F.col("end").alias("we"))
    days = F.sequence(F.to_date("ws"), F.to_date("we"))
    r = runs.select("version", F.col("start").alias("rs"), "end").withColumn("re", F.coalesce("end", windows.agg(F.max("end").alias("m")).scalar()))
    r = r.filter("re >= rs").withColumn("day", F.explode(F.sequence(F.to_date("rs"), F.to_date("re"))))
    hit = w.withColumn("day", F.explode(days)).join(r, "day").filter("rs <= we AND re >= ws")
    g = hit.groupBy("name").agg(F.count_distinct("version").alias("versions"), F.bool_or((F.col("rs") <= F.col("ws")) & (F.col("re") >= F.col("we"))).alias("spans"))
    return windows.select("name").join(g, "name", "left").select(
        "name", F.when(F.col("versions").isNull(), "unknown").when((F.col("versions") == 1) & F.col("spans"), "same").otherwise("mismatch").alias("verdict")
    )


def compare_rankings(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per query: rows on both sides, missing on either, different rank, score beyond the tolerance."""
    a = left.select("query_id", "chunk_id", F.col("rank").alias("ra"), F.col("score").alias("sa"))
    b = right.select("query_id", "chunk_id", F.col("rank").alias("rb"), F.col("score").alias("sb"))
    c = F.col
    return a.join(b, ["query_id", "chunk_id"], "full_outer").groupBy("query_id").agg(
        F.count_if(c("ra").isNotNull() & c("rb").isNotNull()).alias("common"), F.count_if(c("rb").isNull()).alias("only_left"), F.count_if(c("ra").isNull()).alias("only_right"),
        F.count_if(c("ra") != c("rb")).alias("moved"), F.count_if(F.abs(c("sa") - c("sb")) > tolerance).alias("off_score"), zero(F.max(F.abs(c("sa") - c("sb")))).alias("largest"),
    )


def audit_rows(ranked: DataFrame, shape: DataFrame) -> DataFrame:
    """Rows whose stored regime, mode or promotion does not follow from their own columns; expected empty."""
    c = F.col
    lead = top_n(ranked.select("query_id", "chunk_id", "strength", "union_rank"), ["query_id"], [F.desc(F.round("strength", 9)), F.asc("union_rank")], 2)
    lead = lead.groupBy("query_id").agg(
        F.max(F.when(c("rank") == 1, c("chunk_id"))).alias("lead_now"), F.max(F.when(c("rank") == 1, c("strength"))).alias("s1"), zero(F.max(F.when(c("rank") == 2, c("strength")))).alias("s2")
    )
    modes = shape.select("query_id", F.col("mode").alias("mode_now"))
    x = ranked.join(lead, "query_id").join(modes, "query_id")
    promoted = (c("chunk_id") == c("lead_now")) & (c("s1") >= 0.1) & (c("s1") >= 2 * c("s2"))
    problem = (
        F.when(regime(c("omega")) != c("regime"), "regime").when(c("mode_now") != c("mode"), "mode")
        .when(promoted & (c("role") != "direct_answer"), "promotion").when(F.abs(F.least(F.lit(1.0), c("pure_score") + c("topology_bonus") + c("anchor_bonus")) - c("score")) > 1e-9, "score")
    )
    return x.withColumn("problem", problem).filter("problem IS NOT NULL").select("query_id", "chunk_id", "problem")


def stability(runs: DataFrame) -> DataFrame:
    """Signatures and failures over repeated runs (run, signature, ok)."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("failures"), F.count_distinct("signature").alias("signatures"))


def replay_compare(logged: DataFrame, replayed: DataFrame, omega_tolerance: float = 0.05) -> DataFrame:
    """Logged against replayed outcomes per event: ids, observability, candidate count and gate verdict.

    Both (event_id, ids array, omega, candidates, passed).
    """
    c = F.col
    a = logged.select("event_id", *[F.col(x).alias(f"l_{x}") for x in ("ids", "omega", "candidates", "passed")])
    b = replayed.select("event_id", *[F.col(x).alias(f"r_{x}") for x in ("ids", "omega", "candidates", "passed")])
    return a.join(b, "event_id", "left").select(
        "event_id", F.coalesce(F.array_sort("l_ids") == F.array_sort("r_ids"), F.lit(False)).alias("same_ids"), F.size(F.array_intersect("l_ids", "r_ids")).alias("shared_ids"),
        F.coalesce(F.abs(c("l_omega") - c("r_omega")) <= omega_tolerance, F.lit(False)).alias("omega_close"), F.coalesce(c("l_candidates") == c("r_candidates"), F.lit(False)).alias("same_pool"),
        F.coalesce(c("l_passed") == c("r_passed"), F.lit(False)).alias("same_gate"),
    )


def pool_sensitivity(base: DataFrame, variant: DataFrame, top: int = 10) -> DataFrame:
    """Overlap and order agreement of the first results of two runs."""
    a = base.filter(F.col("rank") <= top).select("query_id", "chunk_id", F.col("rank").alias("ra"))
    b = variant.filter(F.col("rank") <= top).select("query_id", "chunk_id", F.col("rank").alias("rb"))
    return a.join(b, ["query_id", "chunk_id"], "full_outer").groupBy("query_id").agg(
        F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("overlap"), F.count_if(F.col("ra") == F.col("rb")).alias("same_place")
    )


def labelled_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Similarity range of labelled pairs (label, a, b), to place duplicate thresholds."""
    v = vectors.select("item_id", "vector")
    x = pairs.join(v.withColumnsRenamed({"item_id": "a", "vector": "va"}), "a").join(v.withColumnsRenamed({"item_id": "b", "vector": "vb"}), "b")
    return x.withColumn("s", cosine(F.col("va"), F.col("vb"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.avg("s").alias("mean"), F.max("s").alias("high"))


def thinking_time(events: DataFrame) -> DataFrame:
    """Running active time per session (session, at, id, active_s)."""
    return running(events, ["session"], ["at", "id"], F.date_trunc("day", F.col("at")), {"total_s": ("sum", F.col("active_s"))})




def tree_report(sessions: DataFrame, metrics: DataFrame, nudges: DataFrame) -> DataFrame:
    """Per session tree: size, reports, dark children, injected and cited notes, writes that followed a nudge.

    sessions (session_id, parent_id); metrics (session_id, messages, reports, injected, overlap); nudges as for
    `spontaneity` (session, id, at, kind).
    """
    from tagloom.operators.joins import session_tree
    from tagloom.operators.ledger import spontaneity

    tree = session_tree(sessions)
    after = spontaneity(nudges).groupBy(F.col("session").alias("session_id")).agg(
        F.count(F.lit(1)).alias("writes"), F.count_if(F.col("gap_s") <= 600).alias("prompted")
    )
    x = tree.join(metrics, "session_id", "left").join(after, "session_id", "left")
    total = {n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in ("messages", "reports", "injected", "overlap", "writes", "prompted")}
    return x.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if((F.col("depth") > 0) & (F.coalesce("reports", F.lit(0)) == 0)).alias("dark_children"), *total.values()
    ).withColumn("usage", F.when(F.col("injected") > 0, F.col("overlap") / F.col("injected")))


def bucket_report(log: DataFrame, snapshots: DataFrame, until: Column) -> DataFrame:
    """All-time counters of each bucket next to its last health snapshot."""
    from tagloom.sources.logs import latest_health

    return event_counts(log.filter(F.col("ts") <= until), ["bucket"]).join(latest_health(snapshots, until).withColumnRenamed("ts", "health_at"), "bucket", "left")


def gate_calibration(events: DataFrame, messages: DataFrame, score: DataFrame, labels: DataFrame) -> DataFrame:
    """Rules against labelled gate events: the last user and assistant message before each event, their similarity, the verdicts.

    events (session_id, event_id, at); messages (session_id, at, role, message_id); score (message_id, score);
    labels (event_id, label).
    """
    from tagloom.operators.joins import as_of_last
    from tagloom.operators.ledger import gate_rules

    out = labels
    for role in ("user", "assistant"):
        said = messages.filter(F.col("role") == role)
        last = as_of_last(events, said, ["session_id"], "at", "event_id", F.col("message_id"), "message_id")
        out = out.join(last.join(score, "message_id", "left").select("event_id", F.col("score").alias(role)), "event_id", "left")
    return gate_rules(out.withColumn("window", F.greatest("user", "assistant")).select("label", "user", "assistant", "window"))
