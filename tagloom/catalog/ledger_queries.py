"""Ledger, distribution and window queries over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog.base import part, query
from tagloom.catalog.join_queries import events, sessions
from tagloom.functions.columns import n64, r6
from tagloom.operators import joins as J
from tagloom.operators import ledger as L
from tagloom.operators.running import top_n
from tagloom.sources import tables as T


@query("tag_frequency", "SELECT p_partkey AS tag_id, p_name AS name, coalesce(n, 0)::BIGINT AS files FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def _(spark, d):
    edges = T.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("tag_id"))
    return L.tag_frequency(T.tags(spark, d).select("tag_id", "name"), edges)


part(
    "type_counts",
    """SELECT o_orderpriority AS bucket, p_type AS tag_id, count(DISTINCT o_orderkey) AS files, any_value(t.total) AS total
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
       JOIN (SELECT o_orderpriority AS b, count(*) AS total FROM orders GROUP BY 1) t ON t.b = o_orderpriority GROUP BY 1, 2""",
)


def type_edges(spark, d):
    """Coarse tags (part types): few values, so hubs exist."""
    types = T.read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("tag_id"))
    return T.read_table(spark, d, "lineitem").join(types, "l_partkey").select(F.col("l_orderkey").alias("file_id"), "tag_id").distinct()


@query("bucket_tag_counts", "SELECT bucket, tag_id, files, total, round(files / total, 6) AS ratio FROM type_counts", ("type_counts",))
def _(spark, d):
    return L.bucket_tag_counts(T.note_files(spark, d), type_edges(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query("hub_tags", "SELECT bucket, tag_id, files / total >= 1 / 3.0 AS hub_by_ratio, files >= 3 AND files >= total / 3.0 AS hub_by_count FROM type_counts", ("type_counts",))
def _(spark, d):
    counts = L.bucket_tag_counts(T.note_files(spark, d), type_edges(spark, d))
    return L.hub_columns(counts).select("bucket", "tag_id", "hub_by_ratio", "hub_by_count")


@query(
    "table_counts",
    """SELECT 'files' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'chunks', count(*) FROM orders
       UNION ALL SELECT 'tags', count(*) FROM part UNION ALL SELECT 'file_tags', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""",
)
def _(spark, d):
    frames = {"files": T.note_files(spark, d), "chunks": T.chunk_vectors(spark, d), "tags": T.tags(spark, d), "file_tags": T.file_tags(spark, d)}
    out = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def omega_samples(spark, d):
    return T.read_table(spark, d, "events").select(
        F.col("user_id").alias("bucket"), F.col("event_id").alias("sample_id"), F.col("ts").alias("at"), (F.col("value") / 500).alias("omega")
    )


@query(
    "omega_distribution",
    """SELECT bucket, count(*) AS n, round(avg(o), 6) AS mean, round(min(o), 6) AS low, round(max(o), 6) AS high,
         count(*) FILTER (WHERE c = 0) AS bin0, count(*) FILTER (WHERE c = 1) AS bin1, count(*) FILTER (WHERE c = 2) AS bin2, count(*) FILTER (WHERE c = 3) AS bin3, count(*) FILTER (WHERE c = 4) AS bin4,
         count(*) FILTER (WHERE o < 0.12) AS collapsed, count(*) FILTER (WHERE o >= 0.12 AND o < 0.45) AS sparse, count(*) FILTER (WHERE o >= 0.45) AS dense
       FROM (SELECT user_id AS bucket, value / 500 AS o, least(4, floor(value / 500 / 0.2e0)) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50 GROUP BY 1""",
)
def _(spark, d):
    df = L.omega_distribution(omega_samples(spark, d))
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


part(
    "ledger",
    """SELECT user_id AS bucket, k AS file_id, count(*) FILTER (WHERE event_type = 'view') AS passive, count(*) FILTER (WHERE event_type = 'click') AS active,
         max(ts) FILTER (WHERE event_type = 'view') AS last_passive_at, max(ts) FILTER (WHERE event_type = 'click') AS last_active_at
       FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
    ("ev",),
)
part("ledger_all", "SELECT file_id, sum(passive)::BIGINT AS passive, sum(active)::BIGINT AS active, max(last_passive_at) AS last_passive_at, max(last_active_at) AS last_active_at FROM ledger GROUP BY 1", ("ledger",))


def usage_events(spark, d):
    kind = F.when(F.col("event_type") == "view", "passive").otherwise("active")
    return events(spark, d).filter(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").alias("bucket"), "event_id", F.col("k").alias("file_id"), kind.alias("kind"), F.col("ts").alias("at")
    )


def note_ledger(spark, d):
    """Ledger per note over all users, with the note's own bucket."""
    files = T.note_files(spark, d).select("file_id", "bucket")
    return L.usage_ledger(usage_events(spark, d).drop("bucket").join(files, "file_id"))


@query("usage_ledger", "SELECT * FROM ledger", ("ledger",))
def _(spark, d):
    return L.usage_ledger(usage_events(spark, d))


NOW = "(SELECT max(ts) FROM events)"


def now(spark, d):
    return T.read_table(spark, d, "events").agg(F.max("ts").alias("t")).scalar()


@query(
    "usage_view",
    f"""SELECT o_orderpriority AS bucket, count(*) AS files, count(*) FILTER (WHERE u > 0) AS ever_used, count(*) FILTER (WHERE u = 0) AS never_used,
         round(count(*) FILTER (WHERE u > 0) / count(*), 6) AS share, count(*) FILTER (WHERE u > 0 AND {NOW} - greatest(last_passive_at, last_active_at) > INTERVAL 14 DAY) AS stale
       FROM (SELECT o_orderpriority, coalesce(passive + active, 0) AS u, last_passive_at, last_active_at FROM orders LEFT JOIN ledger_all ON file_id = o_orderkey) GROUP BY 1""",
    ("ledger_all",),
)
def _(spark, d):
    files = T.note_files(spark, d).select("bucket", "file_id")
    return L.usage_view(files, note_ledger(spark, d), now(spark, d)).withColumn("share", F.round("share", 6))


@query(
    "top_used",
    """SELECT bucket, rank, file_id, total FROM (SELECT o_orderpriority AS bucket, file_id, passive + active AS total,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY passive + active DESC, file_id)::INTEGER AS rank FROM ledger_all JOIN orders ON o_orderkey = file_id) WHERE rank <= 5""",
    ("ledger_all",),
)
def _(spark, d):
    return L.top_used(note_ledger(spark, d))


@query(
    "uncovered_ratio",
    """SELECT o_orderpriority AS bucket, count(*) AS files, count(*) FILTER (WHERE file_id IS NULL) AS never, round(count(*) FILTER (WHERE file_id IS NULL) / count(*), 6) AS ratio,
         count(*) FILTER (WHERE file_id IS NULL) / count(*) > 0.5 AS warn FROM orders LEFT JOIN ledger_all ON file_id = o_orderkey GROUP BY 1""",
    ("ledger_all",),
)
def _(spark, d):
    files = T.note_files(spark, d).select("bucket", "file_id")
    return L.uncovered(files, note_ledger(spark, d).select("bucket", "file_id")).withColumn("ratio", F.round("ratio", 6))


@query(
    "latency_distribution",
    """SELECT event_type, count(*) AS n, floor(sum(ms) / count(*))::BIGINT AS mean, max(ms) FILTER (WHERE i = n // 2) AS p50,
         CASE WHEN count(*) >= 5 THEN max(ms) FILTER (WHERE i = greatest(0, floor(0.95e0 * n)::BIGINT - 1)) ELSE max(ms) END AS p95, max(ms) AS max
       FROM (SELECT event_type, ms, row_number() OVER (PARTITION BY event_type ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
             FROM (SELECT event_type, round(value * 1000)::BIGINT AS ms FROM events)) GROUP BY 1""",
)
def _(spark, d):
    e = T.read_table(spark, d, "events").select("event_type", F.round(F.col("value") * 1000).cast("bigint").alias("ms"))
    return L.latency_distribution(e, ["event_type"], "ms")


LOG_EVENT = """CASE event_type WHEN 'view' THEN 'inject' WHEN 'click' THEN 'inject-skip' WHEN 'signup' THEN 'inject-skip' WHEN 'purchase' THEN 'note-write' ELSE 'write-nudge' END"""
LOG_REASON = """CASE WHEN event_type = 'click' THEN 'gate-below-threshold' WHEN event_type = 'signup' AND k % 2 = 0 THEN 'identical-selection' WHEN event_type = 'signup' THEN 'no-candidates' END"""

part("log_rows", f"SELECT user_id AS bucket, event_id, ts, k, value, {LOG_EVENT} AS event, {LOG_REASON} AS reason FROM ev", ("ev",))

EVENT_COUNTS_SQL = """count(*) FILTER (WHERE event = 'inject') AS injects, count(*) FILTER (WHERE reason LIKE 'gate-below%') AS gate_blocks,
         count(*) FILTER (WHERE reason LIKE 'identical%') AS identical, count(*) FILTER (WHERE reason = 'no-candidates') AS other_skips,
         count(*) FILTER (WHERE event = 'note-write') AS writes, count(*) FILTER (WHERE event = 'write-nudge') AS nudges,
         round(count(*) FILTER (WHERE reason LIKE 'gate-below%') / nullif(count(*) FILTER (WHERE event = 'inject' OR reason LIKE 'gate-below%'), 0), 6) AS block_rate"""


def log_rows(spark, d):
    return events(spark, d).select(
        F.col("user_id").alias("bucket"), "event_id", "ts", "k", "value", F.expr(LOG_EVENT).alias("event"), F.expr(LOG_REASON).alias("reason")
    )


@query("event_counts", f"SELECT bucket, {EVENT_COUNTS_SQL} FROM log_rows GROUP BY 1", ("log_rows",))
def _(spark, d):
    return L.event_counts(log_rows(spark, d), ["bucket"]).withColumn("block_rate", F.round("block_rate", 6))


@query("event_rollup", "SELECT bucket, event, count(*) AS n FROM log_rows GROUP BY ROLLUP (bucket, event)", ("log_rows",))
def _(spark, d):
    return log_rows(spark, d).rollup("bucket", "event").agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_injected",
    """SELECT bucket, k, n, rank FROM (SELECT bucket, k, count(*) AS n, row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, k)::INTEGER AS rank
       FROM log_rows WHERE event = 'inject' GROUP BY 1, 2) WHERE rank <= 8""",
    ("log_rows",),
)
def _(spark, d):
    counts = log_rows(spark, d).filter("event = 'inject'").groupBy("bucket", "k").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counts, ["bucket"], [F.desc("n"), F.asc("k")], 8)


@query(
    "session_metrics",
    """SELECT conv_id AS session_id, count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages,
         count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS other_messages, count(*) FILTER (WHERE length(text) >= 400 AND role = 'assistant') AS reports,
         (max(turn) FILTER (WHERE role = 'user') > coalesce(max(turn) FILTER (WHERE role = 'assistant'), -1)) AS incomplete, sum(length(text))::BIGINT AS chars
       FROM conversations GROUP BY 1""",
)
def _(spark, d):
    role, text = F.col("role"), F.length("text")
    return T.read_table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(
        F.count_if(role == "user").alias("user_messages"),
        F.count_if(role == "assistant").alias("assistant_messages"),
        F.count_if(~role.isin("user", "assistant")).alias("other_messages"),
        F.count_if((role == "assistant") & (text >= 400)).alias("reports"),
        (F.max(F.when(role == "user", F.col("turn"))) > F.coalesce(F.max(F.when(role == "assistant", F.col("turn"))), F.lit(-1))).alias("incomplete"),
        n64(F.sum(text), "chars"),
    )


@query(
    "injected_and_cited",
    """SELECT user_id AS session_id, count(DISTINCT k) FILTER (WHERE v) AS injected, count(DISTINCT k) FILTER (WHERE c) AS cited, count(DISTINCT k) FILTER (WHERE v AND c) AS overlap FROM (
         SELECT user_id, k, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c FROM ev GROUP BY 1, 2) GROUP BY 1""",
    ("ev",),
)
def _(spark, d):
    e = events(spark, d)
    flags = e.groupBy("user_id", "k").agg(F.bool_or(F.col("event_type") == "view").alias("v"), F.bool_or(F.col("event_type") == "click").alias("c"))
    return flags.groupBy(F.col("user_id").alias("session_id")).agg(
        F.count_if("v").alias("injected"), F.count_if("c").alias("cited"), F.count_if(F.col("v") & F.col("c")).alias("overlap")
    )


@query(
    "tree_rollup",
    """SELECT root_id, count(*) AS sessions, count(*) FILTER (WHERE depth > 0) AS children, count(*) FILTER (WHERE depth > 0 AND reports = 0) AS dark_children,
         sum(msgs)::BIGINT AS messages, round(count(*) FILTER (WHERE reports > 0) / count(*), 6) AS coverage
       FROM tree JOIN (SELECT conv_id, count(*) AS msgs, count(*) FILTER (WHERE role = 'assistant' AND length(text) >= 400) AS reports FROM conversations GROUP BY 1) ON conv_id = session_id GROUP BY 1""",
    ("tree",),
)
def _(spark, d):
    m = T.read_table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(
        F.count(F.lit(1)).alias("msgs"), F.count_if((F.col("role") == "assistant") & (F.length("text") >= 400)).alias("reports")
    )
    return J.session_tree(sessions(spark, d)).join(m, "session_id").groupBy("root_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("depth") > 0).alias("children"),
        F.count_if((F.col("depth") > 0) & (F.col("reports") == 0)).alias("dark_children"),
        F.sum("msgs").alias("messages"),
        F.round(F.count_if(F.col("reports") > 0) / F.count(F.lit(1)), 6).alias("coverage"),
    )


@query(
    "funnel_counts",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' AND event_type IN ('signup', 'purchase') GROUP BY 1""",
)
def _(spark, d):
    window = "ts >= TIMESTAMP_NTZ '2024-01-08 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-22 00:00:00' AND event_type IN ('signup', 'purchase')"
    return T.read_table(spark, d, "events").filter(window).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("sessions")
    )


@query(
    "event_entropy",
    """SELECT user_id, count(*) AS n, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy, round(sum(p * p), 6) AS hhi
       FROM (SELECT user_id, m / sum(m) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, event_type, sum(value) AS m FROM events GROUP BY 1, 2)) GROUP BY 1""",
)
def _(spark, d):
    mass = T.read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("m"))
    out = L.normalised_entropy(mass, ["user_id"], "m")
    return out.withColumns({"entropy": F.round("entropy", 6), "hhi": F.round("hhi", 6)})


STATE = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'manual' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'discard' ELSE 'approved' END END"


@query(
    "queue_stats",
    f"""SELECT bucket, count(*) FILTER (WHERE state <> 'approved') AS pending, round((epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(min(since) FILTER (WHERE state <> 'approved'))) / 3600e6, 6) AS oldest_hours,
         count(*) FILTER (WHERE state = 'discard') AS discard, count(*) FILTER (WHERE state = 'manual') AS manual, count(*) FILTER (WHERE state = 'ok') AS ok
       FROM (SELECT o_orderpriority AS bucket, o_orderdate AS since, {STATE} AS state FROM orders) GROUP BY 1""",
)
def _(spark, d):
    o = T.read_table(spark, d, "orders")
    drafts = o.select(F.col("o_orderpriority").alias("bucket"), F.col("o_orderdate").alias("at"), F.expr(STATE).alias("state"))
    return L.queue_stats(drafts, o.agg(F.max("o_orderdate").alias("m")).scalar())


@query(
    "trimmed_mean",
    """SELECT user_id, n::BIGINT AS n, round(CASE WHEN n - 2 * c > 0 THEN list_sum(list_slice(vs, c + 1, n - c)) / (n - 2 * c) ELSE vs[n // 2 + 1] END, 6) AS mean FROM (
         SELECT user_id, count(*) AS n, greatest(1, floor(count(*) * 0.1e0)::INTEGER) AS c, list_sort(list(value)) AS vs
         FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20 GROUP BY 1)""",
)
def _(spark, d):
    e = T.read_table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    last = L.last_n_values(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], "value", 20)
    return last.select("user_id", n64(F.size("values"), "n"), r6(L.trimmed_mean(F.col("values")), "mean"))


@query(
    "composition_share",
    "SELECT conv_id, role, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / sum(sum(length(text))) OVER (PARTITION BY conv_id), 6) AS share FROM conversations GROUP BY 1, 2",
)
def _(spark, d):
    df = L.composition_share(T.read_table(spark, d, "conversations"), ["conv_id"], "role", F.length("text"))
    return df.withColumn("share", F.round("share", 6))


@query(
    "baseline_delta",
    """SELECT user_id, old_n, old_mean, new_n, new_mean, new_n - old_n AS delta_n, round(new_mean - old_mean, 6) AS delta_mean FROM
         (SELECT user_id, count(*) AS old_n, round(avg(value), 6) AS old_mean FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type <> 'error' GROUP BY 1)
         FULL JOIN (SELECT user_id, count(*) AS new_n, round(avg(value), 6) AS new_mean FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'purchase' GROUP BY 1) USING (user_id)""",
)
def _(spark, d):
    def summary(where):
        return T.read_table(spark, d, "events").filter(where).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))

    cut = "TIMESTAMP_NTZ '2024-01-16 00:00:00'"
    out = L.summary_delta(summary(f"ts < {cut} AND event_type <> 'error'"), summary(f"ts >= {cut} AND event_type = 'purchase'"), "user_id", ["n", "mean"])
    return out.withColumn("delta_mean", F.round("delta_mean", 6))


@query(
    "effective_domain",
    """SELECT user_id, event_id, position, round(share, 6) AS share FROM (
         SELECT user_id, event_id, row_number() OVER w AS position, value / sum(value) OVER (PARTITION BY user_id) AS share,
           (sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) - value) / sum(value) OVER (PARTITION BY user_id) AS before
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE before < 0.8e0 - 1e-12""",
)
def _(spark, d):
    e = T.read_table(spark, d, "events").select("user_id", "event_id", "value")
    return L.cumulative_domain(e, ["user_id"], "value", "event_id", 0.8).select("user_id", "event_id", "position", r6(F.col("share"), "share"))


@query(
    "spontaneity",
    """SELECT session, id, nudge_at, round((epoch_us(stamp) - epoch_us(nudge_at)) / 1e6, 6) AS gap_s FROM (
         SELECT user_id AS session, event_id AS id, ts AS stamp, event_type, last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (
           PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nudge_at FROM events) WHERE event_type = 'purchase'""",
)
def _(spark, d):
    kind = F.when(F.col("event_type") == "error", "nudge").when(F.col("event_type") == "purchase", "write").otherwise("other")
    e = T.read_table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"))
    return L.spontaneity(e).withColumn("gap_s", F.round("gap_s", 6))


@query(
    "generation_changes",
    """SELECT bucket, artifact, sig, before FROM (SELECT o_orderpriority AS bucket, o_orderkey AS artifact, o_orderstatus AS sig,
         lag(o_orderstatus) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE sig IS DISTINCT FROM before""",
)
def _(spark, d):
    o = T.read_table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("bucket"), F.col("o_orderkey").alias("artifact"), F.col("o_orderstatus").alias("sig"), "o_orderdate"
    )
    month = F.date_trunc("month", F.col("o_orderdate"))
    return L.generation_changes(o, ["bucket"], ["o_orderdate", "artifact"], month, "sig").select("bucket", "artifact", "sig", "before")


@query(
    "row_loss",
    """SELECT bucket, round, files, before FROM (SELECT *, lag(files) OVER (PARTITION BY bucket ORDER BY round) AS before FROM (
         SELECT o_orderpriority AS bucket, date_trunc('month', o_orderdate)::TIMESTAMP AS round, count(*) AS files FROM orders GROUP BY 1, 2)) WHERE files < before""",
)
def _(spark, d):
    snap = T.note_files(spark, d).groupBy("bucket", F.date_trunc("month", "updated_at").alias("round")).agg(F.count(F.lit(1)).alias("files"))
    return L.row_loss(snap)


@query(
    "baseline_summary",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sessions, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events GROUP BY 1""",
)
def _(spark, d):
    return T.read_table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("sessions"), r6(F.avg("value"), "mean"), r6(F.max("value"), "max")
    )
