"""Log, session-event and telemetry queries, and streams drained over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog.base import part, query
from tagloom.catalog.join_queries import events
from tagloom.catalog.ledger_queries import EVENT_COUNTS_SQL, log_rows
from tagloom.catalog.text_queries import DIM, document_vectors
from tagloom.functions import text as X
from tagloom.functions.columns import n64, r6
from tagloom.operators import ledger as L
from tagloom.operators.neighbours import top_neighbours
from tagloom.params import ReminderParams
from tagloom.plans import telemetry as M
from tagloom.session import staged
from tagloom.sources import logs as G
from tagloom.sources import tables as T
from tagloom.streaming import sessions as P
from tagloom.streaming import windows as W


def log_lines(spark, d):
    """The events table as log text."""
    e = log_rows(spark, d)
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return e.select(
        F.col("bucket"),
        F.concat(
            F.lit("["), stamp, F.lit("Z] [info] "), F.col("event"), F.lit(" ids=D"), F.col("k").cast("string"), F.lit(",D"), F.col("event_id").cast("string"),
            F.coalesce(F.concat(F.lit(" reason="), F.col("reason")), F.lit("")), F.lit(" session=s"), F.col("bucket").cast("string"),
            F.lit(" gate={passed:"), (F.col("k") % 2 == 0).cast("string"), F.lit("} elapsedMs="), F.floor(F.col("value")).cast("string"),
        ).alias("value"),
    )


@query(
    "log_parse",
    """SELECT user_id AS bucket, date_trunc('millisecond', ts) AS ts, event, reason, 'D' || k::VARCHAR || ',D' || event_id::VARCHAR AS ids, k % 2 = 0 AS gate_passed, floor(value)::BIGINT AS elapsed_ms, 's' || user_id::VARCHAR AS session
       FROM (SELECT e.*, l.event, l.reason FROM ev e JOIN log_rows l USING (event_id))""",
    ("ev", "log_rows"),
)
def _(spark, d):
    p = G.parse_log(log_lines(spark, d))
    return p.select("bucket", "ts", "event", "reason", F.array_join("ids", ",").alias("ids"), "gate_passed", "elapsed_ms", "session")


@query("log_counts", f"SELECT bucket, {EVENT_COUNTS_SQL} FROM log_rows GROUP BY 1", ("log_rows",))
def _(spark, d):
    return L.event_counts(G.parse_log(log_lines(spark, d)), ["bucket"]).withColumn("block_rate", F.round("block_rate", 6))


@query(
    "health_latest",
    """SELECT bucket, round, files, components, round(omega_mean, 3) AS omega_mean, never_recalled FROM (SELECT o_orderpriority AS bucket, o_orderkey AS round, o_custkey AS files, (o_orderkey % 7)::BIGINT AS components, floor(o_totalprice / 1e3) / 1e3 AS omega_mean, o_custkey // 2 AS never_recalled,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30') WHERE rn = 1""",
)
def _(spark, d):
    o = T.read_table(spark, d, "orders")
    s = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("["), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z] round="), s("o_orderkey"), F.lit(" components="), (F.col("o_orderkey") % 7).cast("string"),
        F.lit(" hub=tag:"), s("o_custkey"), F.lit("/"), s("o_custkey"), F.lit(" omegaMean="), F.format_string("%.3f", F.floor(F.col("o_totalprice") / 1e3) / 1e3),
        F.lit(" uncovered="), F.floor(F.col("o_custkey") / 2).cast("string"), F.lit("/"), s("o_custkey"), F.lit(" used=1/2"),
    )
    snaps = G.parse_health(o.select(F.col("o_orderpriority").alias("bucket"), line.alias("value")))
    last = G.latest_health(snaps, F.expr("TIMESTAMP_NTZ '1999-06-30 00:00:00'"))
    return last.select("bucket", "round", "files", "components", "omega_mean", "never_recalled")


@query(
    "session_events",
    """SELECT conv_id AS session_id, CASE WHEN role = 'assistant' THEN 'assistant/message' ELSE 'user/message' END AS type, role AS kind, text FROM conversations""",
)
def _(spark, d):
    c = T.read_table(spark, d, "conversations")
    body = F.struct(
        F.struct(F.col("role").alias("kind")).alias("source"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")
    )
    kind = F.when(F.col("role") == "assistant", "assistant/message").otherwise("user/message")
    lines = c.select(F.col("conv_id").alias("session_id"), F.to_json(F.struct(kind.alias("type"), (F.col("turn") * 60000).alias("time"), body.alias("data"))).alias("value"))
    return G.parse_sessions(lines).select("session_id", "type", "kind", "text")


def turn_vectors(spark, d):
    t = T.read_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return staged(spark, d, "turn_vectors", lambda: X.sparse_vectors(X.hash_slots(t, "id", "text", DIM), "id", DIM))


def turn_segments(spark, d):
    v = turn_vectors(spark, d)
    s = M.segment_turns(v.select(F.floor(F.col("id") / 1000).alias("session_id"), (F.col("id") % 1000).alias("turn"), "vector"))
    return v, s


from tagloom.catalog.govern_queries import hash_parts  # noqa: E402

hash_parts("turns", "SELECT conv_id * 1000 + turn AS key, text FROM conversations")
part(
    "segments",
    """SELECT key // 1000 AS session_id, key % 1000 AS turn, sum(c) OVER (PARTITION BY key // 1000 ORDER BY key)::BIGINT AS segment FROM (
         SELECT key, CASE WHEN p IS NOT NULL AND round(list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p))), 9) < 0.7 THEN 1 ELSE 0 END AS c FROM (SELECT key, v, lag(v) OVER (PARTITION BY key // 1000 ORDER BY key) AS p FROM turns_vec))""",
    ("turns_vec",),
)


@query("segment_breaks", "SELECT session_id, turn, segment FROM segments", ("segments",))
def _(spark, d):
    return turn_segments(spark, d)[1].select("session_id", "turn", n64(F.col("segment"), "segment"))


part(
    "turns_slots",
    """SELECT key, slot, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM turns_raw
       UNION ALL SELECT key, 0, 1.0e0 FROM turns_src WHERE text IS NOT NULL AND key NOT IN (SELECT key FROM turns_raw)""",
    ("turns_src", "turns_raw"),
)


@query(
    "segment_merge",
    """SELECT session_id, chunk_id, round(max(s * pow(0.75e0, age)), 6) AS score FROM (SELECT g.session_id, h.doc_id AS chunk_id, h.s, max(g.segment) OVER (PARTITION BY g.session_id) - g.segment AS age FROM segments g
         JOIN (SELECT key, doc_id, s FROM (SELECT key, doc_id, s, row_number() OVER (PARTITION BY key ORDER BY s DESC, doc_id) AS rn FROM (
             SELECT k.key, d.doc_id, round(coalesce(x.s, 0), 9) AS s FROM (SELECT DISTINCT key FROM turns_slots) k CROSS JOIN documents d LEFT JOIN (
               SELECT t.key, e.doc_id, sum(t.weight * e.weight) AS s FROM turns_slots t JOIN doc_slots e USING (slot) GROUP BY 1, 2) x ON x.key = k.key AND x.doc_id = d.doc_id)) WHERE rn <= 5) h
           ON h.key = g.session_id * 1000 + g.turn) WHERE age < 3 GROUP BY 1, 2""",
    ("segments", "turns_slots", "doc_slots"),
)
def _(spark, d):
    v, seg = turn_segments(spark, d)
    hits = top_neighbours(v.withColumnRenamed("id", "query_id"), document_vectors(spark, d).select(F.col("doc_id").alias("item_id"), "vector"), 5)
    rows = hits.select(F.floor(F.col("query_id") / 1000).alias("session_id"), (F.col("query_id") % 1000).alias("turn"), F.col("item_id").alias("chunk_id"), "score").join(seg, ["session_id", "turn"])
    return M.segment_merge(rows).withColumn("score", F.round("score", 6))


@query(
    "width_sweep",
    " UNION ALL ".join(
        rf"SELECT conv_id AS session_id, turn, {w} AS width, length(right(array_to_string(list(regexp_replace(text, '^\s+|\s+$', '', 'g')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), chr(10)), 4000)) AS chars FROM conversations WHERE length(trim(text)) > 0"
        for w in (1, 2, 3, 4, 6)
    ),
)
def _(spark, d):
    turns = T.read_table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text")
    return M.width_sweep(turns).select("session_id", "turn", "width", n64(F.length("query_text"), "chars"))


@query(
    "gate_separability",
    """SELECT rule, count(*) FILTER (WHERE label = 1 AND NOT ok) AS misses, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0 AND ok) AS false_passes, count(*) FILTER (WHERE label = 0) AS negatives FROM (
         SELECT label, unnest(['user_055', 'user_042', 'either_055', 'user_or_gap', 'either_or_gap', 'user_055_assistant_062']) AS rule,
           unnest([u >= 0.55, u >= 0.42, greatest(u, a) >= 0.55, u >= 0.55 OR w - u > 0.25, greatest(u, a) >= 0.55 OR w - u > 0.25, u >= 0.55 OR a >= 0.62]) AS ok FROM (
           SELECT quality AS label, (n_chars % 100) / 100e0 AS u, (n_chars % 89) / 89e0 AS a, (n_chars % 97) / 97e0 AS w FROM labels JOIN documents USING (doc_id))) GROUP BY 1""",
)
def _(spark, d):
    """Label quality against three synthetic similarities derived from each document's length."""
    x = T.read_table(spark, d, "labels").join(T.read_table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    sims = {n: (F.col("n_chars") % m) / F.lit(float(m)) for n, m in (("user", 100), ("assistant", 89), ("window", 97))}
    return L.gate_rules(x.select(F.col("quality").alias("label"), *[c.alias(n) for n, c in sims.items()]))


@query(
    "attribution",
    """SELECT name, CASE WHEN count(version) = 0 THEN 'unknown' WHEN count(DISTINCT version) = 1 AND bool_or(rs <= ws AND re >= we) THEN 'same' ELSE 'mismatch' END AS verdict FROM (
         SELECT event_id AS name, ts AS ws, ts + INTERVAL 6 HOUR AS we FROM events) LEFT JOIN (SELECT version, rs, re FROM (SELECT DISTINCT event_type AS version, date_trunc('day', ts)::TIMESTAMP AS rs, date_trunc('day', ts)::TIMESTAMP + INTERVAL 20 HOUR AS re FROM events WHERE event_type = 'signup')) ON rs <= we AND re >= ws GROUP BY 1""",
)
def _(spark, d):
    e = T.read_table(spark, d, "events")
    windows = e.select(F.col("event_id").alias("name"), F.col("ts").alias("start"), F.expr("ts + INTERVAL '6' HOUR").alias("end"))
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    runs = e.filter("event_type = 'signup'").select(F.col("event_type").alias("version"), day.alias("start")).distinct().withColumn("end", F.expr("start + INTERVAL '20' HOUR"))
    return M.attribution(windows, runs)


@query(
    "thinking_time",
    "SELECT user_id AS session, event_id AS id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS total_s FROM events",
)
def _(spark, d):
    e = T.read_table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("value").alias("active_s"))
    return M.thinking_time(e).select("session", "id", r6(F.col("total_s"), "total_s"))


@query(
    "window_report",
    f"""SELECT bucket, injects, gate_blocks, identical, other_skips, writes, nudges, block_rate, p50, p95 FROM (SELECT bucket, {EVENT_COUNTS_SQL} FROM log_rows WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1) LEFT JOIN (
         SELECT bucket, max(ms) FILTER (WHERE i = n // 2) AS p50, CASE WHEN any_value(n) >= 5 THEN max(ms) FILTER (WHERE i = greatest(0, floor(0.95e0 * n)::BIGINT - 1)) ELSE max(ms) END AS p95 FROM (
           SELECT bucket, floor(value)::BIGINT AS ms, row_number() OVER (PARTITION BY bucket ORDER BY floor(value)) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n FROM log_rows WHERE event = 'inject' AND ts >= TIMESTAMP '2024-01-10') GROUP BY 1) USING (bucket)""",
    ("log_rows",),
)
def _(spark, d):
    sessions = events(spark, d).groupBy(F.col("user_id").alias("bucket")).agg(F.count(F.lit(1)).alias("user_messages"))
    r = M.window_report(G.parse_log(log_lines(spark, d)), sessions, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return r.select("bucket", "injects", "gate_blocks", "identical", "other_skips", "writes", "nudges", F.round("block_rate", 6).alias("block_rate"), "p50", "p95")


@query("topology_audit")
def _(spark, d):
    """Scored rows whose stored fields contradict each other; empty when all is well."""
    from tagloom.catalog.rank_queries import ranked, shape

    return M.audit_rows(ranked(spark, d), shape(spark, d))


@query(
    "ranking_diff",
    """SELECT query_id::BIGINT AS query_id, count(*) FILTER (WHERE a.rank IS NOT NULL AND b.rank IS NOT NULL) AS common, count(*) FILTER (WHERE b.rank IS NULL) AS only_left, count(*) FILTER (WHERE a.rank IS NULL) AS only_right,
         count(*) FILTER (WHERE a.rank <> b.rank) AS moved, count(*) FILTER (WHERE abs(a.score - b.score) > 1e-6) AS off_score, round(max(abs(a.score - b.score)), 6) AS largest
       FROM ranked a FULL JOIN dranked b USING (query_id, chunk_id) GROUP BY 1""",
    ("ranked", "dranked"),
)
def _(spark, d):
    """Topology against curve ranking of the same batch."""
    from tagloom.catalog.curve_queries import curve_ranked
    from tagloom.catalog.rank_queries import ranked

    return M.compare_rankings(ranked(spark, d), curve_ranked(spark, d)).withColumn("largest", F.round("largest", 6))


def event_stream(spark, d):
    return W.table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_counts",
    """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    rows, _ = W.drain(W.event_counts(event_stream(spark, d), ["event_type"], "ts", "1 hour"), "stream-counts", "update")
    out = W.newest(rows, ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6(F.col("total"), "total"))


@query(
    "stream_usage",
    """SELECT bucket, file_id, passive, active, last_passive_at, last_active_at FROM ledger""",
    ("ledger",),
)
def _(spark, d):
    kind = F.when(F.col("event_type") == "view", "passive").otherwise("active")
    e = event_stream(spark, d).filter(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").alias("bucket"), "event_id", F.regexp_extract("props", r"\d+", 0).cast("bigint").alias("file_id"), kind.alias("kind"), F.col("ts").alias("at")
    )
    rows, _ = W.drain(W.usage(e), "stream-usage", "update")
    out = W.newest(rows, ["bucket", "file_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_passive_at", "last_active_at")})


@query(
    "stream_sessions",
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
         SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g""",
)
def _(spark, d):
    rows, _ = W.drain(W.activity_sessions(event_stream(spark, d), "user_id", "ts", "6 hours"), "stream-sessions", "complete")
    last = rows.agg(F.max("batch").alias("b")).scalar()
    return rows.withColumn("b", last).filter("batch = b").select(
        "user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n"
    )


@query(
    "stream_omega",
    """SELECT user_id AS session_id, count(*) AS n, round(avg(o), 6) AS mean, round(min(o), 6) AS low, round(max(o), 6) AS high FROM (SELECT user_id, value / 500 AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50 GROUP BY 1""",
)
def _(spark, d):
    s = event_stream(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("value") / 500).alias("omega"))
    rows, _ = W.drain(P.rolling_samples(s), "stream-omega", "update")
    return W.newest(rows, ["session_id"]).select("session_id", "n", *[r6(F.col(c), c) for c in ("mean", "low", "high")])


@query(
    "stream_omega_histogram",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id AS bucket, count(*) AS n, count(*) FILTER (WHERE o < 0.12) AS collapsed, count(*) FILTER (WHERE o >= 0.12 AND o < 0.45) AS sparse, count(*) FILTER (WHERE o >= 0.45) AS dense FROM (SELECT *, value / 500 AS o FROM events) GROUP BY 1, 2""",
)
def _(spark, d):
    s = event_stream(spark, d).select(F.col("user_id").alias("bucket"), F.col("ts").alias("at"), (F.col("value") / 500).alias("omega"))
    rows, _ = W.drain(W.omega_histogram(s, "1 day"), "stream-histogram", "update")
    return W.newest(rows, ["start", "bucket"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "bucket", "n", "collapsed", "sparse", "dense")


def activity(spark, d):
    """Events as session activity: views are tool outputs, clicks reports, purchases notes, errors delegations, signups compressions."""
    kind = F.expr("CASE event_type WHEN 'view' THEN 'tool' WHEN 'click' THEN 'report' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'delegate' ELSE 'compress' END")
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    return event_stream(spark, d).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), kind.alias("kind"), F.dayofyear("ts").alias("turn"), k.alias("step"),
        F.floor(F.col("value") * 40).cast("int").alias("chars"), F.floor(F.col("value") * 1000).cast("bigint").alias("active_ms"),
    )


# A finite table is one micro-batch; without delay its last events are passed by the watermark too.
def drained(rows, label):
    return W.drain(rows, label, "append")[0].drop("batch").withColumn("at", F.col("at").cast("timestamp_ntz"))


IDLE_US = int(P.IDLE_DAYS * 86_400_000_000)
part("session_steps", "SELECT *, user_id AS session_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL")
part(
    "session_kinds",
    """SELECT session_id, rn, us, event_id, ts, CASE event_type WHEN 'view' THEN 'tool' WHEN 'click' THEN 'report' WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'delegate' ELSE 'compress' END AS kind,
         dayofyear(ts)::BIGINT AS turn, regexp_extract(props, '[0-9]+')::BIGINT AS step, floor(value * 40)::BIGINT AS chars, floor(value * 1000)::BIGINT AS active_ms FROM session_steps""",
    ("session_steps",),
)
R = ReminderParams()


@query(
    "stream_reminders",
    f"""SELECT session_id, event_id AS seq, ts AS at, reason, amount, delegating, compressed FROM (
         WITH RECURSIVE r AS (
           SELECT DISTINCT session_id, 0::BIGINT AS rn, NULL::BIGINT AS last, 0::BIGINT AS wrote, 0::BIGINT AS nudged, 0::BIGINT AS a_turn, 0::BIGINT AS a_step, -1::BIGINT AS a_chars, 0::BIGINT AS total, 0::BIGINT AS active,
             0::BIGINT AS a_active, -1::BIGINT AS d_turn, 0::BIGINT AS d_us, false AS delegating, 0 AS compressed, []::BIGINT[] AS ring, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS reason, NULL::BIGINT AS amount FROM session_kinds
           UNION ALL
           SELECT session_id, rn, us, CASE WHEN kind = 'write' THEN us ELSE wrote END, CASE WHEN reason IS NOT NULL THEN us ELSE nudged END,
             CASE WHEN kind = 'write' OR reason IS NOT NULL THEN greatest(a_turn, turn) ELSE a_turn END,
             CASE WHEN kind = 'write' THEN greatest(a_step, step) WHEN reason IS NOT NULL THEN step ELSE a_step END,
             CASE WHEN kind = 'write' OR reason IS NOT NULL THEN total ELSE a_chars END, total, active, CASE WHEN kind = 'write' OR reason IS NOT NULL THEN active ELSE a_active END,
             d_turn, d_us, kind <> 'write' AND delegating, CASE WHEN kind = 'write' THEN 0 ELSE compressed END, ring, event_id, ts, reason,
             CASE reason WHEN 'steps' THEN steps WHEN 'growth' THEN total - a_chars WHEN 'turns' THEN d_turn - a_turn WHEN 'active' THEN active - a_active END
           FROM (SELECT *, CASE WHEN kind = 'write' OR nudged > 0 AND us - nudged < {int(R.spacing_minutes * P.MINUTE_US)} THEN NULL
               WHEN {R.steps} > 0 AND steps >= {R.steps} THEN 'steps' WHEN {R.growth_chars} > 0 AND total - a_chars >= {R.growth_chars} THEN 'growth'
               WHEN {R.report_turns} > 0 AND progress AND d_turn - a_turn >= {R.report_turns} THEN 'turns'
               WHEN {R.active_minutes} > 0 AND progress AND active - a_active >= {R.active_minutes} * 60000 THEN 'active' END AS reason
             FROM (SELECT * REPLACE (CASE WHEN a_chars < 0 THEN total ELSE a_chars END AS a_chars), CASE WHEN step >= a_step THEN step - a_step ELSE step END AS steps, d_turn >= 0 AND d_us > wrote AS progress
             FROM (SELECT * REPLACE (
                 active + active_ms AS active,
                 total + CASE WHEN kind <> 'tool' OR chars <= {R.tool_default} THEN chars WHEN len(ring) < {R.tool_warmup} THEN {R.tool_default}
                   ELSE least(chars, floor(list_sum(list_sort(ring)[cut + 1 : len(ring) - cut])::DOUBLE / (len(ring) - 2 * cut) + 0.5)::BIGINT) END AS total,
                 CASE WHEN kind = 'tool' AND chars > 0 THEN list_append(ring, chars)[-{R.tool_ring} :] ELSE ring END AS ring,
                 CASE WHEN kind = 'report' AND chars >= {R.report_chars} THEN turn ELSE d_turn END AS d_turn, CASE WHEN kind = 'report' AND chars >= {R.report_chars} THEN us ELSE d_us END AS d_us,
                 delegating OR kind = 'delegate' AS delegating, CASE WHEN kind = 'compress' THEN compressed + 1 ELSE compressed END AS compressed)
             FROM (SELECT *, greatest(1, floor(len(ring) * 0.1)::BIGINT) AS cut
             FROM (SELECT e.*, CASE WHEN f THEN 0 ELSE wrote END AS wrote, CASE WHEN f THEN 0 ELSE nudged END AS nudged, CASE WHEN f THEN 0 ELSE a_turn END AS a_turn, CASE WHEN f THEN 0 ELSE a_step END AS a_step,
                 CASE WHEN f THEN -1 ELSE a_chars END AS a_chars, CASE WHEN f THEN 0 ELSE total END AS total, CASE WHEN f THEN 0 ELSE active END AS active, CASE WHEN f THEN 0 ELSE a_active END AS a_active,
                 CASE WHEN f THEN -1 ELSE d_turn END AS d_turn, CASE WHEN f THEN 0 ELSE d_us END AS d_us, delegating AND NOT f AS delegating, CASE WHEN f THEN 0 ELSE compressed END AS compressed, CASE WHEN f THEN [] ELSE ring END AS ring
               FROM (SELECT r.*, e AS e, coalesce(e.us - r.last > {IDLE_US}, false) AS f FROM r JOIN session_kinds e ON e.session_id = r.session_id AND e.rn = r.rn + 1))))))
         )
         SELECT * FROM r) WHERE reason IS NOT NULL""",
    ("session_kinds",),
)
def _(spark, d):
    return drained(P.write_reminders(activity(spark, d), R, "0 seconds"), "stream-reminders")


@query(
    "stream_prompt_reminders",
    f"""SELECT session_id, event_id AS seq, ts AS at, hit AS stops FROM (
         WITH RECURSIVE r AS (
           SELECT DISTINCT session_id, 0::BIGINT AS rn, NULL::BIGINT AS last, 0::BIGINT AS w, 0::BIGINT AS n, 0 AS stops, false AS progress, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::INTEGER AS hit FROM session_steps
           UNION ALL
           SELECT session_id, rn, us, CASE WHEN kind = 'write' THEN us ELSE w END, CASE WHEN fire THEN us ELSE n END,
             CASE WHEN kind = 'write' OR fire THEN 0 WHEN kind = 'stop' THEN stops + 1 ELSE stops END, CASE WHEN kind = 'write' OR fire THEN false ELSE progress OR kind = 'prompt' END,
             event_id, ts, CASE WHEN fire THEN stops + 1 END
           FROM (SELECT *, kind = 'stop' AND progress AND (stops + 1 >= 2 OR us - greatest(w, n) >= 420000000) AS fire FROM (
             SELECT session_id, rn, us, kind, event_id, ts, w, stops, progress, CASE WHEN kind <> 'write' AND w = 0 AND n = 0 THEN us ELSE n END AS n FROM (
               SELECT e.session_id, e.rn, e.us, e.event_id, e.ts, CASE e.event_type WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'stop' ELSE 'prompt' END AS kind,
                 CASE WHEN e.us - r.last > {IDLE_US} THEN 0 ELSE r.w END AS w, CASE WHEN e.us - r.last > {IDLE_US} THEN 0 ELSE r.n END AS n,
                 CASE WHEN e.us - r.last > {IDLE_US} THEN 0 ELSE r.stops END AS stops, CASE WHEN e.us - r.last > {IDLE_US} THEN false ELSE r.progress END AS progress
               FROM r JOIN session_steps e ON e.session_id = r.session_id AND e.rn = r.rn + 1))))
         SELECT * FROM r) WHERE hit IS NOT NULL""",
    ("session_steps",),
)
def _(spark, d):
    e = activity(spark, d).withColumn("kind", F.expr("CASE kind WHEN 'write' THEN 'write' WHEN 'report' THEN 'stop' ELSE 'prompt' END"))
    return drained(P.prompt_reminders(e, "0 seconds"), "stream-prompts")


@query(
    "stream_cadence",
    f"""SELECT session_id, event_id AS seq, ts AS at, why, shown FROM (
         WITH RECURSIVE r AS (
           SELECT DISTINCT session_id, 0::BIGINT AS rn, NULL::BIGINT AS last, -1 AS auto_turn, 0 AS auto_step, 0::BIGINT AS compaction, '' AS shown_key, -1 AS shown_turn, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS why, NULL::BOOLEAN AS shown FROM session_steps
           UNION ALL
           SELECT session_id, rn, us, CASE WHEN runs THEN turn ELSE auto_turn END, CASE WHEN runs THEN step ELSE auto_step END, CASE WHEN mark > 0 THEN mark ELSE compaction END,
             CASE WHEN shows THEN key ELSE shown_key END, CASE WHEN shows THEN turn ELSE shown_turn END, event_id, ts,
             CASE WHEN NOT runs THEN NULL WHEN starts THEN 'start' WHEN compacted THEN 'compaction' ELSE 'cadence' END, CASE WHEN runs THEN shows END
           FROM (SELECT *, runs AND (compacted OR key <> shown_key OR turn - shown_turn >= 8) AS shows FROM (
             SELECT *, starts OR compacted OR auto_turn <> turn OR step - auto_step >= 15 AS runs FROM (
             SELECT *, step = 1 OR fresh AS starts, mark > 0 AND mark <> compaction AS compacted FROM (
               SELECT e.session_id, e.rn, e.us, e.event_id, e.ts, dayofyear(e.ts)::INTEGER AS turn, regexp_extract(e.props, '[0-9]+')::INTEGER + 1 AS step, e.event_type = 'click' AS fresh,
                 CASE WHEN e.event_type = 'error' THEN e.event_id ELSE 0 END AS mark, floor(e.value / 20)::BIGINT::VARCHAR AS key,
                 CASE WHEN e.us - r.last > {IDLE_US} THEN -1 ELSE r.auto_turn END AS auto_turn, CASE WHEN e.us - r.last > {IDLE_US} THEN 0 ELSE r.auto_step END AS auto_step,
                 CASE WHEN e.us - r.last > {IDLE_US} THEN 0 ELSE r.compaction END AS compaction, CASE WHEN e.us - r.last > {IDLE_US} THEN '' ELSE r.shown_key END AS shown_key,
                 CASE WHEN e.us - r.last > {IDLE_US} THEN -1 ELSE r.shown_turn END AS shown_turn
               FROM r JOIN session_steps e ON e.session_id = r.session_id AND e.rn = r.rn + 1)))))
         SELECT * FROM r) WHERE why IS NOT NULL""",
    ("session_steps",),
)
def _(spark, d):
    e = event_stream(spark, d)
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    steps = e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.dayofyear("ts").alias("turn"), (k + 1).alias("step"),
        (F.col("event_type") == "click").alias("fresh_input"), F.when(F.col("event_type") == "error", F.col("event_id")).otherwise(0).alias("compaction"),
        F.floor(F.col("value") / 20).cast("string").alias("key"),
    )
    return drained(P.recall_cadence(steps, late="0 seconds"), "stream-cadence")


@query(
    "stream_drafts",
    """SELECT conv_id AS session_id, turn // 2 AS turn, max_by(text, length(text)) FILTER (WHERE role = 'assistant') AS assistant_text FROM conversations GROUP BY 1, 2 HAVING max(length(text)) FILTER (WHERE role = 'assistant') >= 400""",
)
def _(spark, d):
    c = W.table_stream(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60)
    m = c.select(F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 2).alias("turn"), at.alias("at"), "role", "text", F.lit(False).alias("wrote"))
    rows, _ = W.drain(W.substantive_turns(m), "stream-drafts", "update")
    return W.newest(rows, ["session_id", "turn"]).select("session_id", "turn", "assistant_text")




CALL_BOUND = "60 days 12 hours"


@query(
    "stream_calls",
    f"""WITH r AS (SELECT l_orderkey, min((l_shipdate, l_returnflag)) AS m FROM lineitem GROUP BY 1),
         mark AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(m[1]) FROM r)) - INTERVAL '1 day' AS t),
         j AS (SELECT o_orderpriority AS name, o_orderdate AS called, CASE WHEN m[1] >= o_orderdate AND m[1] <= o_orderdate + INTERVAL '{CALL_BOUND}' THEN epoch_ms(m[1]) - epoch_ms(o_orderdate) END AS ms, m[2] = 'R' AS err
               FROM orders LEFT JOIN r ON l_orderkey = o_orderkey)
        SELECT name, count(*) AS calls, count(ms) AS answered, count(*) FILTER (ms IS NULL) AS unanswered, count(*) FILTER (ms IS NOT NULL AND err) AS errors, round(avg(ms), 3) AS mean_ms, max(ms) AS max_ms
        FROM j, mark WHERE ms IS NOT NULL OR called + INTERVAL '{CALL_BOUND}' < t GROUP BY 1""",
)
def _(spark, d):
    """Orders as calls and their first shipped line as result; orders that are still open at the end are not counted."""
    from tagloom.session import cut_lineage
    from tagloom.streaming import calls as K

    calls = W.table_stream(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("call_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("timestamp").alias("at"))
    first = T.read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_shipdate", "l_returnflag")).alias("m"))
    owners = T.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session_id"))
    rows = first.join(owners, "l_orderkey").select("session_id", F.col("l_orderkey").alias("call_id"), F.col("m.l_shipdate").cast("timestamp").alias("at"), (F.col("m.l_returnflag") == "R").alias("is_error"))
    stored = cut_lineage(rows, "results")
    results = spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])
    met, _ = W.drain(K.answered_calls(calls, results, CALL_BOUND, "1 day"), "stream-calls", "append")
    return K.tool_counts(met, ["name"]).withColumn("mean_ms", F.round("mean_ms", 3))
