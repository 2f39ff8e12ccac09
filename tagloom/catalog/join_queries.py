"""Join, set and position queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.catalog.base import part, query
from tagloom.functions.columns import n64, r6
from tagloom.operators import joins as J
from tagloom.operators.running import top_n
from tagloom.sources import tables as T

part("ev", r"SELECT *, regexp_extract(props, '\d+')::BIGINT AS k FROM events")


def events(spark, d):
    return T.read_table(spark, d, "events").withColumn("k", F.regexp_extract("props", r"\d+", 0).cast("bigint"))


@query(
    "chunk_owners",
    """SELECT o_orderkey AS chunk_id, 'order/' || o_orderkey::VARCHAR AS path, o_orderpriority AS bucket, o_orderdate AS written_at,
         o_orderkey % (SELECT count(*) FROM embeddings) AS vec_id FROM orders""",
)
def _(spark, d):
    files = T.note_files(spark, d).select("file_id", "path", F.col("updated_at").alias("written_at"))
    return T.chunk_vectors(spark, d).join(files, "file_id").select("chunk_id", "path", "bucket", "written_at", "vec_id")


@query(
    "note_curves",
    """SELECT file_id, list(tag_id ORDER BY position) AS tags, string_agg(p_name, ',' ORDER BY position) AS names
       FROM file_tags JOIN part ON p_partkey = tag_id GROUP BY 1""",
    ("file_tags",),
)
def _(spark, d):
    named = T.file_tags(spark, d).join(T.tags(spark, d).select("tag_id", "name"), "tag_id")
    curve = named.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("position", "tag_id", "name"))).alias("c"))
    return curve.select("file_id", F.col("c.tag_id").alias("tags"), F.array_join("c.name", ",").alias("names"))


@query(
    "candidate_curves",
    """SELECT file_id, tag_id, position::INTEGER AS position FROM file_tags WHERE file_id IN (SELECT k FROM ev WHERE event_type = 'view')""",
    ("file_tags", "ev"),
)
def _(spark, d):
    wanted = events(spark, d).filter("event_type = 'view'").select(F.col("k").alias("file_id")).distinct()
    return T.file_tags(spark, d).join(wanted, "file_id", "left_semi")


@query(
    "asof_last_view",
    """SELECT user_id, event_id, ts, last_value FROM (
         SELECT user_id, event_id, ts, event_type, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (
           PARTITION BY user_id ORDER BY ts, (event_type = 'purchase')::INTEGER ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_value
         FROM events WHERE event_type IN ('view', 'purchase')) WHERE event_type = 'purchase'""",
)
def _(spark, d):
    e = T.read_table(spark, d, "events")
    return J.as_of_last(
        e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "ts", "event_id", F.col("value"), "last_value"
    )


@query(
    "interval_match",
    """SELECT * FROM (WITH RECURSIVE asking AS MATERIALIZED (
         SELECT user_id, event_id, epoch_us(ts) AS us, k % 4 AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev WHERE event_type = 'purchase'
       ), options AS MATERIALIZED (
         SELECT a.user_id, a.n, a.event_id, list({'id': c.event_id, 'same': c.k % 4 = a.label, 'gap': abs(epoch_us(c.ts) - a.us)} ORDER BY (c.k % 4 = a.label) DESC, abs(epoch_us(c.ts) - a.us), c.ts, c.event_id) FILTER (c.event_id IS NOT NULL) AS o
         FROM asking a LEFT JOIN ev c ON c.user_id = a.user_id AND c.event_type = 'click' AND epoch_us(c.ts) BETWEEN a.us - 172800000000 AND a.us + 10800000000
         GROUP BY a.user_id, a.n, a.event_id
       ), walk AS (
         SELECT user_id, n, event_id, o[1] AS pick, CASE WHEN o[1] IS NULL THEN []::BIGINT[] ELSE [o[1].id] END AS used FROM options WHERE n = 1
         UNION ALL
         SELECT user_id, n, event_id, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.id) END FROM (
           SELECT x.user_id, x.n, x.event_id, list_filter(x.o, lambda c: NOT list_contains(w.used, c.id))[1] AS pick, w.used FROM walk w JOIN options x ON x.user_id = w.user_id AND x.n = w.n + 1)
       ) SELECT user_id, event_id, pick.id AS call_id, pick.same AS same_label, round(pick.gap / 1e6, 6) AS gap_s FROM walk WHERE pick IS NOT NULL)""",
    ("ev",),
)
def _(spark, d):
    e = events(spark, d).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("t"), (F.col("k") % 4).alias("label"), "event_type")
    hit = J.interval_match_in_order(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["user_id"], 2 * 86400, 3 * 3600)
    return hit.withColumn("gap_s", F.round("gap_s", 6))


@query(
    "call_latency",
    """SELECT o_orderstatus AS state, count(*) AS calls, count(*) FILTER (WHERE first_ship IS NULL) AS open,
         count(*) FILTER (WHERE first_ship < o_orderdate) AS early, sum(date_diff('day', o_orderdate, first_ship))::BIGINT AS total_days
       FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(spark, d):
    calls = T.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("state"), "o_orderdate")
    results = T.read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.min("l_shipdate").alias("first"))
    return calls.join(results, "call_id", "left").groupBy("state").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("first").isNull()).alias("open"),
        F.count_if(F.col("first") < F.col("o_orderdate")).alias("early"),
        n64(F.sum(F.date_diff("first", "o_orderdate")), "total_days"),
    )


@query(
    "shared_tag_notes",
    """SELECT file_id, coalesce(shared, 0)::BIGINT AS shared FROM (SELECT DISTINCT file_id FROM file_tags) LEFT JOIN (
         SELECT a.file_id, count(DISTINCT b.file_id) AS shared FROM file_tags a JOIN file_tags b ON a.tag_id = b.tag_id AND a.file_id <> b.file_id GROUP BY 1) USING (file_id)""",
    ("file_tags",),
)
def _(spark, d):
    return J.notes_sharing_a_tag(T.file_tags(spark, d))


@query(
    "orphan_tags",
    "SELECT p_partkey AS tag_id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)",
)
def _(spark, d):
    used = T.read_table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 25").select(F.col("l_partkey").alias("tag_id"))
    return J.orphan_tags(T.tags(spark, d).select("tag_id", "name"), used)


@query(
    "resolve_ids",
    """SELECT p_partkey AS id, coalesce(s_suppkey, f) AS file_id, CASE WHEN s_suppkey IS NOT NULL THEN 'file' WHEN f IS NOT NULL THEN 'chunk' ELSE 'missing' END AS how
       FROM part LEFT JOIN supplier ON s_suppkey = p_partkey
       LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS f FROM lineitem WHERE l_linestatus = 'F' AND l_discount > 0.07 GROUP BY 1) ON l_partkey = p_partkey""",
)
def _(spark, d):
    files = T.read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"))
    chunks = T.read_table(spark, d, "lineitem").filter("l_linestatus = 'F' AND l_discount > 0.07").select(
        F.col("l_partkey").alias("chunk_id"), F.col("l_orderkey").alias("file_id")
    )
    return J.resolve_ids(T.read_table(spark, d, "part").select(F.col("p_partkey").alias("id")), files, chunks)


@query(
    "title_lookup",
    """SELECT needle, count(DISTINCT title) AS matches, CASE WHEN count(DISTINCT title) = 1 THEN min(title) END AS title,
         CASE count(DISTINCT title) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status
       FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS needle FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT r_name FROM region)
       LEFT JOIN (SELECT DISTINCT p_name AS title FROM part) ON contains(title, needle) GROUP BY 1""",
)
def _(spark, d):
    names = T.read_table(spark, d, "part").select("p_name").distinct()
    needles = (
        names.select(F.split("p_name", " ")[0].alias("needle"))
        .union(names.select("p_name"))
        .union(T.read_table(spark, d, "region").select("r_name"))
        .distinct()
    )
    return J.find_by_substring(needles, names.select(F.col("p_name").alias("title")))


@query(
    "corpus_state",
    """SELECT bucket, event_id, visible, state FROM (
         SELECT bucket, event_id, side, sum(1 - side) OVER w AS visible_, sum(h) OVER w AS state_, visible_::BIGINT AS visible, state_::BIGINT AS state FROM (
           SELECT o_orderpriority AS bucket, o_orderdate AS t, NULL AS event_id, 0 AS side, ('0x' || left(sha256(o_orderkey::VARCHAR), 8))::BIGINT AS h FROM orders
           UNION ALL SELECT o_orderpriority, o_orderdate, o_orderkey, 1, 0 FROM orders)
         WINDOW w AS (PARTITION BY bucket ORDER BY t, side)) WHERE side = 1""",
)
def _(spark, d):
    files = T.note_files(spark, d)
    asked = files.select("bucket", F.col("updated_at").alias("t"), F.col("file_id").alias("event_id"))
    return J.corpus_state_at(files, asked).select("bucket", "event_id", n64(F.col("visible"), "visible"), n64(F.col("state"), "state"))


@query(
    "corpus_drift",
    """SELECT state, count(*) AS notes FROM (
         SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'added' WHEN a.n = b.n THEN 'same' ELSE 'drift' END AS state
         FROM (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a
         FULL JOIN (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) b USING (k)) GROUP BY 1""",
)
def _(spark, d):
    def bodies(where):
        return T.read_table(spark, d, "lineitem").filter(where).groupBy(F.col("l_orderkey").alias("path")).agg(F.count_distinct("l_partkey").alias("n"))

    return J.compare_by_key(bodies("l_linestatus = 'O'"), bodies("l_returnflag <> 'R'"), "path", "n").groupBy("state").agg(F.count(F.lit(1)).alias("notes"))


part("sess", "SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id > 0 THEN conv_id // 4 END AS parent_id FROM conversations")
part(
    "tree",
    """SELECT session_id, path[-1] AS root_id, (len(path) - 1)::BIGINT AS depth FROM (
         WITH RECURSIVE w AS (
           SELECT session_id, parent_id AS up, [session_id] AS path FROM sess
           UNION ALL SELECT w.session_id, s.parent_id, list_append(w.path, s.session_id) FROM w JOIN sess s ON s.session_id = w.up WHERE len(w.path) <= 4)
         SELECT session_id, max_by(path, len(path)) AS path FROM w GROUP BY 1)""",
    ("sess",),
)


def sessions(spark, d):
    conv = F.col("conv_id")
    return T.read_table(spark, d, "conversations").select(
        conv.alias("session_id"), F.when(conv > 0, F.floor(conv / 4)).alias("parent_id")
    ).distinct()


@query("session_tree", "SELECT * FROM tree", ("tree",))
def _(spark, d):
    return J.session_tree(sessions(spark, d))


@query(
    "inherited_bucket",
    """WITH RECURSIVE b AS (SELECT session_id, parent_id, CASE WHEN session_id % 5 = 0 THEN 'b' || (session_id % 3)::VARCHAR END AS bucket
         FROM (SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id > 0 THEN conv_id // 4 END AS parent_id FROM conversations)),
       w AS (SELECT session_id, parent_id, bucket, 0 AS depth FROM b
         UNION ALL SELECT w.session_id, b.parent_id, b.bucket, w.depth + 1 FROM w JOIN b ON b.session_id = w.parent_id WHERE w.bucket IS NULL AND w.depth < 4)
       SELECT session_id, min_by(bucket, depth) FILTER (WHERE bucket IS NOT NULL) AS bucket, coalesce(min(depth) FILTER (WHERE bucket IS NOT NULL), 0)::BIGINT AS depth FROM w GROUP BY 1""",
)
def _(spark, d):
    s = sessions(spark, d)
    named = F.when(F.col("session_id") % 5 == 0, F.concat(F.lit("b"), (F.col("session_id") % 3).cast("string")))
    return J.inherited_bucket(s.withColumn("bucket", named))


@query(
    "bucket_resolution",
    """WITH reg AS (SELECT DISTINCT p_brand AS bucket, left(sha256(p_brand), 12) AS hash FROM part),
       req AS (SELECT bucket AS request FROM reg UNION SELECT left(hash, 2) FROM reg UNION SELECT left(hash, 6) FROM reg UNION SELECT DISTINCT p_type FROM part)
       SELECT request, CASE WHEN max((bucket = request)::INTEGER) = 1 THEN request WHEN count(DISTINCT bucket) = 1 THEN min(bucket) END AS bucket,
         CASE WHEN max((bucket = request)::INTEGER) = 1 THEN 'name' WHEN count(DISTINCT bucket) = 1 THEN 'hash' WHEN count(DISTINCT bucket) > 1 THEN 'ambiguous' ELSE 'missing' END AS status
       FROM req LEFT JOIN reg ON bucket = request OR (length(request) >= 2 AND starts_with(hash, request)) GROUP BY 1""",
)
def _(spark, d):
    part_ = T.read_table(spark, d, "part")
    reg = part_.select(F.col("p_brand").alias("bucket")).distinct().withColumn("hash", F.substring(F.sha2("bucket", 256), 1, 12))
    req = (
        reg.select(F.col("bucket").alias("request"))
        .union(reg.select(F.substring("hash", 1, 2)))
        .union(reg.select(F.substring("hash", 1, 6)))
        .union(part_.select("p_type"))
        .distinct()
    )
    return J.resolve_bucket(req, reg)


@query(
    "parameter_precedence",
    """WITH def AS (SELECT p_type AS name, round(avg(p_size), 6) AS value, 5.0 AS low, 45.0 AS high FROM part GROUP BY 1),
       ses AS (SELECT c_custkey AS session_id, c_mktsegment AS preset FROM customer),
       pre AS (SELECT c_mktsegment AS preset, p_type AS name, (length(c_mktsegment) * 4 + length(p_type))::DOUBLE AS value FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT DISTINCT p_type FROM part WHERE length(p_type) % 2 = 0)),
       ovr AS (SELECT c_custkey AS session_id, p_type AS name, min(p_size)::DOUBLE AS value FROM customer JOIN part ON c_custkey = p_partkey WHERE p_size % 3 = 0 GROUP BY 1, 2)
       SELECT ses.session_id, def.name, coalesce(ovr.value, pre.value, def.value) AS value,
         CASE WHEN ovr.value IS NOT NULL THEN 'session' WHEN pre.value IS NOT NULL THEN 'preset' ELSE 'default' END AS origin
       FROM ses CROSS JOIN def LEFT JOIN pre ON pre.preset = ses.preset AND pre.name = def.name AND pre.value BETWEEN def.low AND def.high
       LEFT JOIN ovr ON ovr.session_id = ses.session_id AND ovr.name = def.name AND ovr.value BETWEEN def.low AND def.high""",
)
def _(spark, d):
    part_, customer = T.read_table(spark, d, "part"), T.read_table(spark, d, "customer")
    defaults = part_.groupBy(F.col("p_type").alias("name")).agg(F.round(F.avg("p_size"), 6).alias("value")).withColumns({"low": F.lit(5.0), "high": F.lit(45.0)})
    ses = customer.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("preset"))
    even = part_.filter(F.length("p_type") % 2 == 0).agg(F.collect_set("p_type").alias("names")).scalar()
    presets = customer.select(F.col("c_mktsegment").alias("preset")).distinct().withColumn("name", F.explode(even)).withColumn(
        "value", (F.length("preset") * 4 + F.length("name")).cast("double")
    )
    overrides = (
        customer.join(part_, F.col("c_custkey") == F.col("p_partkey"))
        .filter("p_size % 3 = 0")
        .groupBy(F.col("c_custkey").alias("session_id"), F.col("p_type").alias("name"))
        .agg(F.min("p_size").cast("double").alias("value"))
    )
    return J.effective_parameters(defaults, presets, overrides, ses)


@query(
    "candidate_sources",
    """SELECT file_id, list_sort(list(DISTINCT src)) AS sources, count(DISTINCT src)::BIGINT AS n FROM (
         SELECT o_orderkey AS file_id, 'total' AS src FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT l_orderkey, 'quantity' FROM lineitem WHERE l_quantity > 45
         UNION ALL SELECT l_orderkey, 'discount' FROM lineitem WHERE l_discount >= 0.1) GROUP BY 1""",
)
def _(spark, d):
    o, li = T.read_table(spark, d, "orders"), T.read_table(spark, d, "lineitem")
    rows = (
        o.filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("file_id"), F.lit("total").alias("src"))
        .union(li.filter("l_quantity > 45").select("l_orderkey", F.lit("quantity")))
        .union(li.filter("l_discount >= 0.1").select("l_orderkey", F.lit("discount")))
    )
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_set("src")).alias("sources")).withColumn("n", n64(F.size("sources"), "n"))


@query(
    "recalled_ids",
    """SELECT DISTINCT k AS file_id FROM ev WHERE event_type IN ('view', 'click') UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 20000""",
    ("ev",),
)
def _(spark, d):
    ledger = events(spark, d).filter(F.col("event_type").isin("view", "click")).select(F.col("k").alias("file_id"))
    legacy = T.read_table(spark, d, "orders").filter("o_orderstatus = 'P' AND o_totalprice < 20000").select("o_orderkey")
    return ledger.union(legacy).distinct()


@query(
    "vocabulary_without_hubs",
    """SELECT p_type AS tag, count(*) AS notes FROM part GROUP BY 1 HAVING NOT (count(*) >= 3 AND count(*) >= (SELECT count(*) FROM part) / 6.0)""",
)
def _(spark, d):
    tags = T.read_table(spark, d, "part").groupBy(F.col("p_type").alias("tag")).agg(F.count(F.lit(1)).alias("notes"))
    total = tags.agg(F.sum("notes").alias("t")).scalar()
    hubs = tags.withColumn("t", total).filter((F.col("notes") >= 3) & (F.col("notes") >= F.col("t") / 6)).select("tag")
    return tags.join(hubs, "tag", "left_anti")


@query(
    "new_tags",
    """SELECT o_orderpriority AS bucket, count(*) AS new_tags FROM (
         SELECT DISTINCT o_orderpriority, tag_id FROM file_tags JOIN orders ON o_orderkey = file_id WHERE o_orderdate >= TIMESTAMP '2000-01-01'
         EXCEPT SELECT DISTINCT o_orderpriority, tag_id FROM file_tags JOIN orders ON o_orderkey = file_id WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderstatus = 'F') GROUP BY 1""",
    ("file_tags",),
)
def _(spark, d):
    o = T.read_table(spark, d, "orders")
    both = T.file_tags(spark, d).join(o, F.col("file_id") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("bucket"), "tag_id", "o_orderdate", "o_orderstatus")
    cut = F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    given = both.filter(F.col("o_orderdate") >= cut).select("bucket", "tag_id").distinct()
    known = both.filter((F.col("o_orderdate") < cut) & (F.col("o_orderstatus") == "F")).select("bucket", "tag_id")
    return given.join(known, ["bucket", "tag_id"], "left_anti").groupBy("bucket").agg(F.count(F.lit(1)).alias("new_tags"))


@query(
    "selection_identity",
    """SELECT user_id, n, string_agg(key, ',' ORDER BY key) AS selection FROM (
         SELECT DISTINCT user_id, user_id::VARCHAR || ':' || k::VARCHAR AS key, count(DISTINCT k) OVER (PARTITION BY user_id) AS n FROM ev WHERE event_type = 'view' AND value > 50) GROUP BY ALL""",
    ("ev",),
)
def _(spark, d):
    keys = events(spark, d).filter("event_type = 'view' AND value > 50").select("user_id", F.concat_ws(":", "user_id", "k").alias("key")).distinct()
    return keys.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("selection"))


@query(
    "adjacent_tags",
    """SELECT tag_id AS src, nxt AS dst, count(*) AS steps FROM (SELECT tag_id, lead(tag_id) OVER (PARTITION BY file_id ORDER BY position) AS nxt FROM file_tags) WHERE nxt IS NOT NULL GROUP BY 1, 2""",
    ("file_tags",),
)
def _(spark, d):
    w = Window.partitionBy("file_id").orderBy("position")
    steps = T.file_tags(spark, d).select(F.col("tag_id").alias("src"), F.lead("tag_id").over(w).alias("dst")).filter("dst IS NOT NULL")
    return steps.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("steps"))


@query(
    "newest_note",
    """SELECT o_orderpriority AS bucket, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS file_id, max(o_orderdate) AS updated_at FROM orders GROUP BY 1""",
)
def _(spark, d):
    return T.note_files(spark, d).groupBy("bucket").agg(
        F.max_by("file_id", F.struct("updated_at", "file_id")).alias("file_id"), F.max("updated_at").alias("updated_at")
    )


@query(
    "retention_newest",
    """SELECT schema_version, artifact, updated_at, rank FROM (SELECT o_orderstatus AS schema_version, o_orderkey AS artifact, o_orderdate AS updated_at,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3""",
)
def _(spark, d):
    from tagloom.sinks.artifacts import newest_generations

    gens = T.read_table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("schema_version"), F.col("o_orderkey").alias("artifact"), F.col("o_orderdate").alias("updated_at")
    )
    return newest_generations(gens, keep=3)


__all__ = ["events", "sessions", "top_n", "r6"]
