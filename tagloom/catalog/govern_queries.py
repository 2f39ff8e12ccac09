"""Selection and governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog.base import part, query
from tagloom.catalog.join_queries import events
from tagloom.catalog.ledger_queries import note_ledger, omega_samples, type_edges
from tagloom.catalog.neighbour_queries import centroids, group_means
from tagloom.catalog.graph_queries import tag_vector_table
from tagloom.catalog.rank_queries import matched_names_for, ranked
from tagloom.catalog.text_queries import DIM, document_vectors, tagged_notes
from tagloom.functions import text as X
from tagloom.functions.columns import r6
from tagloom.functions.time import micros
from tagloom.operators import ledger as L
from tagloom.operators.neighbours import top_neighbours
from tagloom.operators.running import top_n
from tagloom.plans import govern as V
from tagloom.plans import select as S
from tagloom.session import cut_lineage, staged
from tagloom.sources import tables as T


def hash_parts(name: str, source: str, uses: tuple[str, ...] = ()) -> None:
    """SQL parts for dense hash vectors of a (key, text) source: <name>_vec(key, v)."""
    part(f"{name}_src", source, uses)
    part(f"{name}_tok", f"SELECT key, token, count(*) AS c FROM (SELECT key, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS token FROM {name}_src) GROUP BY 1, 2", (f"{name}_src",))
    part(
        f"{name}_h",
        f"""SELECT key, c, h1, xor(xor(h1, 0) * 16777619 % 4294967296, 120) * 16777619 % 4294967296 AS h2 FROM (SELECT key, c, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: xor(h, x) * 16777619 % 4294967296) AS h1 FROM {name}_tok)""",
        (f"{name}_tok",),
    )
    part(f"{name}_raw", f"SELECT key, slot, sum(w) AS w FROM (SELECT key, (h1 % {DIM})::INTEGER AS slot, c * 1.0e0 AS w FROM {name}_h UNION ALL SELECT key, (h2 % {DIM})::INTEGER, c * 0.5e0 FROM {name}_h) GROUP BY 1, 2", (f"{name}_h",))
    part(
        f"{name}_vec",
        f"""SELECT g.key, list(coalesce(w, CASE WHEN i = 0 AND NOT has THEN 1 ELSE 0 END)::DOUBLE ORDER BY i) AS v FROM (SELECT k.key, k.has, r.i FROM (SELECT s.key, count(x.slot) > 0 AS has FROM {name}_src s LEFT JOIN {name}_raw x USING (key) WHERE s.text IS NOT NULL GROUP BY 1) k
            CROSS JOIN range({DIM}) r(i)) g LEFT JOIN {name}_raw q ON q.key = g.key AND q.slot = g.i GROUP BY ALL""",
        (f"{name}_src", f"{name}_raw"),
    )


hash_parts(
    "gate",
    r"""SELECT conv_id * 3 AS key, max_by(regexp_replace(text, '^\s+|\s+$', '', 'g'), turn) FILTER (WHERE role = 'user') AS text FROM conversations GROUP BY conv_id
        UNION ALL SELECT conv_id * 3 + 1, max_by(left(text, 1200), turn) FILTER (WHERE role = 'assistant' AND length(text) > 150) FROM conversations GROUP BY conv_id
        UNION ALL SELECT conv_id * 3 + 2, right(string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY turn), 4000) FROM (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE length(trim(text)) > 0) WHERE rn <= 6 GROUP BY conv_id""",
)
part(
    "gate_best",
    """SELECT key, max(s) AS s FROM (SELECT g.key, round(list_inner_product(g.v, d.v) / (sqrt(list_inner_product(g.v, g.v)) * sqrt(list_inner_product(d.v, d.v))), 9) AS s FROM gate_vec g CROSS JOIN doc_vec d) GROUP BY 1""",
    ("gate_vec", "doc_vec"),
)
part(
    "gates",
    """SELECT c AS session_id, u.s AS u, a.s AS a, w.s AS w, CASE WHEN a.s >= 0.62 AND (u.s IS NULL OR a.s >= u.s) THEN 'assistant' WHEN u.s >= 0.55 THEN 'current' WHEN u.s IS NULL AND a.s IS NULL THEN 'window' WHEN a.s IS NOT NULL AND (u.s IS NULL OR a.s > u.s) THEN 'assistant' ELSE 'current' END AS gate_vector,
         coalesce(u.s >= 0.55, false) OR coalesce(a.s >= 0.62, false) OR (u.s IS NULL AND a.s IS NULL AND coalesce(w.s >= 0.55, false)) AS passed
       FROM (SELECT DISTINCT conv_id AS c FROM conversations) LEFT JOIN gate_best u ON u.key = c * 3 LEFT JOIN gate_best a ON a.key = c * 3 + 1 LEFT JOIN gate_best w ON w.key = c * 3 + 2""",
    ("gate_best",),
)


def gate_table(spark, d):
    """Largest cosine of each session's three texts to the documents, and the verdict."""
    turns = T.read_table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    texts = S.gate_texts(turns, X.query_fields(turns))
    long = texts.select("session_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("text")) for i, c in enumerate(("user_text", "assistant_text", "window_text"))])).alias("t"))
    keyed = long.select((F.col("session_id") * 3 + F.col("t.i")).alias("query_id"), F.col("t.text").alias("text")).filter("text IS NOT NULL")
    vectors = staged(spark, d, "gate_vectors", lambda: X.sparse_vectors(X.hash_slots(keyed, "query_id", "text", DIM), "query_id", DIM))
    best = top_neighbours(vectors, document_vectors(spark, d).select(F.col("doc_id").alias("item_id"), "vector"), 1)
    which = F.col("query_id") % 3
    pivot = best.groupBy(F.floor(F.col("query_id") / 3).alias("session_id")).agg(
        *[F.max(F.when(which == i, F.col("score"))).alias(n) for i, n in enumerate(("user", "assistant", "window"))]
    )
    return S.gate(turns.select("session_id").distinct().join(pivot, "session_id", "left"))


@query(
    "gate_decision",
    "SELECT session_id, round(u, 6) AS user, round(a, 6) AS assistant, round(w, 6) AS window, gate_vector, passed FROM gates",
    ("gates",),
)
def _(spark, d):
    return gate_table(spark, d).select("session_id", *[r6(F.col(x), x) for x in ("user", "assistant", "window")], "gate_vector", "passed")


part(
    "ledger_us",
    """SELECT file_id, passive, active, epoch_us(last_passive_at) AS lp, epoch_us(last_active_at) AS la FROM ledger_all""",
    ("ledger_all",),
)
part(
    "adjusted",
    """SELECT *, CASE WHEN pool >= 5 THEN score - CASE WHEN passive > 0 AND nw >= lp THEN 0.08e0 * tanh(passive / 2e0) * exp(-(nw - lp) / 3.6e9 * ln(2) / 24) ELSE 0 END ELSE score END AS effective FROM (
         SELECT r.query_id, r.chunk_id, r.rank, suppressed, pool, passive, lp, nw, base + CASE WHEN active > 0 AND la IS NOT NULL AND pool > 1 THEN 0.05e0 * tanh(active / 2e0) * exp(-greatest(nw - la, 0) / 8.64e10 * ln(2) / 30) ELSE 0 END AS score FROM (
           SELECT k.query_id, k.chunk_id, k.rank, c.query_score < 0.6 AS suppressed, CASE WHEN c.query_score < 0.6 THEN c.query_score ELSE k.score END AS base, count(*) OVER (PARTITION BY k.query_id) AS pool, (SELECT epoch_us(max(ts)) FROM events) AS nw
           FROM ranked k JOIN cands c USING (query_id, chunk_id)) r LEFT JOIN ledger_us l ON l.file_id = r.chunk_id)""",
    ("ranked", "cands", "ledger_us"),
)


def ledger_micros(spark, d):
    return note_ledger(spark, d).select("file_id", "passive", "active", micros(F.col("last_passive_at")).alias("last_passive_at"), micros(F.col("last_active_at")).alias("last_active_at"))


def adjusted(spark, d):
    stamp = T.note_files(spark, d).select("file_id", micros(F.col("updated_at")).alias("stamp"))
    rows = ranked(spark, d).select("query_id", "chunk_id", "file_id", F.col("query_score").alias("knn"), F.col("score").alias("raw_score"), "rank", "role", "anchor_bonus", "topology_bonus", "omega", "regime").join(stamp, "file_id")
    clock = T.read_table(spark, d, "events").agg(micros(F.max("ts")).alias("t")).scalar()
    return S.adjusted_scores(rows, ledger_micros(spark, d), clock)


@query(
    "score_adjustment",
    "SELECT query_id::BIGINT AS query_id, chunk_id, suppressed, round(score, 6) AS score, round(effective, 6) AS effective FROM adjusted",
    ("adjusted",),
)
def _(spark, d):
    return adjusted(spark, d).select("query_id", "chunk_id", "suppressed", r6(F.col("score"), "score"), r6(F.col("effective"), "effective"))


@query(
    "adaptive_k",
    """SELECT user_id, pool, greatest(1, floor(CASE WHEN pool >= 5 THEN greatest(3, least(ceil(0.6e0 * pool), 16)) ELSE 3 END * 1.2e0 + 0.5e0))::INTEGER AS seats FROM (SELECT user_id, count(DISTINCT regexp_extract(props, '\\d+')) AS pool FROM events WHERE event_type = 'signup' GROUP BY 1)""",
)
def _(spark, d):
    pools = events(spark, d).filter("event_type = 'signup'").groupBy("user_id").agg(F.count_distinct("k").alias("pool"))
    return pools.withColumn("seats", S.seat_count(F.col("pool"), 1.2))


def seats(spark, d):
    def build():
        n = T.read_table(spark, d, "documents").count()
        docs = T.read_table(spark, d, "documents").select((F.col("doc_id")).alias("doc"), X.estimate_tokens(F.col("text")).alias("t"), X.estimate_tokens(X.first_sentence(F.col("text"))).alias("s"))
        x = adjusted(spark, d).withColumn("doc", F.col("chunk_id") % n).join(docs, "doc")
        title = X.estimate_tokens(F.concat(F.lit("order/"), F.col("file_id").cast("string")))
        x = x.withColumns({"tokens": F.col("t") + title + 24, "short_tokens": F.col("s") + title + 24}).join(matched_names_for(spark, d).withColumnRenamed("matched_tags", "tags"), ["query_id", "chunk_id"], "left")
        clock = T.read_table(spark, d, "events").agg(micros(F.max("ts")).alias("t")).scalar()
        return S.select_seats(x, clock)

    return staged(spark, d, "seats", build)


@query("seat_selection")
def _(spark, d):
    return seats(spark, d)


@query("injection_block")
def _(spark, d):
    n = T.read_table(spark, d, "documents").count()
    docs = T.read_table(spark, d, "documents").select(F.col("doc_id").alias("doc"), X.excerpt(F.col("text")).alias("body"))
    rows = seats(spark, d).join(adjusted(spark, d), ["query_id", "chunk_id"]).join(matched_names_for(spark, d).withColumnRenamed("matched_tags", "tags"), ["query_id", "chunk_id"], "left")
    rows = rows.withColumn("doc", F.col("chunk_id") % n).join(docs, "doc").join(T.chunk_vectors(spark, d).select("chunk_id", "bucket"), "chunk_id")
    rows = rows.withColumns({"title": F.concat(F.lit("order/"), F.col("file_id").cast("string")), "mode": F.lit("topology"), "origin": F.col("bucket"), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    dropped = rows.filter("seat IS NULL").select("query_id", "chunk_id", F.col("outcome").alias("reason"), F.col("rank").alias("order"))
    return S.render(rows.filter("seat IS NOT NULL"), dropped)


part(
    "fed_rows",
    """SELECT u.user_id AS query_id, n.n_regionkey AS bucket, o.o_orderkey AS chunk_id, round(o.o_totalprice / 1e6, 6) AS score FROM (SELECT DISTINCT user_id FROM events) u JOIN customer c ON c.c_custkey = u.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN orders o ON o.o_custkey = c.c_custkey
       UNION ALL SELECT u.user_id, (n.n_regionkey + 1) % 5, o.o_orderkey, round(o.o_totalprice / 2e6, 6) FROM (SELECT DISTINCT user_id FROM events) u JOIN customer c ON c.c_custkey = u.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN orders o ON o.o_custkey = c.c_custkey
       UNION ALL SELECT u.user_id, (n.n_regionkey + 2) % 5, o.o_orderkey, round(o.o_totalprice / 3e6, 6) FROM (SELECT DISTINCT user_id FROM events) u JOIN customer c ON c.c_custkey = u.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN orders o ON o.o_custkey = c.c_custkey""",
)


@query(
    "federated_merge",
    """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, CASE WHEN turn = 0 THEN 0 ELSE pidx END, score DESC, chunk_id)::INTEGER AS position, bucket AS origin, chunk_id, score FROM (
         SELECT f.*, p.pidx, CASE WHEN p.pidx = 0 THEN 0 ELSE row_number() OVER (PARTITION BY f.query_id, f.bucket ORDER BY score DESC, chunk_id) END AS turn
         FROM fed_rows f JOIN (SELECT c_custkey AS query_id, (n_regionkey + i) % 5 AS bucket, i AS pidx FROM customer JOIN nation ON n_nationkey = c_nationkey CROSS JOIN range(3) r(i)) p USING (query_id, bucket)) WHERE turn <= 2""",
    ("fed_rows",),
)
def _(spark, d):
    users = T.read_table(spark, d, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    region = T.read_table(spark, d, "customer").join(T.read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(users, "c_custkey").select(F.col("c_custkey").alias("query_id"), F.col("n_regionkey").alias("r"))
    o = T.read_table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), "o_totalprice")
    lanes = F.explode(F.array(*[F.struct(F.lit(i).alias("i")) for i in range(3)]))
    parents = region.withColumn("l", lanes).select("query_id", ((F.col("r") + F.col("l.i")) % 5).alias("bucket"), F.col("l.i").alias("parent_idx"))
    rows = o.join(parents, "query_id").select("query_id", "bucket", "chunk_id", F.round(F.col("o_totalprice") / (F.col("parent_idx") + 1) / 1e6, 6).alias("score"))
    return S.federate(rows, parents)


@query(
    "repeat_suppression",
    """WITH RECURSIVE numbered AS MATERIALIZED (
         SELECT user_id AS session_id, event_id AS turn, CASE WHEN value < 100 THEN 'low' ELSE 'high' END AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
       ), walk AS (
         SELECT session_id, turn, key, n, true AS shown, turn AS last_shown FROM numbered WHERE n = 1
         UNION ALL
         SELECT x.session_id, x.turn, x.key, x.n, x.key <> w.key OR x.turn - w.last_shown >= 8, CASE WHEN x.key <> w.key OR x.turn - w.last_shown >= 8 THEN x.turn ELSE w.last_shown END
         FROM walk w JOIN numbered x ON x.session_id = w.session_id AND x.n = w.n + 1
       ) SELECT session_id, turn, key, shown FROM walk""",
)
def _(spark, d):
    key = F.when(F.col("value") < 100, "low").otherwise("high")
    return S.suppress_repeats(T.read_table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), key.alias("key")))


@query(
    "newest_steps",
    """SELECT session_id, turn, step, seq FROM (SELECT *, max(turn * 1000 + step) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT user_id AS session_id, epoch_us(ts) // 86400000000 AS turn, k AS step, event_id AS seq FROM ev))
       WHERE best IS NULL OR turn * 1000 + step > best""",
    ("ev",),
)
def _(spark, d):
    day = F.floor(micros(F.col("ts")) / F.lit(86_400_000_000))
    return S.newest_steps(events(spark, d).select(F.col("user_id").alias("session_id"), day.alias("turn"), F.col("k").alias("step"), F.col("event_id").alias("seq")))


@query(
    "ranking_mode",
    """SELECT query_id::BIGINT AS query_id, chunk_id, rank, round(score, 6) AS score, 'topology' AS mode FROM ranked WHERE query_id % 2 = 0
       UNION ALL SELECT query_id, chunk_id, rank, round(score, 6), 'curve' FROM dranked WHERE query_id % 2 = 1""",
    ("ranked", "dranked"),
)
def _(spark, d):
    from tagloom.catalog.curve_queries import curve_ranked

    modes = centroids(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, "topology").otherwise("curve").alias("mode"))
    cols = ("query_id", "chunk_id", "rank", "score")
    return S.pick_mode(modes, topology=ranked(spark, d).select(*cols), curve=curve_ranked(spark, d).select(*cols)).withColumn("score", F.round("score", 6))


part(
    "gated_notes",
    """SELECT doc_id, CASE WHEN length(trim(array_to_string(words[1:3], ' '))) = 0 THEN 'missing-title' WHEN n = 0 THEN 'missing-tag-line' WHEN n > 5 THEN 'too-many-tags' WHEN n < 3 THEN 'too-few-tags' WHEN lt > 20 THEN 'tag-too-long'
         WHEN nn > 0 AND doc_id % 3 = 0 THEN 'unconfirmed-new-tags' END AS reason FROM (
           SELECT doc_id, words, len(list_filter(words, lambda x: x IS NOT NULL)) AS n, list_max(list_transform(words, lambda x: length(x))) AS lt, len(list_filter(words, lambda x: x IN ('The', 'In', 'De', 'La', 'Die', 'And'))) AS nn FROM tagged_notes)""",
    ("tagged_notes",),
)


@query("admission_gate", "SELECT doc_id, reason AS reject_reason FROM gated_notes", ("gated_notes",))
def _(spark, d):
    c = F.col("content")
    tags = X.parse_tag_line(c)
    known = F.array(*[F.lit(w) for w in ("The", "In", "De", "La", "Die", "And")])
    notes = tagged_notes(spark, d).select(
        "doc_id", "content", X.heading(c).alias("title"), tags.alias("tags"), F.filter(tags, lambda t: F.array_contains(known, t)).alias("new_tags"),
        F.when(F.col("doc_id") % 3 != 0, "needed").alias("new_tag_reason"),
    )
    return V.admission(notes).select("doc_id", "reject_reason")


@query(
    "admission_summary",
    "SELECT coalesce(reason, 'admitted') AS outcome, count(*) AS notes FROM gated_notes GROUP BY 1",
    ("gated_notes",),
)
def _(spark, d):
    from tagloom.catalog.base import QUERIES

    return QUERIES["admission_gate"](spark, d).groupBy(F.coalesce("reject_reason", F.lit("admitted")).alias("outcome")).agg(F.count(F.lit(1)).alias("notes"))


@query(
    "hub_gate",
    """SELECT note_id, CASE WHEN tag_id IS NULL OR mode = 'off' THEN 'pass' WHEN mode = 'enforce' THEN 'reject' ELSE 'observe' END AS verdict, tag_id FROM (SELECT o_orderkey AS note_id, CASE o_orderstatus WHEN 'F' THEN 'off' WHEN 'O' THEN 'suggest' ELSE 'enforce' END AS mode FROM orders)
       LEFT JOIN (SELECT l_orderkey AS note_id, min(p_type) AS tag_id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN type_counts t ON t.bucket = o_orderpriority AND t.tag_id = p_type AND t.files / t.total >= 1 / 3.0 GROUP BY 1) USING (note_id)""",
    ("type_counts",),
)
def _(spark, d):
    files = T.note_files(spark, d)
    counts = L.bucket_tag_counts(files, type_edges(spark, d))
    types = T.read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("tag_id"))
    new = T.read_table(spark, d, "lineitem").join(types, "l_partkey").select(F.col("l_orderkey").alias("note_id"), "tag_id").join(files.select(F.col("file_id").alias("note_id"), "bucket"), "note_id")
    mode = F.when(F.col("o_orderstatus") == "F", "off").when(F.col("o_orderstatus") == "O", "suggest").otherwise("enforce")
    modes = T.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), mode.alias("mode"))
    return V.hub_gate(new, counts, modes).select("note_id", "verdict", "tag_id")


@query(
    "synonym_drift",
    """SELECT label::BIGINT AS query_id, tag_id AS item_id, round(s, 6) AS score, s > 0.92 AS drift FROM (SELECT label, tag_id, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, tag_id) AS rn FROM (
         SELECT c.label, t.tag_id, round(list_inner_product(c.v, t.v) / (sqrt(list_inner_product(c.v, c.v)) * sqrt(list_inner_product(t.v, t.v))), 9) AS s FROM centroid c CROSS JOIN tag_vec t)) WHERE rn = 1""",
    ("centroid", "tag_vec"),
)
def _(spark, d):
    return V.synonym_drift(centroids(spark, d), tag_vector_table(spark, d).withColumnRenamed("tag_id", "item_id")).withColumn("score", F.round("score", 6))


part("brand_counts", "SELECT o_orderpriority AS bucket, p_brand AS tag_id, count(DISTINCT o_orderkey) AS files, any_value(t.total) AS total FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN (SELECT o_orderpriority AS b, count(*) AS total FROM orders GROUP BY 1) t ON t.b = o_orderpriority GROUP BY 1, 2")


def brand_counts(spark, d):
    brands = T.read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tag_id"))
    edges = T.read_table(spark, d, "lineitem").join(brands, "l_partkey").select(F.col("l_orderkey").alias("file_id"), "tag_id").distinct()
    return L.bucket_tag_counts(T.note_files(spark, d), edges)


@query(
    "frequent_alternatives",
    """SELECT bucket, tag_id, alternative, files, rank FROM (SELECT h.bucket, h.tag_id, b.tag_id AS alternative, b.files, row_number() OVER (PARTITION BY h.bucket, h.tag_id ORDER BY b.files DESC, b.tag_id)::INTEGER AS rank
       FROM (SELECT * FROM type_counts WHERE files / total >= 1 / 3.0) h JOIN (SELECT * FROM brand_counts UNION ALL SELECT * FROM type_counts) b ON b.bucket = h.bucket AND b.files / b.total < 1 / 3.0 AND b.tag_id <> h.tag_id) WHERE rank <= 5""",
    ("type_counts", "brand_counts"),
)
def _(spark, d):
    types = L.bucket_tag_counts(T.note_files(spark, d), type_edges(spark, d))
    rejected = types.filter(F.col("files") / F.col("total") >= 1 / 3).select("bucket", "tag_id")
    return V.frequent_alternatives(rejected, types.unionByName(brand_counts(spark, d)))


part(
    "brand_vec",
    "SELECT p_brand, list(c ORDER BY i) AS v FROM (SELECT p_brand, i, avg(x) AS c FROM (SELECT p_brand, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM tag_vec JOIN part ON p_partkey = tag_id) GROUP BY 1, 2) GROUP BY 1",
    ("tag_vec",),
)


@query(
    "hub_alternatives",
    """SELECT query_id, item_id, bucket, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id)::INTEGER AS rank FROM (
         SELECT a.bucket, regexp_extract(a.tag_id, '\\d+')::BIGINT * 10 + left(a.bucket, 1)::BIGINT AS query_id, regexp_extract(b.tag_id, '\\d+')::BIGINT * 10 + left(b.bucket, 1)::BIGINT AS item_id,
           round(list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))), 9) AS s
         FROM brand_counts a JOIN brand_counts b ON a.bucket = b.bucket AND a.files / a.total >= 0.15 AND b.files / b.total < 0.15 JOIN brand_vec x ON x.p_brand = a.tag_id JOIN brand_vec y ON y.p_brand = b.tag_id)) WHERE rank <= 5""",
    ("brand_counts", "brand_vec"),
)
def _(spark, d):
    """Brands at or above 15 % of a bucket count as hubs here; the nearest smaller brands replace them."""
    brands = T.read_table(spark, d, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_brand").alias("brand"))
    means = group_means(tag_vector_table(spark, d).join(brands, "tag_id"), "brand").withColumnRenamed("brand", "tag_id")
    ident = F.regexp_extract("tag_id", r"\d+", 0).cast("bigint") * 10 + F.substring("bucket", 1, 1).cast("bigint")
    counts = brand_counts(spark, d).join(means, "tag_id").withColumn("id", ident)
    rejected = counts.filter(F.col("files") / F.col("total") >= 0.15).withColumnRenamed("id", "query_id")
    out = V.hub_alternatives(rejected, counts.withColumnRenamed("id", "item_id"), ratio=0.15)
    return out.join(rejected.select("query_id", "bucket"), "query_id").select("query_id", "item_id", "bucket", "rank", r6(F.col("score"), "score"))


part("suggestions", "SELECT o_orderkey AS note_id, o_orderpriority AS bucket, p_type AS tag_id, min(l_linenumber) AS position FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3")


def suggestions(spark, d):
    types = T.read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("tag_id"))
    files = T.note_files(spark, d).select(F.col("file_id").alias("l_orderkey"), "bucket")
    return T.read_table(spark, d, "lineitem").join(types, "l_partkey").join(files, "l_orderkey").groupBy(F.col("l_orderkey").alias("note_id"), "bucket", "tag_id").agg(F.min("l_linenumber").alias("position"))


@query(
    "cold_tags",
    """SELECT note_id, list(tag_id ORDER BY rn) AS tags FROM (SELECT note_id, tag_id, row_number() OVER (PARTITION BY note_id ORDER BY tier, position, tag_id) AS rn FROM (
         SELECT s.note_id, s.tag_id, 0 AS tier, s.position FROM suggestions s LEFT JOIN vocab v ON v.bucket = s.bucket AND v.tag_id = s.tag_id WHERE NOT coalesce(v.hub, false)
         UNION ALL SELECT n.note_id, v.tag_id, 1, v.rk FROM (SELECT DISTINCT note_id, bucket FROM suggestions) n JOIN vocab v ON v.bucket = n.bucket AND NOT v.hub WHERE NOT EXISTS (SELECT 1 FROM suggestions s WHERE s.note_id = n.note_id AND s.tag_id = v.tag_id))) WHERE rn <= 4 GROUP BY 1""",
    ("suggestions", "vocab"),
)
def _(spark, d):
    types = L.bucket_tag_counts(T.note_files(spark, d), type_edges(spark, d))
    return V.cold_tags(suggestions(spark, d), types.unionByName(brand_counts(spark, d)))


part(
    "vocab",
    "SELECT *, row_number() OVER (PARTITION BY bucket, hub ORDER BY files DESC, tag_id) AS rk FROM (SELECT *, files >= 3 AND files >= total / 3.0 AS hub FROM (SELECT * FROM type_counts UNION ALL SELECT * FROM brand_counts))",
    ("type_counts", "brand_counts"),
)
part("recent_notes", "SELECT * FROM (SELECT o_orderkey AS file_id, o_orderpriority AS bucket, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) WHERE rn <= 12")


@query(
    "same_axis",
    """SELECT note_id, max_by(file_id, (overlap, -file_id)) AS hit, max(overlap) AS overlap FROM (SELECT s.note_id, r.file_id, count(DISTINCT s.tag_id) AS overlap FROM suggestions s JOIN recent_notes r ON r.bucket = s.bucket AND r.file_id <> s.note_id
         JOIN suggestions t ON t.note_id = r.file_id AND t.tag_id = s.tag_id GROUP BY 1, 2 HAVING count(DISTINCT s.tag_id) >= 2) GROUP BY 1""",
    ("suggestions", "recent_notes"),
)
def _(spark, d):
    s = suggestions(spark, d)
    have = s.select(F.col("note_id").alias("file_id")).distinct()
    recent = top_n(T.note_files(spark, d).join(have, "file_id", "left_semi"), ["bucket"], [F.desc("updated_at"), F.asc("file_id")], 12)
    tags = recent.select("bucket", "file_id").join(s.select(F.col("note_id").alias("file_id"), "tag_id"), "file_id")
    return V.same_axis(s, tags)


@query("draft_precheck")
def _(spark, d):
    """Conversations as drafts: nearest documents by hash vector, nearest tag names, hub tags dropped."""
    c = T.read_table(spark, d, "conversations").groupBy(F.col("conv_id").alias("draft_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("text"))
    v = staged(spark, d, "draft_vectors", lambda: X.sparse_vectors(X.hash_slots(c, "draft_id", "text", DIM), "draft_id", DIM)).withColumnRenamed("draft_id", "query_id")
    twins = top_neighbours(v, document_vectors(spark, d).select(F.col("doc_id").alias("item_id"), "vector"), 1).select(F.col("query_id").alias("draft_id"), "score")
    names = T.tags(spark, d).groupBy("name").agg(F.min("tag_id").alias("item_id"))
    tv = staged(spark, d, "name_vectors", lambda: X.sparse_vectors(X.hash_slots(names.select("item_id", "name"), "item_id", "name", DIM), "item_id", DIM))
    hits = top_neighbours(v, tv, 5).filter("score > 0").select(F.col("query_id").alias("draft_id"), F.col("item_id").alias("tag_id"), "rank")
    hubs = names.filter(F.length("name") < 9).select(F.col("item_id").alias("tag_id"))
    return V.draft_precheck(c.select("draft_id"), hits, hubs, twins)


@query(
    "vocabulary",
    "SELECT bucket, tag_id, files, hub, rk::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY files DESC, tag_id) AS rk FROM (SELECT *, files >= 3 AND files >= total / 3.0 AS hub FROM (SELECT * FROM type_counts UNION ALL SELECT * FROM brand_counts))) WHERE rk <= 30",
    ("type_counts", "brand_counts"),
)
def _(spark, d):
    counts = L.hub_columns(L.bucket_tag_counts(T.note_files(spark, d), type_edges(spark, d)).unionByName(brand_counts(spark, d)))
    return top_n(counts, ["bucket"], [F.desc("files"), F.asc("tag_id")], 30).select("bucket", "tag_id", "files", F.col("hub_by_count").alias("hub"), "rank")


@query(
    "patrol_hubs",
    """SELECT bucket, tag_id, files AS affected, round(files / total, 6) AS ratio, notes FROM type_counts JOIN (SELECT bucket AS b, tag_id AS t, list(note_id ORDER BY note_id) AS notes FROM suggestions GROUP BY 1, 2) ON b = bucket AND t = tag_id WHERE files / total >= 1 / 3.0""",
    ("type_counts", "suggestions"),
)
def _(spark, d):
    files, edges = T.note_files(spark, d), type_edges(spark, d)
    return V.patrol_hubs(L.bucket_tag_counts(files, edges), files, edges).withColumn("ratio", F.round("ratio", 6))


@query(
    "patrol_untitled",
    r"SELECT doc_id AS file_id, source AS bucket FROM documents WHERE NOT regexp_matches(text, '^\s*# [^\n]*\S')",
)
def _(spark, d):
    return V.patrol_untitled(T.text_notes(spark, d)).select("file_id", "bucket")


@query(
    "retag_check",
    "SELECT bucket, tag_id, files, files < total * (1 / 3e0) AS allowed FROM brand_counts",
    ("brand_counts",),
)
def _(spark, d):
    brands = T.read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tag_id"))
    plan = T.read_table(spark, d, "lineitem").join(brands, "l_partkey").select(F.col("l_orderkey").alias("file_id"), "tag_id").distinct()
    return V.retag_check(plan, T.note_files(spark, d)).select("bucket", "tag_id", "files", "allowed")


@query(
    "orphan_notes",
    "SELECT 'order/' || o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(spark, d):
    known = T.read_table(spark, d, "lineitem").select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"))
    return T.note_files(spark, d).select("path").join(known, "path", "left_anti")


@query(
    "health_report",
    """SELECT bucket, files, hub_tag, hub_files, round(hub_ratio, 6) AS hub_ratio, round(omega_mean, 6) AS omega_mean, round(uncov, 6) AS uncovered, concat_ws(',', CASE WHEN hub_ratio >= 1 / 3.0 THEN 'hub' END, CASE WHEN uncov > 0.5 THEN 'uncovered' END) AS warnings FROM (
         SELECT o_orderpriority AS bucket, count(*) AS files, count(*) FILTER (WHERE l.file_id IS NULL) / count(*) AS uncov FROM orders LEFT JOIN ledger_all l ON l.file_id = o_orderkey GROUP BY 1)
       JOIN (SELECT bucket, max_by(tag_id, (files, -tag_id)) AS hub_tag, max(files) AS hub_files, max(files / total) AS hub_ratio FROM (SELECT o_orderpriority AS bucket, tag_id, count(*) AS files, any_value(total) AS total FROM file_tags JOIN orders ON o_orderkey = file_id JOIN (SELECT o_orderpriority AS b, count(*) AS total FROM orders GROUP BY 1) ON b = o_orderpriority GROUP BY 1, 2) GROUP BY 1) USING (bucket)
       JOIN (SELECT o_orderpriority AS bucket, avg(value / 500) AS omega_mean FROM (SELECT o_orderpriority, value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts DESC, event_id DESC) AS rn FROM events JOIN orders ON o_orderkey = event_id) WHERE rn <= 50 GROUP BY 1) USING (bucket)""",
    ("ledger_all", "file_tags"),
)
def _(spark, d):
    from tagloom.operators.components import tag_components

    files, edges = T.note_files(spark, d).select("bucket", "file_id"), T.file_tags(spark, d)
    comp = tag_components(edges)
    local = edges.join(files, "file_id").join(comp, "tag_id").groupBy("bucket").agg(F.count_distinct("component").alias("components"))
    samples = omega_samples(spark, d).drop("bucket").join(files.withColumnRenamed("file_id", "sample_id"), "sample_id")
    omega = L.omega_distribution(samples).select("bucket", "mean")
    un = L.uncovered(files, note_ledger(spark, d).select("bucket", "file_id")).select("bucket", "ratio")
    h = V.health(files, edges, local, omega, un)
    return h.select("bucket", "files", "hub_tag", "hub_files", *[r6(F.col(x), x) for x in ("hub_ratio", "omega_mean", "uncovered")], "warnings")


@query("corpus_criteria")
def _(spark, d):
    from tagloom.operators.components import tag_components
    from tagloom.operators.joins import compare_by_key, orphan_tags

    # Written once: five criteria read the edges, two the counts, and no task sorts and ranks the lines beside its own sums.
    files, edges = T.note_files(spark, d), cut_lineage(T.file_tags(spark, d), "edges")
    counts = cut_lineage(L.bucket_tag_counts(files, edges), "bucket-counts")
    bodies = T.read_table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("h"))
    report = L.tag_frequency(T.tags(spark, d).select("tag_id"), edges).join(counts.groupBy("tag_id").agg(F.sum("files").alias("sum")), "tag_id", "left").select((F.col("files") == F.coalesce("sum", F.lit(0))).alias("agrees"))
    return V.corpus_criteria(tag_components(edges), counts, orphan_tags(T.tags(spark, d), edges), compare_by_key(bodies, bodies, "path", "h"), report)

