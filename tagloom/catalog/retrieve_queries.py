"""End-to-end retrieval and remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog.base import query
from tagloom.catalog.curve_queries import points, scores
from tagloom.catalog.govern_queries import ledger_micros
from tagloom.catalog.graph_queries import inbound_mass, listed_graph, tag_vector_table, transport
from tagloom.catalog.join_queries import events, sessions
from tagloom.catalog.observe_queries import SPIKE, full_state, queries
from tagloom.catalog.rank_queries import chunks
from tagloom.functions.columns import r6
from tagloom.functions.time import micros
from tagloom.operators import graph as G
from tagloom.params import AuxiliaryParams, GraphParams
from tagloom.plans import observe as O
from tagloom.plans import rank_curve as D
from tagloom.plans import retrieve as E
from tagloom.plans import telemetry as M
from tagloom.plans.residuals import anchor_gains
from tagloom.session import staged
from tagloom.sources import tables as T


def corpus(spark, d, mode):
    """Tables of the corpus; the graph is staged when it is named, so a plain search goes without it."""
    stamps = T.note_files(spark, d).select("file_id", micros(F.col("updated_at")).alias("stamp"))
    vectors, graph = (None, None) if mode == "plain" else (tag_vector_table(spark, d), listed_graph(spark, d))
    return E.Corpus(T.tags(spark, d), vectors, T.file_tags(spark, d), chunks(spark, d), graph, stamps, None if mode == "plain" else inbound_mass(spark, d))


def run(spark, d, mode):
    clock = T.read_table(spark, d, "events").agg(micros(F.max("ts")).alias("t")).scalar()
    rows = E.retrieve(queries(spark, d), corpus(spark, d, mode), ledger_micros(spark, d), clock, mode, E.RetrievalParams(spike=SPIKE), observed=None if mode == "plain" else full_state(spark, d))
    return rows.select("query_id", "chunk_id", "rank", "role", r6(F.col("score"), "score"), r6(F.col("effective"), "effective"), "suppressed")


@query("retrieve_topology")
def _(spark, d):
    return run(spark, d, "topology")


@query("retrieve_curve")
def _(spark, d):
    return run(spark, d, "curve")


@query("retrieve_plain")
def _(spark, d):
    return run(spark, d, "plain")


@query("axis_basis")
def _(spark, d):
    return O.axis_basis(tag_vector_table(spark, d)).select("axis", r6(F.col("energy"), "energy"), "label")


def gains(spark, d):
    return staged(spark, d, "anchor_gains", lambda: anchor_gains(transport(spark, d), T.tag_vectors(spark, d), T.unit_vectors(spark, d)))


@query("anchor_gains")
def _(spark, d):
    return gains(spark, d)


@query("anchored_transport")
def _(spark, d):
    """Graph rebuilt with anchor gains on reverse edges and wormholes."""
    g = gains(spark, d)
    fact = G.fact_edges(T.file_tags(spark, d), GraphParams(reverse_anchor_boost=True), anchor=g)
    return G.transport_edges(fact, GraphParams(), g).select("src", "dst", r6(F.col("weight"), "weight"), "wormhole")


@query("auxiliary_floors")
def _(spark, d):
    out = D.auxiliary_floors(scores(spark, d), D.identity_contacts(points(spark, d)), AuxiliaryParams(identity=True))
    return out.select("query_id", "chunk_id", "evidence_class", r6(F.col("bonus"), "bonus"), r6(F.col("auxiliary"), "auxiliary"))


@query(
    "tree_report",
    """SELECT root_id, count(*) AS sessions, sum(coalesce(w, 0))::BIGINT AS writes, sum(coalesce(pr, 0))::BIGINT AS prompted, sum(inj)::BIGINT AS injected, sum(ov)::BIGINT AS overlap FROM tree
       LEFT JOIN (SELECT user_id, count(DISTINCT k) FILTER (WHERE v) AS inj, count(DISTINCT k) FILTER (WHERE v AND c) AS ov FROM (SELECT user_id, k, bool_or(event_type = 'view') AS v, bool_or(event_type = 'click') AS c FROM ev GROUP BY 1, 2) GROUP BY 1) ON user_id = session_id
       LEFT JOIN (SELECT session AS sid, count(*) AS w, count(*) FILTER (WHERE gap <= 600) AS pr FROM (SELECT user_id AS session, event_type, (epoch_us(ts) - epoch_us(last_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))) / 1e6 AS gap FROM events) WHERE event_type = 'purchase' GROUP BY 1) ON sid = session_id
       GROUP BY 1""",
    ("tree", "ev"),
)
def _(spark, d):
    e = events(spark, d)
    flags = e.groupBy("user_id", "k").agg(F.bool_or(F.col("event_type") == "view").alias("v"), F.bool_or(F.col("event_type") == "click").alias("c"))
    m = flags.groupBy(F.col("user_id").alias("session_id")).agg(F.count_if("v").alias("injected"), F.count_if(F.col("v") & F.col("c")).alias("overlap")).withColumns({"messages": F.lit(0), "reports": F.lit(1)})
    kind = F.when(F.col("event_type") == "error", "nudge").when(F.col("event_type") == "purchase", "write").otherwise("other")
    n = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"))
    return M.tree_report(sessions(spark, d), m, n).select("root_id", "sessions", "writes", "prompted", "injected", "overlap")


@query(
    "gate_calibration",
    """SELECT rule, count(*) FILTER (WHERE label = 1 AND NOT ok) AS misses, count(*) FILTER (WHERE label = 0 AND ok) AS false_passes FROM (
         SELECT label, unnest(['user_055', 'user_042', 'either_055', 'user_or_gap', 'either_or_gap', 'user_055_assistant_062']) AS rule,
           unnest([u >= 0.55, u >= 0.42, greatest(u, a) >= 0.55, u >= 0.55 OR greatest(u, a) - u > 0.25, greatest(u, a) >= 0.55 OR greatest(u, a) - u > 0.25, u >= 0.55 OR a >= 0.62]) AS ok FROM (
           SELECT (event_id % 2)::INTEGER AS label, coalesce(u, 0) AS u, coalesce(a, 0) AS a FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN value / 500 END IGNORE NULLS) OVER w AS u, last_value(CASE WHEN event_type = 'click' THEN value / 500 END IGNORE NULLS) OVER w AS a
             FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE event_type = 'purchase')) GROUP BY 1""",
)
def _(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").alias("at"), "event_type", "value")
    asked = e.filter("event_type = 'purchase'")
    said = e.filter("event_type IN ('view', 'click')").select("session_id", "at", F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"), F.col("event_id").alias("message_id"))
    score = e.select(F.col("event_id").alias("message_id"), (F.col("value") / 500).alias("score"))
    labels = asked.select("event_id", (F.col("event_id") % 2).cast("int").alias("label"))
    return M.gate_calibration(asked.select("session_id", "event_id", "at"), said, score, labels).select("rule", "misses", "false_passes")
