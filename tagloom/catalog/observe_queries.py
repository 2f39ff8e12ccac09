"""Observation and field queries. The query batch is the mean vector of every embedding label."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog.base import part, query
from tagloom.catalog.graph_queries import blocked_graph, listed_graph, tag_vector_table
from tagloom.catalog.neighbour_queries import centroids
from tagloom.functions.columns import r6
from tagloom.params import FieldParams, SpikeParams
from tagloom.plans import fields as FD
from tagloom.plans import observe as O
from tagloom.session import staged
from tagloom.sources import tables as T

# Wide graph with small conductances: thresholds low enough for every hop to carry current.
SPIKE = SpikeParams(firing=1e-9, min_current=1e-9)
STEPS = FD.series_length(FieldParams().alpha_transfer)


def queries(spark, d):
    return staged(spark, d, "queries", lambda: centroids(spark, d))


def seeds(spark, d):
    return staged(spark, d, "seeds", lambda: O.cosine_seeds(queries(spark, d), tag_vector_table(spark, d)))


def observation(spark, d):
    if_missing = {}

    def build(which):
        if not if_missing:
            if_missing["nodes"], if_missing["edges"] = O.propagate(seeds(spark, d), listed_graph(spark, d), SPIKE)
        return if_missing[which]

    return staged(spark, d, "obs_nodes", lambda: build("nodes")), staged(spark, d, "obs_edges", lambda: build("edges"))


def fields(spark, d):
    nodes, _ = observation(spark, d)
    return staged(spark, d, "fields", lambda: FD.field_domains(FD.dual_fields(nodes, blocked_graph(spark, d))))


part("qv", "SELECT label AS query_id, v, sqrt(list_inner_product(v, v)) AS m FROM centroid", ("centroid",))
part("tv", "SELECT tag_id, v, sqrt(list_inner_product(v, v)) AS m FROM tag_vec", ("tag_vec",))
part(
    "seeds",
    """SELECT query_id, tag_id, s AS energy FROM (SELECT query_id, tag_id, round(list_inner_product(qv.v, tv.v) / (qv.m * tv.m), 9) AS s,
         row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(qv.v, tv.v) / (qv.m * tv.m), 9) DESC, tag_id) AS rn FROM qv CROSS JOIN tv) WHERE rn <= 10 AND s > 0""",
    ("qv", "tv"),
)
part(
    "out20",
    """SELECT src, dst, weight, wormhole OR weight >= 1.0 AS worm FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM transport) WHERE rn <= 20""",
    ("transport",),
)
W = SPIKE.hop_weights()
part("st0", "SELECT query_id, NULL::BIGINT AS prev, tag_id AS node, energy, 2.0e0 AS momentum FROM seeds", ("seeds",))
for h in range(4):
    part(
        f"fl{h}",
        f"""SELECT query_id, src, dst, {h + 1} AS hop, sum(inj) AS flow, max(inj) AS max_flow, any_value(weight) AS conductance, bool_or(worm) AS worm, bool_or(back) AS back,
              sum(inj) FILTER (WHERE next_m >= 0 OR worm) AS energy, max(next_m) FILTER (WHERE next_m >= 0 OR worm) AS momentum FROM (
            SELECT *, momentum - CASE WHEN worm THEN 0e0 ELSE 1e0 END AS next_m FROM (
              SELECT s.query_id, o.src, o.dst, o.weight, o.worm, s.momentum, coalesce(s.prev = o.dst, false) AS back,
                s.energy * o.weight * CASE WHEN o.worm THEN 0.7e0 ELSE 0.25e0 END * CASE WHEN coalesce(s.prev = o.dst, false) THEN 0.15e0 ELSE 1e0 END AS inj
              FROM st{h} s JOIN out20 o ON o.src = s.node WHERE s.energy >= 1e-9 AND s.momentum >= 0) WHERE inj >= 1e-9) GROUP BY 1, 2, 3""",
        (f"st{h}", "out20"),
    )
    part(
        f"st{h + 1}",
        f"""SELECT query_id, src AS prev, dst AS node, energy, momentum FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY energy DESC, src, dst) AS rn FROM fl{h} WHERE energy IS NOT NULL) WHERE rn <= 2000""",
        (f"fl{h}",),
    )
part(
    "obs_nodes",
    "SELECT query_id, tag_id, energy, energy / max(energy) OVER (PARTITION BY query_id) AS normalized, energy / sum(energy) OVER (PARTITION BY query_id) AS source_mass, hop FROM (SELECT query_id, tag_id, sum(e) AS energy, min(hop) AS hop FROM ("
    + " UNION ALL ".join(f"SELECT query_id, node AS tag_id, energy * {W[h]!r}e0 AS e, {h} AS hop FROM st{h}" for h in range(5))
    + ") GROUP BY 1, 2)",
    tuple(f"st{h}" for h in range(5)),
)
part(
    "obs_edges",
    "SELECT *, flow / max(flow) OVER (PARTITION BY query_id) AS normalized_flow FROM (SELECT query_id, src, dst, sum(flow) AS flow, max(max_flow) AS max_flow, any_value(conductance) AS conductance, min(hop) AS min_hop, bool_or(worm) AS wormhole, bool_or(back) AS immediate_return FROM ("
    + " UNION ALL ".join(f"SELECT * FROM fl{h}" for h in range(4))
    + ") GROUP BY 1, 2, 3)",
    tuple(f"fl{h}" for h in range(4)),
)
part("ft0", "SELECT query_id, tag_id, source_mass AS y FROM obs_nodes", ("obs_nodes",))
for k in range(1, STEPS + 1):
    part(f"ft{k}", f"SELECT query_id, dst AS tag_id, sum(y * weight) AS y FROM ft{k - 1} JOIN transport ON src = tag_id GROUP BY 1, 2", (f"ft{k - 1}", "transport"))


def lit(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def fields_part(name: str, steps: int) -> None:
    def c(alpha, k):
        return lit((1 - alpha) * alpha**k if k < steps else alpha**steps)

    part(
        name,
        "SELECT query_id, tag_id, sum(l) AS local, sum(t) AS transfer FROM ("
        + " UNION ALL ".join(f"SELECT query_id, tag_id, y * {c(0.15, k)} AS l, y * {c(0.55, k)} AS t FROM ft{k}" for k in range(steps + 1))
        + ") GROUP BY 1, 2",
        tuple(f"ft{k}" for k in range(steps + 1)),
    )


fields_part("fields10", 10)
fields_part("fields_raw", STEPS)
part(
    "fields",
    """SELECT query_id, tag_id, local, transfer, (lsum - local) / ltot < 0.8e0 - 1e-12 AS in_local, (tsum - transfer) / ttot < 0.9e0 - 1e-12 AS in_transfer FROM (
         SELECT *, sum(local) OVER (PARTITION BY query_id ORDER BY local DESC, tag_id ROWS UNBOUNDED PRECEDING) AS lsum, sum(local) OVER (PARTITION BY query_id) AS ltot,
           sum(transfer) OVER (PARTITION BY query_id ORDER BY transfer DESC, tag_id ROWS UNBOUNDED PRECEDING) AS tsum, sum(transfer) OVER (PARTITION BY query_id) AS ttot FROM fields_raw)""",
    ("fields_raw",),
)


@query("seed_tags", "SELECT query_id::BIGINT AS query_id, tag_id, round(energy, 6) AS energy FROM seeds", ("seeds",))
def _(spark, d):
    return seeds(spark, d).select("query_id", "tag_id", r6(F.col("energy"), "energy"))


@query(
    "spike_nodes",
    "SELECT query_id::BIGINT AS query_id, tag_id, round(energy, 6) AS energy, round(normalized, 6) AS normalized, round(source_mass, 6) AS source_mass, hop FROM obs_nodes",
    ("obs_nodes",),
)
def _(spark, d):
    n, _ = observation(spark, d)
    return n.select("query_id", "tag_id", r6(F.col("energy"), "energy"), r6(F.col("normalized"), "normalized"), r6(F.col("source_mass"), "source_mass"), "hop")


@query(
    "spike_edges",
    "SELECT query_id::BIGINT AS query_id, src, dst, round(flow, 6) AS flow, round(normalized_flow, 6) AS normalized_flow, min_hop, wormhole, immediate_return FROM obs_edges",
    ("obs_edges",),
)
def _(spark, d):
    _, e = observation(spark, d)
    return e.select("query_id", "src", "dst", r6(F.col("flow"), "flow"), r6(F.col("normalized_flow"), "normalized_flow"), "min_hop", "wormhole", "immediate_return")


@query(
    "dual_field_k10",
    "SELECT query_id::BIGINT AS query_id, tag_id, round(local, 6) AS local, round(transfer, 6) AS transfer FROM fields10",
    ("fields10",),
)
def _(spark, d):
    n, _ = observation(spark, d)
    f = FD.dual_fields(n, blocked_graph(spark, d), steps=10)
    return f.select("query_id", "tag_id", r6(F.col("local"), "local"), r6(F.col("transfer"), "transfer"))


@query(
    "dual_field",
    "SELECT query_id::BIGINT AS query_id, tag_id, round(local, 6) AS local, round(transfer, 6) AS transfer, in_local, in_transfer FROM fields",
    ("fields",),
)
def _(spark, d):
    f = fields(spark, d)
    return f.select("query_id", "tag_id", r6(F.col("local"), "local"), r6(F.col("transfer"), "transfer"), "in_local", "in_transfer")


part(
    "field_vec",
    """SELECT query_id, kind, list(x / norm ORDER BY i) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query_id, kind)) AS norm FROM (
         SELECT query_id, kind, i, sum(w * x) AS x FROM (SELECT query_id, kind, w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (
           SELECT query_id, 'local' AS kind, tag_id, local AS w FROM fields_raw UNION ALL SELECT query_id, 'transfer', tag_id, transfer FROM fields_raw) JOIN tag_vec USING (tag_id)) GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
    ("fields_raw", "tag_vec"),
)


@query(
    "field_vectors",
    "SELECT query_id::BIGINT AS query_id, kind, i::INTEGER - 1 AS i, round(x, 6) AS x FROM (SELECT query_id, kind, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM field_vec)",
    ("field_vec",),
)
def _(spark, d):
    f, tv = fields(spark, d), tag_vector_table(spark, d)
    both = FD.field_vectors(f, tv, "local").withColumn("kind", F.lit("local")).unionByName(FD.field_vectors(f, tv, "transfer").withColumn("kind", F.lit("transfer")))
    return both.select("query_id", "kind", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    "field_entropy",
    "SELECT query_id::BIGINT AS query_id, count(*) AS n, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy, round(sum(p * p), 6) AS hhi FROM (SELECT query_id, source_mass AS p FROM obs_nodes) GROUP BY 1",
    ("obs_nodes",),
)
def _(spark, d):
    from tagloom.operators.ledger import normalised_entropy

    n, _ = observation(spark, d)
    e = normalised_entropy(n, ["query_id"], "source_mass")
    return e.withColumns({"entropy": F.round("entropy", 6), "hhi": F.round("hhi", 6)})


def pyramid(spark, d):
    """Levels and features, staged once for every query that needs them."""
    built = {}

    def build(i):
        if not built:
            built[0], built[1] = O.residual_pyramid(queries(spark, d), tag_vector_table(spark, d))
        return built[i]

    return staged(spark, d, "pyramid_levels", lambda: build(0)), staged(spark, d, "pyramid_features", lambda: build(1))


def full_observation(spark, d):
    """Axes, gated seeds and blend factors."""
    q, tags = queries(spark, d), T.tags(spark, d).select("tag_id", "name")
    basis = staged(spark, d, "axis_basis", lambda: O.axis_basis(tag_vector_table(spark, d)))
    axes = staged(spark, d, "axes", lambda: O.axis_analysis(q, basis))
    levels, features = pyramid(spark, d)
    names = basis.select(F.col("label").alias("world")).distinct().join(tags, F.col("world") == F.col("tag_id")).select("world", F.col("name").alias("world_name"))
    seeds_, boosts = O.gate_seeds(levels, features, axes, tags, world_names=names)
    return axes, features, staged(spark, d, "gated_seeds", lambda: seeds_), staged(spark, d, "boosts", lambda: boosts)


def full_state(spark, d):
    """Everything `retrieve` needs to know about the batch, from staged tables."""
    axes, features, gated, boosts = full_observation(spark, d)
    built = {}

    def spread(i):
        if not built:
            built[0], built[1] = O.propagate(gated, listed_graph(spark, d), SPIKE)
        return built[i]

    nodes, edges = staged(spark, d, "full_nodes", lambda: spread(0)), staged(spark, d, "full_edges", lambda: spread(1))

    def blend(i):
        if 2 not in built:
            built[2], built[3] = FD.fuse(queries(spark, d), nodes, gated, boosts, tag_vector_table(spark, d))
        return built[i]

    return {
        "nodes": nodes, "edges": edges, "fused": staged(spark, d, "fused", lambda: blend(2)), "selected": staged(spark, d, "fused_tags", lambda: blend(3)),
        "fields": staged(spark, d, "full_fields", lambda: FD.field_domains(FD.dual_fields(nodes, blocked_graph(spark, d)))),
        "state": O.query_state(axes, features),
    }


@query("axis_analysis")
def _(spark, d):
    return full_observation(spark, d)[0]


@query("residual_pyramid")
def _(spark, d):
    levels, _ = pyramid(spark, d)
    return levels.select("query_id", "level", "tag_id", "rank", r6(F.col("similarity"), "similarity"), r6(F.col("contribution"), "contribution"))


@query("pyramid_features")
def _(spark, d):
    return pyramid(spark, d)[1]


@query("gated_seeds")
def _(spark, d):
    return full_observation(spark, d)[2]


@query("fused_queries")
def _(spark, d):
    o = full_state(spark, d)
    return o["fused"].join(O.matched_tags(o["selected"], T.tags(spark, d)), "query_id").select("query_id", "vector", "matched")


@query("fused_fields")
def _(spark, d):
    return full_state(spark, d)["fields"]
