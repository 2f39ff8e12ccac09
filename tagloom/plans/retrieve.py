"""Whole retrieval for a batch of queries: observe, propagate, fuse, diffuse, rank, adjust."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.columns import clamp01
from tagloom.functions.vectors import cosine
from tagloom.operators import graph as G
from tagloom.params import CurveParams, FieldParams, PyramidParams, SelectionParams, SpikeParams, TopologyParams
from tagloom.plans import fields as FD
from tagloom.plans import observe as O
from tagloom.plans import rank_curve as D
from tagloom.plans import rank_topology as R
from tagloom.plans.select import adjusted_scores
from tagloom.session import broadcast_if_fits, cut_lineage


@dataclass(frozen=True)
class RetrievalParams:
    spike: SpikeParams = field(default_factory=SpikeParams)
    pyramid: PyramidParams = field(default_factory=PyramidParams)
    fields: FieldParams = field(default_factory=FieldParams)
    topology: TopologyParams = field(default_factory=TopologyParams)
    curve: CurveParams = field(default_factory=CurveParams)
    selection: SelectionParams = field(default_factory=SelectionParams)


@dataclass(frozen=True)
class Corpus:
    """tags (tag_id, name), tag_vectors (tag_id, vector), file_tags (file_id, tag_id, position), chunks (chunk_id, file_id,
    vector), transport (src, dst, weight, wormhole), stamps (file_id, stamp in microseconds). Mode plain reads chunks and stamps.
    With the graph as a `ListedGraph` come `inbound` (tag_id, inbound) and what `observe` returns."""

    tags: DataFrame
    tag_vectors: DataFrame | None
    file_tags: DataFrame
    chunks: DataFrame
    transport: DataFrame | G.ListedGraph | None
    stamps: DataFrame
    inbound: DataFrame | None = None


def observe(queries: DataFrame, c: Corpus, p: RetrievalParams, core: DataFrame | None = None) -> dict[str, DataFrame]:
    basis = O.axis_basis(c.tag_vectors)
    axes = O.axis_analysis(queries, basis)
    levels, features = O.residual_pyramid(queries, c.tag_vectors, p.pyramid)
    names = basis.select(F.col("label").alias("tag_id")).distinct().join(c.tags.select("tag_id", "name"), "tag_id").select(F.col("tag_id").alias("world"), F.col("name").alias("world_name"))
    seeds, boosts = O.gate_seeds(levels, features, axes, c.tags, core, names, p.pyramid)
    seeds, boosts = cut_lineage(seeds, "seeds"), cut_lineage(boosts, "boosts")
    nodes, edges = O.propagate(seeds, c.transport, p.spike)
    nodes, edges = cut_lineage(nodes, "nodes"), cut_lineage(edges, "edges")
    core_ids = None
    if core is not None:
        core_ids = core.withColumn("low", F.lower("name")).join(c.tags.withColumn("low", F.lower("name")).select("low", "tag_id"), "low").groupBy("query_id", "low").agg(F.min("tag_id").alias("tag_id")).drop("low")
    fused, selected = FD.fuse(queries, nodes, seeds, boosts, c.tag_vectors, core_ids, None, p.pyramid)
    fields = cut_lineage(FD.field_domains(FD.dual_fields(nodes, c.transport, p.fields), p.fields), "fields")
    state = O.query_state(axes, features)
    return {"nodes": nodes, "edges": edges, "fused": cut_lineage(fused, "fused"), "selected": selected, "fields": fields, "state": cut_lineage(state, "state")}


def retrieve(
    queries: DataFrame, c: Corpus, ledger: DataFrame, now: Column, mode: str = "topology", p: RetrievalParams = RetrievalParams(),
    core: DataFrame | None = None, observed: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Ranked rows per query: score, effective, rank, role or evidence class. Mode topology, curve or plain.

    Both graph modes can share one `observed` result of `observe`.
    """
    if mode == "plain":
        from tagloom.operators.neighbours import top_neighbours

        near = top_neighbours(queries, c.chunks.withColumnRenamed("chunk_id", "item_id"), p.topology.top_k)
        rows = near.select("query_id", F.col("item_id").alias("chunk_id"), F.col("score").alias("knn"), F.col("score").alias("raw_score"), "rank", F.lit("unranked").alias("role"))
        rows = rows.join(c.chunks.select("chunk_id", "file_id"), "chunk_id")
    else:
        o = observed or observe(queries, c, p, core)
        vectors = {
            "query_knn": queries, "denoised_knn": o["fused"],
            "local_knn": cut_lineage(FD.field_vectors(o["fields"], c.tag_vectors, "local"), "local"),
            "transfer_knn": cut_lineage(FD.field_vectors(o["fields"], c.tag_vectors, "transfer"), "transfer"),
        }
        anchors = R.anchor_direct(o["fields"], c.file_tags, c.chunks, p.topology)
        cands = cut_lineage(R.candidate_cosines(R.candidate_union(vectors, c.chunks, anchors, p.topology), vectors, c.chunks), "candidates")
        files = broadcast_if_fits(cands.select("file_id").distinct())
        file_tags = cut_lineage(c.file_tags.join(files, "file_id", "left_semi"), "candidate-tags")
        own = c.chunks.join(broadcast_if_fits(cands.select("chunk_id").distinct()), "chunk_id", "left_semi").join(file_tags, "file_id").join(c.tag_vectors.select("tag_id", F.col("vector").alias("tv")), "tag_id")
        geometry = own.select("chunk_id", "tag_id", cosine(F.col("vector"), F.col("tv")).alias("cosine"))
        curve = cut_lineage(R.curve_rows(cands, file_tags, geometry, o["fields"]), "curve")
        listed = isinstance(c.transport, G.ListedGraph)
        edges = cut_lineage(c.transport.out_edges(curve.select(F.col("tag_id").alias("tag"))), "curve-edges") if listed else c.transport
        steps = cut_lineage(R.file_steps(curve.select("file_id"), file_tags, c.tag_vectors, edges), "steps")
        classes, pairs = R.tag_similarity(c.tag_vectors, o["nodes"], curve, min(p.topology.semantic_node, p.curve.neighbour_floor))
        spec = cut_lineage(G.hub_specificity(c.inbound if listed else G.inbound_mass(c.transport)), "specificity")
        if mode == "curve":
            trust, kept = D.field_trust(o["nodes"], p.curve)
            samples = D.field_samples(curve, o["nodes"], kept, classes, pairs, spec, p.curve)
            points = cut_lineage(D.curve_points(curve, samples, spec, None, p.curve), "points")
            masses = D.curve_masses(points, p.curve)
            flow = D.curve_continuity(points, steps.drop("position"), masses)
            sparse = D.sparse_association(points, masses, edges, c.tag_vectors, p.curve)
            enhanced = cands.select("query_id", "chunk_id", F.col("denoised_score").alias("score"))
            ranked = D.curve_rank(D.curve_scores(cands, masses, flow, sparse, o["state"], enhanced, p.curve), trust, p.curve)
            rows = ranked.join(cands.select("query_id", "chunk_id", "file_id"), ["query_id", "chunk_id"]).select(
                "query_id", "chunk_id", "file_id", F.col("base_score").alias("knn"), F.col("score").alias("raw_score"), "rank", F.col("evidence_class").alias("role")
            )
        else:
            path = R.path_geometry(curve, steps, p.topology)
            aligned = R.alignments(curve, o["nodes"], classes, pairs, p.topology)
            kept = R.strongest_flows(o["edges"], p.topology).select("src", "dst")
            mine = G.independent_fraction(G.edge_provenance(c.transport.lists if listed else c.file_tags, only=kept)).join(curve.select("file_id").distinct(), "file_id", "left_semi")
            topo = R.topology_alignment(cands, curve, aligned, o["nodes"], o["edges"], mine, p.topology)
            qt = curve.select("query_id", "tag_id").distinct().join(queries.select("query_id", F.col("vector").alias("qv")), "query_id").join(c.tag_vectors, "tag_id")
            seen = R.observables(curve, cands, path, o["nodes"], qt.select("query_id", "tag_id", clamp01(cosine(F.col("qv"), F.col("vector"))).alias("cos")))
            roles = cut_lineage(R.assign_roles(R.base_scores(cands, path, topo, seen, R.morphology(o["nodes"], o["edges"]), p.topology)), "roles")
            strength = R.anchor_strength(cands, curve, o["nodes"], classes, pairs, spec, p.topology)
            ranked = R.final_rank(roles, R.peer_innovation(roles, p.topology), strength, R.observability(o["nodes"], o["edges"]), p.topology)
            rows = ranked.select("query_id", "chunk_id", "file_id", F.col("query_score").alias("knn"), F.col("score").alias("raw_score"), "rank", "role")
    rows = cut_lineage(rows, "ranked").join(c.stamps, "file_id", "left")
    return adjusted_scores(rows, ledger, now, p.selection)
