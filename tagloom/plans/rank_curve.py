"""Curve ranking: every note is an ordered walk over its tags, scored by the energy field of the query along it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.functions.columns import clamp01, positive, zero
from tagloom.functions.vectors import cosine
from tagloom.operators.ledger import cumulative_domain, normalised_entropy
from tagloom.operators.running import top_n
from tagloom.params import AuxiliaryParams, CurveParams

KEY = ["query_id", "chunk_id"]


def field_trust(nodes: DataFrame, p: CurveParams = CurveParams()) -> tuple[DataFrame, DataFrame]:
    """(trust, kept): per query whether the field is usable, and the strongest nodes that carry it."""
    live = nodes.filter("energy > 0")
    trust = normalised_entropy(live, ["query_id"], "energy").select(
        "query_id", F.col("n").alias("field_nodes"), F.col("entropy").alias("field_entropy"),
        ((F.col("n") >= p.min_field_nodes) & (F.col("entropy") >= p.min_entropy)).alias("trusted"),
    )
    kept = cumulative_domain(
        live.select("query_id", "tag_id", "energy", "normalized", "source_type"), ["query_id"], "energy", "tag_id",
        p.field_mass, cap=max(p.max_field_nodes, p.min_field_nodes), floor=p.min_field_nodes,
    )
    return trust, kept


def field_samples(curve: DataFrame, nodes: DataFrame, kept: DataFrame, classes: DataFrame, pairs: DataFrame, specificity: DataFrame, p: CurveParams = CurveParams()) -> DataFrame:
    """(query_id, tag_id, potential, exact, source_type): the field at every tag the candidates use."""
    tags = curve.select("query_id", "tag_id").distinct()
    k = kept.select("query_id", F.col("tag_id").alias("node"), "normalized", F.col("source_type").alias("node_source"), F.col("position").alias("node_rank"))
    k = k.join(specificity.select(F.col("tag_id").alias("node"), F.col("specificity").alias("node_spec")), "node", "left")
    k = k.join(classes.withColumnsRenamed({"tag_id": "node", "class_id": "ca"}), "node")
    t = tags.join(classes.withColumnRenamed("class_id", "cb"), "tag_id")
    rows = t.join(pairs.filter(F.col("sim") >= p.neighbour_floor), "cb").join(k, ["query_id", "ca"]).filter("node <> tag_id")
    local = clamp01((F.col("sim") - p.neighbour_floor) / (1 - p.neighbour_floor))
    rows = rows.withColumn("value", clamp01(F.col("normalized")) * local * local * F.coalesce("node_spec", F.lit(1.0)))
    near = top_n(rows, ["query_id", "tag_id"], [F.desc(F.round("value", 9)), F.asc("node_rank")], p.neighbours)
    mixed = near.groupBy("query_id", "tag_id").agg(
        (F.sum("value") / F.sqrt(F.count(F.lit(1)))).alias("mixed"), F.max(F.when(F.col("rank") == 1, F.col("node_source"))).alias("near_source")
    )
    exact = nodes.filter("energy > 0").select("query_id", "tag_id", clamp01(F.col("normalized")).alias("own"), F.col("source_type").alias("own_source"))
    return tags.join(exact, ["query_id", "tag_id"], "left").join(mixed, ["query_id", "tag_id"], "left").select(
        "query_id", "tag_id", clamp01(F.greatest(zero(F.col("own")), zero(F.col("mixed")))).alias("potential"), F.col("own").isNotNull().alias("exact"),
        F.coalesce("own_source", "near_source", F.lit("unknown")).alias("source_type"),
    )


def curve_points(curve: DataFrame, samples: DataFrame, specificity: DataFrame, anchor: DataFrame | None = None, p: CurveParams = CurveParams()) -> DataFrame:
    """One row per (query, candidate, tag): field potential, closure, mass, index along the walk, isolation."""
    x = curve.join(samples, ["query_id", "tag_id"]).join(specificity.select("tag_id", "specificity"), "tag_id", "left")
    gain = F.lit(1.0)
    if anchor is not None:
        x = x.join(anchor.select("tag_id", "anchor_gain"), "tag_id", "left")
        gain = F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.coalesce("anchor_gain", F.lit(1.0))))
    closure = clamp01((F.col("cc") - p.closure_floor) / (1 - p.closure_floor))
    x = x.withColumn("closure", closure).withColumn(
        "mass", F.greatest(F.lit(p.mass_floor), F.col("closure") * gain * F.exp(-p.tail_decay * positive((F.col("position") - 1).cast("double"))) * F.coalesce("specificity", F.lit(1.0)))
    )
    w = Window.partitionBy(*KEY).orderBy("position")
    weak = F.col("potential") >= p.weak
    x = x.withColumns({"idx": F.row_number().over(w), "weak": weak, "left": F.coalesce(F.lag(weak).over(w), F.lit(False)), "right": F.coalesce(F.lead(weak).over(w), F.lit(False))})
    return x.withColumn("isolated", F.col("weak") & ~F.col("left") & ~F.col("right")).drop("left", "right")


def curve_masses(points: DataFrame, p: CurveParams = CurveParams()) -> DataFrame:
    """Coverage, potentials, hit counts and isolated mass of each candidate."""
    c = F.col
    start = c("source_type").isin("seed", "core")
    semantic = ~c("exact") & start & (c("potential") >= p.semantic_direct_floor)
    m = c("mass")
    return points.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum(m).alias("total_mass"), F.sum(F.when(c("weak"), m)).alias("contact_mass"), F.sum(F.when(c("weak"), m * c("potential"))).alias("weighted"),
        F.sum(m * c("closure")).alias("closure_mass"), F.count_if("weak").alias("weak_hits"), F.count_if(c("potential") >= p.strong).alias("strong_hits"),
        F.count_if("exact").alias("exact_hits"), F.count_if(c("exact") & start).alias("direct_exact"), F.count_if(c("exact") & ~start).alias("emergent_exact"),
        F.count_if(semantic).alias("direct_semantic"), zero(F.avg(F.when(semantic, c("potential")))).alias("semantic_mean"), F.max("potential").alias("max_potential"),
        zero(F.sum(F.when(c("isolated"), m * c("potential")))).alias("isolated_mass"), F.count_if("isolated").alias("isolated_hits"),
    ).withColumns(
        {
            "coverage": clamp01(zero(c("contact_mass")) / c("total_mass")),
            "mean_potential": clamp01(zero(c("weighted")) / F.greatest(zero(c("contact_mass")), F.lit(1e-12))),
            "closure_quality": clamp01(c("closure_mass") / c("total_mass")),
            "raw_isolated": clamp01(c("isolated_mass") / F.greatest(zero(c("weighted")), F.lit(1e-12))),
        }
    )


def curve_continuity(points: DataFrame, steps: DataFrame, masses: DataFrame) -> DataFrame:
    """Continuity, action and direction of the walk. Steps (file_id, tag_id, next_id, cos, forward, reverse)."""
    a = points.select(*KEY, "file_id", "tag_id", "potential", "mass").join(steps, ["file_id", "tag_id"])
    b = points.select(*KEY, F.col("tag_id").alias("next_id"), F.col("potential").alias("potential2"), F.col("mass").alias("mass2"))
    c = F.col
    s = a.join(b, [*KEY, "next_id"]).select(
        *KEY, (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round("cos", 12)))) / F.pi()).alias("arc"), "forward", "reverse",
        clamp01(F.sqrt(F.greatest("forward", "reverse"))).alias("topo"), F.sqrt(c("potential") * c("potential2")).alias("pot"), F.sqrt(c("mass") * c("mass2")).alias("m"),
    )
    directed = (c("forward") + c("reverse")) > 0
    g = s.groupBy(*KEY).agg(
        F.sum("m").alias("tm"), F.sum(c("m") * c("pot") * (0.65 + 0.35 * c("topo"))).alias("cm"), F.sum(c("arc") * c("m")).alias("arc_mass"),
        F.sum(c("arc") * c("m") / F.greatest(c("pot") + 0.25 * c("topo"), F.lit(0.08))).alias("action"),
        F.sum(F.when(directed, c("m") * F.greatest(c("pot"), F.lit(0.05)))).alias("dw"),
        F.sum(F.when(directed, c("m") * F.greatest(c("pot"), F.lit(0.05)) * c("forward") / (c("forward") + c("reverse")))).alias("dm"),
    )
    return masses.select(*KEY, "max_potential").join(g, KEY, "left").select(
        *KEY,
        F.when(c("tm") > 0, clamp01(c("cm") / c("tm"))).otherwise(clamp01(0.35 * c("max_potential"))).alias("continuity"),
        F.when(c("arc_mass") > 0, clamp01(F.exp(-c("action") / F.greatest(c("arc_mass"), F.lit(0.15))))).otherwise(clamp01(0.5 * c("max_potential"))).alias("action_quality"),
        F.when(c("dw") > 0, clamp01(c("dm") / c("dw"))).otherwise(0.0).alias("direction"),
    )


def sparse_association(points: DataFrame, masses: DataFrame, transport: DataFrame, tag_vectors: DataFrame, p: CurveParams = CurveParams()) -> DataFrame:
    """(query_id, chunk_id, sparse_pairs, sparse_confidence): isolated contacts of one note that the graph still connects."""
    c = F.col
    open_ = masses.filter(c("isolated_hits") >= p.sparse_min_contacts).select(*KEY, "isolated_mass")
    iso = points.filter("isolated").filter((c("potential") >= p.sparse_potential) & (c("closure") >= p.sparse_closure)).join(open_.select(*KEY), KEY, "left_semi")
    iso = iso.select(*KEY, "tag_id", "idx", "potential", "closure", "mass").join(tag_vectors.select("tag_id", "vector"), "tag_id")
    a = iso.withColumnsRenamed({n: f"{n}1" for n in ("tag_id", "idx", "potential", "closure", "mass", "vector")})
    b = iso.withColumnsRenamed({n: f"{n}2" for n in ("tag_id", "idx", "potential", "closure", "mass", "vector")})
    e = transport.select("src", "dst", "weight")
    pairs = (
        a.join(b, KEY).filter("idx2 - idx1 > 1")
        .join(e.withColumnsRenamed({"src": "tag_id1", "dst": "tag_id2", "weight": "fw"}), ["tag_id1", "tag_id2"], "left")
        .join(e.withColumnsRenamed({"src": "tag_id2", "dst": "tag_id1", "weight": "rv"}), ["tag_id1", "tag_id2"], "left")
        .withColumns({"cond": F.greatest(zero(c("fw")), zero(c("rv"))), "sim": cosine(c("vector1"), c("vector2"))})
        .filter((c("cond") >= p.sparse_conductance) & (c("sim") >= p.sparse_cosine))
    )
    quality = F.pow(
        positive(
            clamp01((c("cond") - p.sparse_conductance) / (1 - p.sparse_conductance)) * clamp01((c("sim") - p.sparse_cosine) / (1 - p.sparse_cosine))
            * F.sqrt(c("potential1") * c("potential2")) * F.sqrt(c("closure1") * c("closure2"))
        ), 0.25,
    )
    pairs = pairs.withColumn("quality", quality).filter("quality > 0")
    counts = pairs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sparse_pairs"), F.avg("quality").alias("mean_quality"))
    joined = pairs.select(*KEY, F.explode(F.array(F.struct(c("idx1").alias("i"), (c("mass1") * c("potential1")).alias("m")), F.struct(c("idx2").alias("i"), (c("mass2") * c("potential2")).alias("m")))).alias("e")).select(*KEY, "e.*").distinct()
    mass = joined.groupBy(*KEY).agg(F.sum("m").alias("connected"))
    out = open_.join(counts, KEY).join(mass, KEY)
    return out.select(*KEY, "sparse_pairs", (clamp01(c("connected") / c("isolated_mass")) * clamp01(c("sparse_pairs") / 3) * clamp01(c("mean_quality"))).alias("sparse_confidence"))


def curve_scores(
    cands: DataFrame, masses: DataFrame, flow: DataFrame, sparse: DataFrame, state: DataFrame | None = None, enhanced: DataFrame | None = None, p: CurveParams = CurveParams()
) -> DataFrame:
    """Evidence class, geometric score and bonus per candidate.

    `state` (query_id, logic_depth, entropy, resonance, coverage_q, novelty, depth) weighs the shadow scores;
    `enhanced` (query_id, chunk_id, score) is the cosine to the fused query.
    """
    c = F.col
    x = cands.select(*KEY, F.col("query_score").alias("base_score"), "union_rank").join(masses, KEY, "left").join(flow, KEY, "left").join(sparse, KEY, "left")
    names = ("logic_depth", "entropy", "resonance", "coverage_q", "novelty", "depth")
    if state is not None:
        x = x.join(state.select("query_id", *names), "query_id", "left")
    else:
        x = x.withColumns({n: F.lit(1.0 if n in ("entropy", "novelty") else 0.0) for n in names})
    x = x.join(enhanced.select(*KEY, F.col("score").alias("enh")), KEY, "left") if enhanced is not None else x.withColumn("enh", c("base_score"))
    live = c("weak_hits") > 0
    iso = clamp01(c("raw_isolated") * (1 - p.sparse_relief * zero(c("sparse_confidence"))))
    target = F.least(F.lit(p.target_contacts), F.ceil(F.sqrt(c("n").cast("double"))))
    x = x.withColumns({"live": F.coalesce(live, F.lit(False)), "isolation": iso, "target": target})
    evidence = clamp01((c("strong_hits") + 0.75 * c("exact_hits")) / c("target"))
    confidence = clamp01(c("coverage") * (0.55 + 0.45 * evidence) * (1 - 0.65 * c("isolation")))
    x = x.withColumn("confidence", F.when(c("live"), confidence).otherwise(0.0))
    geo = c("confidence") * clamp01(0.30 * c("mean_potential") + 0.20 * c("max_potential") + 0.20 * c("continuity") + 0.15 * c("action_quality") + 0.15 * c("closure_quality"))
    x = x.withColumns(
        {
            "geo_score": F.when(c("live"), geo).otherwise(0.0),
            "semantic_strength": F.when(c("direct_semantic") >= 2, clamp01((c("semantic_mean") - p.semantic_direct_floor) / p.semantic_direct_range)).otherwise(0.0),
            "evidence_class": F.when(~c("live"), "neutral").when((c("direct_exact") > 0) | (c("direct_semantic") >= 2), "direct")
            .when((c("exact_hits") > 0) | ((c("strong_hits") >= 2) & (c("continuity") >= p.continuity_floor) & (c("isolation") <= p.max_isolation)), "structural").otherwise("thematic"),
        }
    )
    cls = c("evidence_class")
    eligible = cls.isin("direct", "structural") | ((cls == "thematic") & (c("max_potential") >= 0.08) & (c("isolation") <= p.max_isolation))
    cap = F.when(cls == "direct", p.direct_cap).when(cls == "structural", p.structural_cap).otherwise(p.thematic_cap)
    norm = clamp01((c("geo_score") - p.geo_floor) / p.geo_range)
    semantic = (cls == "direct") & (c("direct_semantic") >= 2)
    strength = F.when(semantic, F.greatest(norm, c("semantic_strength"))).otherwise(norm)
    trust = F.when(semantic, F.greatest(c("confidence"), F.lit(p.semantic_direct_confidence))).otherwise(c("confidence"))
    x = x.withColumns({"eligible": eligible, "cap": cap, "bonus": F.when(eligible, F.least(p.bonus_scale * trust * strength, cap)).otherwise(0.0)})
    direct = clamp01(0.45 * F.greatest(c("semantic_strength"), F.when(c("direct_exact") > 0, 1.0).otherwise(0.0)) + 0.25 * c("max_potential") + 0.20 * c("mean_potential") + 0.10 * clamp01((c("direct_exact") + c("direct_semantic")) / 3))
    contact = clamp01((c("emergent_exact") + F.least(c("strong_hits"), c("target"))) / (c("target") + 1))
    structural = clamp01(0.25 * c("continuity") + 0.20 * c("action_quality") + 0.15 * c("closure_quality") + 0.15 * (1 - c("isolation")) + 0.15 * c("direction") + 0.10 * contact)
    thematic = clamp01(0.35 * c("coverage") + 0.30 * c("mean_potential") + 0.20 * (1 - c("isolation")) + 0.15 * c("closure_quality"))
    orig, enh = clamp01((c("base_score") + 1) / 2), clamp01((c("enh") + 1) / 2)
    closure = F.when(c("live"), clamp01(0.25 * orig + 0.35 * enh + 0.30 * c("closure_quality") + 0.10 * clamp01(0.5 + 5 * (enh - orig)))).otherwise(
        clamp01(0.35 * orig + 0.45 * enh + 0.20 * clamp01(0.5 + 5 * (enh - orig)))
    )
    wd = 0.45 + 0.35 * clamp01(c("logic_depth")) + 0.20 * clamp01(c("coverage_q"))
    ws = 0.35 + 0.30 * clamp01(c("depth").cast("double")) + 0.25 * clamp01(c("novelty")) + 0.10 * clamp01(c("resonance"))
    wt = 0.20 + 0.35 * clamp01(c("entropy")) + 0.30 * clamp01(c("resonance")) + 0.15 * (1 - clamp01(c("logic_depth")))
    x = x.withColumns({"direct_score": direct, "structural_score": structural, "thematic_score": thematic, "closure_score": closure, "wd": wd, "ws": ws, "wt": wt})
    ws_ = c("wd") + c("ws") + c("wt")
    fused = clamp01((1 - (1 - c("wd") / ws_ * c("direct_score")) * (1 - c("ws") / ws_ * c("structural_score")) * (1 - c("wt") / ws_ * c("thematic_score"))) * c("closure_score"))
    zeroed = {n: F.when(c("live"), c(n)).otherwise(0.0) for n in ("direct_score", "structural_score", "thematic_score")}
    return x.withColumns(zeroed).withColumns({"fused_geometry": F.when(c("live"), fused).otherwise(0.0), "score": c("base_score") + c("bonus")})


def identity_contacts(points: DataFrame) -> DataFrame:
    """(query_id, chunk_id, id_potential, id_specificity, id_closure, id_strength): best exact contact with a start tag."""
    c = F.col
    hit = points.filter(c("exact") & c("source_type").isin("seed", "core")).withColumn("_spec", F.coalesce("specificity", F.lit(1.0)))
    strength = clamp01(c("potential") * c("_spec") * F.sqrt("closure"))
    return hit.withColumn("_s", strength).groupBy(*KEY).agg(
        F.max("potential").alias("id_potential"), F.max_by(F.struct("_spec", "closure", "_s"), F.struct(F.round("_s", 9), "idx")).alias("b")
    ).select(*KEY, "id_potential", c("b._spec").alias("id_specificity"), c("b.closure").alias("id_closure"), c("b._s").alias("id_strength"))


def auxiliary_floors(scores: DataFrame, identity: DataFrame, a: AuxiliaryParams = AuxiliaryParams()) -> DataFrame:
    """Lift small bonuses of well-supported candidates to a floor, never above the cap of their class."""
    c = F.col
    cls = c("evidence_class")
    own = F.when(cls == "direct", c("direct_score")).when(cls == "structural", c("structural_score")).otherwise(c("thematic_score"))
    floor = F.when(cls == "direct", a.direct_floor).when(cls == "structural", a.structural_floor).otherwise(a.thematic_floor)

    def above(value, low):
        return clamp01((value - low) / (1 - low))

    solid = c("eligible") & (own >= a.min_class) & (c("fused_geometry") >= a.min_fused) & (c("closure_score") >= a.min_closure)
    relative = F.cbrt(above(c("fused_geometry"), a.min_fused) * above(own, a.min_class) * above(c("closure_score"), a.min_closure))
    geometry = F.when(solid, floor * F.pow(relative, a.exponent)).otherwise(0.0)
    known = (
        F.lit(a.identity) & c("eligible") & (c("id_potential") >= a.identity_potential) & (c("id_specificity") >= a.identity_specificity)
        & (c("id_closure") >= a.identity_closure) & (c("id_strength") >= a.identity_strength)
    )
    anchored = F.when(known, a.identity_floor * F.pow(above(c("id_strength"), a.identity_strength), a.identity_exponent)).otherwise(0.0)
    x = scores.join(identity, KEY, "left")
    target = F.least(c("cap"), F.greatest(geometry, anchored))
    x = x.withColumn("auxiliary", F.least(F.lit(a.max_bonus), positive(target - c("bonus"))))
    x = x.withColumn("bonus", F.least(c("cap"), c("bonus") + c("auxiliary")))
    return x.withColumn("score", c("base_score") + c("bonus")).select(*scores.columns, "auxiliary")


def curve_rank(scores: DataFrame, trust: DataFrame, p: CurveParams = CurveParams()) -> DataFrame:
    """Final order, or the untouched input order with a reason when the field or the curves are not trustworthy."""
    c = F.col
    pos = c("geo_score") > 0
    g = scores.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("pool"), F.count_if(pos).alias("contributors"), F.min(F.when(pos, c("geo_score"))).alias("low"), F.max("geo_score").alias("high"),
        zero(F.sum(F.when(pos, c("strong_hits") + 0.75 * c("exact_hits")))).alias("strong_evidence"),
    ).join(trust.select("query_id", "trusted"), "query_id", "left")
    faint = (c("high") < 0.01) & (c("strong_evidence") < 1.0)
    reason = (
        F.when(~F.coalesce("trusted", F.lit(False)), "query-energy-field-low-trust")
        .when(c("contributors") == 0, "no-candidate-curve-contacted-query-field")
        .when((c("contributors") / c("pool") < 0.20) & faint, "candidate-curve-readout-jointly-low-trust")
        .when((c("contributors") > 1) & (c("high") - c("low") < 0.03) & faint, "candidate-curve-scores-lack-discrimination")
    )
    x = scores.join(g.select("query_id", reason.alias("fallback_reason")), "query_id")
    kept = c("fallback_reason").isNotNull()
    x = x.withColumns({"bonus": F.when(kept, 0.0).otherwise(c("bonus")), "score": F.when(kept, c("base_score")).otherwise(c("score"))})
    order = [F.asc(F.when(kept, c("union_rank")).otherwise(0)), F.desc(F.round("score", 9)), F.desc(F.round("base_score", 9)), F.asc("union_rank")]
    return top_n(x, ["query_id"], order, p.top_k)
