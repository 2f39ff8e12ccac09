"""Curve ranking queries over the same candidates as the topology ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog.base import part, query
from tagloom.catalog.graph_queries import tag_vector_table
from tagloom.catalog.observe_queries import observation
from tagloom.catalog.rank_queries import QID, c01, candidate_tags, candidates, curve, curve_edges, hub_specificity, similar
from tagloom.functions.columns import r6
from tagloom.plans import rank_curve as D
from tagloom.plans import rank_topology as R
from tagloom.session import staged


def samples(spark, d):
    def build():
        nodes, _ = observation(spark, d)
        _, kept = D.field_trust(nodes)
        classes, pairs = similar(spark, d)
        return D.field_samples(curve(spark, d), nodes, kept, classes, pairs, hub_specificity(spark, d))

    return staged(spark, d, "field_samples", build)


def points(spark, d):
    return staged(spark, d, "curve_points", lambda: D.curve_points(curve(spark, d), samples(spark, d), hub_specificity(spark, d)))


def masses(spark, d):
    return D.curve_masses(points(spark, d))


def continuity(spark, d):
    c = curve(spark, d)
    steps = R.file_steps(c.select("file_id"), candidate_tags(spark, d), tag_vector_table(spark, d), curve_edges(spark, d)).drop("position")
    return D.curve_continuity(points(spark, d), steps, masses(spark, d))


def scores(spark, d):
    def build():
        m = masses(spark, d)
        sparse = D.sparse_association(points(spark, d), m, curve_edges(spark, d), tag_vector_table(spark, d))
        return D.curve_scores(candidates(spark, d), m, continuity(spark, d), sparse)

    return staged(spark, d, "curve_scores", build)


def curve_ranked(spark, d):
    trust, _ = D.field_trust(observation(spark, d)[0])
    return D.curve_rank(scores(spark, d), trust)


part(
    "kept_nodes",
    """SELECT query_id, tag_id, normalized, hop, pos FROM (SELECT *, row_number() OVER w AS pos, sum(energy) OVER (PARTITION BY query_id ORDER BY energy DESC, tag_id ROWS UNBOUNDED PRECEDING) - energy AS before, sum(energy) OVER (PARTITION BY query_id) AS tot
         FROM obs_nodes WINDOW w AS (PARTITION BY query_id ORDER BY energy DESC, tag_id)) WHERE (before / tot < 0.95e0 - 1e-12 OR pos <= 3) AND pos <= 48""",
    ("obs_nodes",),
)
part(
    "samples",
    f"""SELECT t.query_id, t.tag_id, {c01('greatest(coalesce(o.normalized, 0), coalesce(mixed, 0))')} AS potential, o.tag_id IS NOT NULL AS exact, coalesce(CASE WHEN o.hop = 0 THEN 'seed' WHEN o.hop > 0 THEN 'emergent' END, near, 'unknown') AS source_type
        FROM (SELECT DISTINCT query_id, tag_id, tvec FROM curve) t LEFT JOIN obs_nodes o ON o.query_id = t.query_id AND o.tag_id = t.tag_id
        LEFT JOIN (SELECT query_id, tag_id, sum(val) / sqrt(count(*)) AS mixed, max(CASE WHEN rn = 1 THEN CASE WHEN hop = 0 THEN 'seed' ELSE 'emergent' END END) AS near FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, tag_id ORDER BY round(val, 9) DESC, pos) AS rn FROM (
              SELECT t.query_id, t.tag_id, k.hop, k.pos, {c01('k.normalized')} * pow({c01('(s.sim - 0.5e0) / 0.5e0')}, 2) * coalesce(h.specificity, 1) AS val
              FROM (SELECT DISTINCT query_id, tag_id, tvec FROM curve) t JOIN simpair s ON s.vb = t.tvec AND s.sim >= 0.5 JOIN kept_nodes k ON k.query_id = t.query_id AND k.tag_id % (SELECT n FROM nv) = s.va AND k.tag_id <> t.tag_id
              LEFT JOIN specificity h ON h.tag_id = k.tag_id)) WHERE rn <= 4 GROUP BY 1, 2) m ON m.query_id = t.query_id AND m.tag_id = t.tag_id""",
    ("curve", "obs_nodes", "kept_nodes", "simpair", "specificity", "nv"),
)
part(
    "points",
    f"""SELECT *, weak AND NOT coalesce(lag(weak) OVER w, false) AND NOT coalesce(lead(weak) OVER w, false) AS isolated, row_number() OVER w AS idx FROM (
          SELECT c.*, s.potential, s.exact, s.source_type, {c01('(cc - 0.2e0) / 0.8e0')} AS closure, greatest(0.02e0, {c01('(cc - 0.2e0) / 0.8e0')} * exp(-0.035e0 * (position - 1)) * coalesce(specificity, 1)) AS mass, potential >= 0.06 AS weak
          FROM curve c JOIN samples s USING (query_id, tag_id) LEFT JOIN specificity USING (tag_id)) WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY position)""",
    ("curve", "samples", "specificity"),
)
part(
    "masses",
    f"""SELECT *, {c01('cm / tm')} AS coverage, {c01('wp / greatest(cm, 1e-12)')} AS mean_potential, {c01('cl / tm')} AS closure_quality, {c01('im / greatest(wp, 1e-12)')} AS raw_isolated FROM (
          SELECT query_id, chunk_id, count(*) AS n, sum(mass) AS tm, coalesce(sum(mass) FILTER (WHERE weak), 0) AS cm, coalesce(sum(mass * potential) FILTER (WHERE weak), 0) AS wp, sum(mass * closure) AS cl, count(*) FILTER (WHERE weak) AS weak_hits, count(*) FILTER (WHERE potential >= 0.16) AS strong_hits,
            count(*) FILTER (WHERE exact) AS exact_hits, count(*) FILTER (WHERE exact AND source_type = 'seed') AS direct_exact, count(*) FILTER (WHERE exact AND source_type <> 'seed') AS emergent_exact, count(*) FILTER (WHERE NOT exact AND source_type = 'seed' AND potential >= 0.16) AS direct_semantic,
            coalesce(avg(potential) FILTER (WHERE NOT exact AND source_type = 'seed' AND potential >= 0.16), 0) AS semantic_mean, max(potential) AS max_potential, coalesce(sum(mass * potential) FILTER (WHERE isolated), 0) AS im, count(*) FILTER (WHERE isolated) AS isolated_hits FROM points GROUP BY 1, 2)""",
    ("points",),
)
part(
    "contin",
    f"""SELECT query_id, chunk_id, CASE WHEN tmass > 0 THEN {c01('cmass / tmass')} ELSE {c01('0.35e0 * max_potential')} END AS continuity, CASE WHEN arcm > 0 THEN {c01('exp(-act / greatest(arcm, 0.15e0))')} ELSE {c01('0.5e0 * max_potential')} END AS action_quality,
          CASE WHEN dw > 0 THEN {c01('dm / dw')} ELSE 0 END AS direction FROM masses LEFT JOIN (
        SELECT query_id, chunk_id, sum(m) AS tmass, sum(m * pot * (0.65e0 + 0.35e0 * topo)) AS cmass, sum(arc * m) AS arcm, sum(arc * m / greatest(pot + 0.25e0 * topo, 0.08e0)) AS act,
          sum(m * greatest(pot, 0.05e0)) FILTER (WHERE fw + rv > 0) AS dw, sum(m * greatest(pot, 0.05e0) * fw / (fw + rv)) FILTER (WHERE fw + rv > 0) AS dm FROM (
        SELECT a.query_id, a.chunk_id, acos(greatest(-1, least(1, round(list_inner_product(va.v, vb.v) / (va.m * vb.m), 12)))) / pi() AS arc, sqrt(a.potential * b.potential) AS pot, sqrt(a.mass * b.mass) AS m, coalesce(e.weight, 0) AS fw, coalesce(r.weight, 0) AS rv, {c01('sqrt(greatest(coalesce(e.weight, 0), coalesce(r.weight, 0)))')} AS topo
        FROM points a JOIN points b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.idx = a.idx + 1 JOIN vec va ON va.vec_id = a.tvec JOIN vec vb ON vb.vec_id = b.tvec
        LEFT JOIN transport e ON e.src = a.tag_id AND e.dst = b.tag_id LEFT JOIN transport r ON r.src = b.tag_id AND r.dst = a.tag_id) GROUP BY 1, 2) USING (query_id, chunk_id)""",
    ("masses", "points", "vec", "transport"),
)
part(
    "sparse_pairs",
    f"""SELECT * FROM (SELECT a.query_id, a.chunk_id, a.idx AS i1, b.idx AS i2, a.mass * a.potential AS m1, b.mass * b.potential AS m2, greatest(coalesce(e.weight, 0), coalesce(r.weight, 0)) AS cond, list_inner_product(va.v, vb.v) / (va.m * vb.m) AS sim,
          pow({c01('(greatest(coalesce(e.weight, 0), coalesce(r.weight, 0)) - 0.015e0) / 0.985e0')} * {c01('(list_inner_product(va.v, vb.v) / (va.m * vb.m) - 0.48e0) / 0.52e0')} * sqrt(a.potential * b.potential) * sqrt(a.closure * b.closure), 0.25e0) AS quality
        FROM points a JOIN points b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.idx - a.idx > 1 AND a.isolated AND b.isolated AND a.potential >= 0.08 AND b.potential >= 0.08 AND a.closure >= 0.2 AND b.closure >= 0.2
        JOIN masses k ON k.query_id = a.query_id AND k.chunk_id = a.chunk_id AND k.isolated_hits >= 3 JOIN vec va ON va.vec_id = a.tvec JOIN vec vb ON vb.vec_id = b.tvec
        LEFT JOIN transport e ON e.src = a.tag_id AND e.dst = b.tag_id LEFT JOIN transport r ON r.src = b.tag_id AND r.dst = a.tag_id) WHERE cond >= 0.015 AND sim >= 0.48 AND quality > 0""",
    ("points", "masses", "vec", "transport"),
)
part(
    "sparse",
    f"""SELECT query_id, chunk_id, {c01('cmx / im')} * {c01('np / 3e0')} * {c01('mq')} AS sparse_confidence FROM (SELECT query_id, chunk_id, count(*) AS np, avg(quality) AS mq FROM sparse_pairs GROUP BY 1, 2)
        JOIN (SELECT query_id, chunk_id, sum(m) AS cmx FROM (SELECT query_id, chunk_id, i1 AS i, m1 AS m FROM sparse_pairs UNION SELECT query_id, chunk_id, i2, m2 FROM sparse_pairs) GROUP BY 1, 2) USING (query_id, chunk_id) JOIN masses USING (query_id, chunk_id)""",
    ("sparse_pairs", "masses"),
)
part(
    "dscore",
    f"""SELECT *, CASE WHEN cls IN ('direct', 'structural') OR (cls = 'thematic' AND max_potential >= 0.08 AND iso <= 0.65) THEN least(0.35e0 * CASE WHEN cls = 'direct' AND direct_semantic >= 2 THEN greatest(confidence, 0.35e0) * greatest({c01('(geo - 0.015e0) / 0.235e0')}, sstr) ELSE confidence * {c01('(geo - 0.015e0) / 0.235e0')} END,
          CASE cls WHEN 'direct' THEN 0.18e0 WHEN 'structural' THEN 0.10e0 ELSE 0.035e0 END) ELSE 0 END AS bonus FROM (
        SELECT *, CASE WHEN NOT live THEN 'neutral' WHEN direct_exact > 0 OR direct_semantic >= 2 THEN 'direct' WHEN exact_hits > 0 OR (strong_hits >= 2 AND continuity >= 0.08 AND iso <= 0.65) THEN 'structural' ELSE 'thematic' END AS cls,
          CASE WHEN direct_semantic >= 2 THEN {c01('(semantic_mean - 0.16e0) / 0.19e0')} ELSE 0 END AS sstr, confidence * {c01('0.30e0 * mean_potential + 0.20e0 * max_potential + 0.20e0 * continuity + 0.15e0 * action_quality + 0.15e0 * closure_quality')} AS geo FROM (
        SELECT *, CASE WHEN live THEN {c01(f"coverage * (0.55e0 + 0.45e0 * {c01('(strong_hits + 0.75e0 * exact_hits) / tg')}) * (1 - 0.65e0 * iso)")} ELSE 0 END AS confidence FROM (
        SELECT c.query_id, c.chunk_id, c.query_score AS base, c.union_rank, m.* EXCLUDE (query_id, chunk_id), t.continuity, t.action_quality, t.direction, coalesce(weak_hits, 0) > 0 AS live, least(3, ceil(sqrt(m.n))) AS tg, {c01('raw_isolated * (1 - 0.55e0 * coalesce(sparse_confidence, 0))')} AS iso
        FROM cands c LEFT JOIN masses m USING (query_id, chunk_id) LEFT JOIN contin t USING (query_id, chunk_id) LEFT JOIN sparse s USING (query_id, chunk_id))))""",
    ("cands", "masses", "contin", "sparse"),
)
part(
    "dfused",
    f"""SELECT *, CASE WHEN live THEN {c01('(1 - (1 - 0.45e0 / 1.75e0 * ds) * (1 - 0.60e0 / 1.75e0 * ss) * (1 - 0.70e0 / 1.75e0 * th)) * cs')} ELSE 0 END AS fused FROM (SELECT *,
          {c01(f"0.45e0 * greatest(sstr, CASE WHEN direct_exact > 0 THEN 1e0 ELSE 0 END) + 0.25e0 * max_potential + 0.20e0 * mean_potential + 0.10e0 * {c01('(direct_exact + direct_semantic) / 3e0')}")} AS ds,
          {c01(f"0.25e0 * continuity + 0.20e0 * action_quality + 0.15e0 * closure_quality + 0.15e0 * (1 - iso) + 0.15e0 * direction + 0.10e0 * {c01('(emergent_exact + least(strong_hits, tg)) / (tg + 1)')}")} AS ss,
          {c01('0.35e0 * coverage + 0.30e0 * mean_potential + 0.20e0 * (1 - iso) + 0.15e0 * closure_quality')} AS th, {c01(f"0.60e0 * {c01('(base + 1) / 2')} + 0.30e0 * closure_quality + 0.05e0")} AS cs FROM dscore)""",
    ("dscore",),
)


@query("field_samples", f"SELECT {QID}, tag_id, round(potential, 6) AS potential, exact, source_type FROM samples", ("samples",))
def _(spark, d):
    return samples(spark, d).withColumn("potential", F.round("potential", 6))


@query(
    "curve_masses",
    f"SELECT {QID}, chunk_id, weak_hits, strong_hits, exact_hits, round(coverage, 6) AS coverage, round(mean_potential, 6) AS mean_potential, round(closure_quality, 6) AS closure_quality, round(raw_isolated, 6) AS raw_isolated FROM masses",
    ("masses",),
)
def _(spark, d):
    return masses(spark, d).select("query_id", "chunk_id", "weak_hits", "strong_hits", "exact_hits", *[r6(F.col(x), x) for x in ("coverage", "mean_potential", "closure_quality", "raw_isolated")])


@query("curve_continuity", f"SELECT {QID}, chunk_id, round(continuity, 6) AS continuity, round(action_quality, 6) AS action_quality, round(direction, 6) AS direction FROM contin", ("contin",))
def _(spark, d):
    return continuity(spark, d).select("query_id", "chunk_id", *[r6(F.col(x), x) for x in ("continuity", "action_quality", "direction")])


@query(
    "curve_scores",
    f"SELECT {QID}, chunk_id, cls AS evidence_class, round(confidence, 6) AS confidence, round(coalesce(geo, 0), 6) AS geo_score, round(bonus, 6) AS bonus, round(fused, 6) AS fused_geometry FROM dfused",
    ("dfused",),
)
def _(spark, d):
    return scores(spark, d).select("query_id", "chunk_id", "evidence_class", *[r6(F.col(x), x) for x in ("confidence", "geo_score", "bonus", "fused_geometry")])


part(
    "dranked",
    """SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fb IS NULL THEN 0 ELSE union_rank END, round(CASE WHEN fb IS NULL THEN base + bonus ELSE base END, 9) DESC, round(base, 9) DESC, union_rank)::INTEGER AS rank,
          CASE WHEN fb IS NULL THEN base + bonus ELSE base END AS score, fb AS fallback_reason FROM dscore JOIN (
        SELECT query_id, CASE WHEN any_value(nn) < 3 OR any_value(ent) < 0.12 THEN 'query-energy-field-low-trust' WHEN count(*) FILTER (WHERE geo > 0) = 0 THEN 'no-candidate-curve-contacted-query-field'
            WHEN count(*) FILTER (WHERE geo > 0) / count(*) < 0.2 AND max(geo) < 0.01 AND sum(strong_hits + 0.75e0 * exact_hits) FILTER (WHERE geo > 0) < 1 THEN 'candidate-curve-readout-jointly-low-trust'
            WHEN count(*) FILTER (WHERE geo > 0) > 1 AND max(geo) - min(geo) FILTER (WHERE geo > 0) < 0.03 AND max(geo) < 0.01 AND sum(strong_hits + 0.75e0 * exact_hits) FILTER (WHERE geo > 0) < 1 THEN 'candidate-curve-scores-lack-discrimination' END AS fb
        FROM dscore JOIN (SELECT query_id, count(*) AS nn, -sum(source_mass * ln(source_mass)) / ln(count(*)) AS ent FROM obs_nodes GROUP BY 1) USING (query_id) GROUP BY 1) USING (query_id)""",
    ("dscore", "obs_nodes"),
)


@query("curve_rank", f"SELECT {QID}, chunk_id, rank, round(score, 6) AS score, fallback_reason FROM dranked", ("dranked",))
def _(spark, d):
    return curve_ranked(spark, d).select("query_id", "chunk_id", "rank", r6(F.col("score"), "score"), "fallback_reason")
