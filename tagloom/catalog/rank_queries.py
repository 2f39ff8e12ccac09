"""Topology ranking queries over the label-mean query batch and the order notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.catalog.base import part, query
from tagloom.catalog.graph_queries import inbound_mass, listed_graph, tag_lists, tag_vector_table
from tagloom.catalog.neighbour_queries import chunk_tag_geometry
from tagloom.catalog.observe_queries import fields, observation, queries
from tagloom.functions.columns import r6
from tagloom.functions.vectors import cosine
from tagloom.operators import graph as G
from tagloom.plans import fields as FD
from tagloom.plans import rank_topology as R
from tagloom.session import staged
from tagloom.sources import tables as T

K = R.KEY


def c01(x: str) -> str:
    return f"least(1e0, greatest(0e0, {x}))"


def sources(spark, d):
    f, tv, q = fields(spark, d), tag_vector_table(spark, d), queries(spark, d)
    local = staged(spark, d, "local_vectors", lambda: FD.field_vectors(f, tv, "local"))
    transfer = staged(spark, d, "transfer_vectors", lambda: FD.field_vectors(f, tv, "transfer"))
    return {"query_knn": q, "denoised_knn": q, "local_knn": local, "transfer_knn": transfer}


def chunks(spark, d):
    v = T.unit_vectors(spark, d).select("vec_id", "vector")
    return T.chunk_vectors(spark, d).join(v, "vec_id").select("chunk_id", "file_id", "bucket", "vector")


def anchors(spark, d):
    return R.anchor_direct(fields(spark, d), T.file_tags(spark, d), T.chunk_vectors(spark, d))


def candidates(spark, d):
    def build():
        s, c = sources(spark, d), chunks(spark, d)
        return R.candidate_cosines(R.candidate_union(s, c, anchors(spark, d)), s, c)

    return staged(spark, d, "candidates", build)


def candidate_tags(spark, d):
    """`file_tags` of the candidates' files."""
    return staged(spark, d, "candidate_tags", lambda: T.file_tags(spark, d, candidates(spark, d)))


def curve_edges(spark, d):
    """The out-edges of the candidates' tags."""
    return staged(spark, d, "curve_edges", lambda: listed_graph(spark, d).out_edges(curve(spark, d).select(F.col("tag_id").alias("tag"))))


def hub_specificity(spark, d):
    return staged(spark, d, "specificity", lambda: G.hub_specificity(inbound_mass(spark, d)))


def curve(spark, d):
    def build():
        cands = candidates(spark, d)
        return R.curve_rows(cands, candidate_tags(spark, d), chunk_tag_geometry(spark, d, cands), fields(spark, d))

    return staged(spark, d, "curve", build)


def path(spark, d):
    def build():
        c = curve(spark, d)
        steps = R.file_steps(c.select("file_id"), candidate_tags(spark, d), tag_vector_table(spark, d), curve_edges(spark, d))
        return R.path_geometry(c, steps)

    return staged(spark, d, "path", build)


def similar(spark, d):
    c = curve(spark, d)
    nodes, _ = observation(spark, d)
    built = {}

    def build(i):
        if not built:
            built[0], built[1] = R.tag_similarity(tag_vector_table(spark, d), nodes, c, 0.48)
        return built[i]

    return staged(spark, d, "tag_classes", lambda: build(0)), staged(spark, d, "class_pairs", lambda: build(1))


def topology(spark, d):
    def build():
        nodes, edges = observation(spark, d)
        c = curve(spark, d)
        classes, pairs = similar(spark, d)
        aligned = R.alignments(c, nodes, classes, pairs)
        files = c.select("file_id").distinct()
        kept = R.strongest_flows(edges).select("src", "dst")
        mine = G.independent_fraction(G.edge_provenance(tag_lists(spark, d), only=kept)).join(files, "file_id", "left_semi")
        return R.topology_alignment(candidates(spark, d), c, aligned, nodes, edges, mine)

    return staged(spark, d, "topology", build)


def seen(spark, d):
    def build():
        nodes, _ = observation(spark, d)
        c = curve(spark, d)
        q = queries(spark, d).select("query_id", F.col("vector").alias("qv"))
        pairs = c.select("query_id", "tag_id").distinct().join(q, "query_id").join(tag_vector_table(spark, d), "tag_id")
        qt = pairs.select("query_id", "tag_id", cosine(F.col("qv"), F.col("vector")).alias("cos"))
        return R.observables(c, candidates(spark, d), path(spark, d), nodes, qt)

    return staged(spark, d, "observables", build)


def strength(spark, d):
    def build():
        nodes, _ = observation(spark, d)
        classes, pairs = similar(spark, d)
        return R.anchor_strength(candidates(spark, d), curve(spark, d), nodes, classes, pairs, hub_specificity(spark, d))

    return staged(spark, d, "strength", build)


def shape(spark, d):
    return R.morphology(*observation(spark, d))


def roles(spark, d):
    return staged(
        spark, d, "roles",
        lambda: R.assign_roles(R.base_scores(candidates(spark, d), path(spark, d), topology(spark, d), seen(spark, d), shape(spark, d))),
    )


def ranked(spark, d):
    def build():
        r = roles(spark, d)
        return R.final_rank(r, R.peer_innovation(r), strength(spark, d), R.observability(*observation(spark, d)))

    return staged(spark, d, "ranked", build)


def matched_names_for(spark, d):
    return R.matched_names(curve(spark, d), fields(spark, d), T.tags(spark, d))


part("nv", "SELECT count(*) AS n FROM embeddings")
part(
    "source_vec",
    """SELECT query_id, 'query_knn' AS source, v FROM qv UNION ALL SELECT query_id, 'denoised_knn', v FROM qv UNION ALL SELECT query_id, kind || '_knn', v FROM field_vec""",
    ("qv", "field_vec"),
)
part(
    "source_sim",
    """SELECT query_id, source, vec_id, round(list_inner_product(s.v, e.v) / (sqrt(list_inner_product(s.v, s.v)) * e.m), 9) AS score, list_inner_product(s.v, e.v) / (sqrt(list_inner_product(s.v, s.v)) * e.m) AS exact
       FROM source_vec s CROSS JOIN vec e""",
    ("source_vec", "vec"),
)
part(
    "anchor_rows",
    """SELECT query_id, file_id AS chunk_id, hits / max(hits) OVER (PARTITION BY query_id) AS score, rn AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, file_id) AS rn FROM (
           SELECT query_id, file_id, count(*) AS hits FROM fields JOIN file_tags USING (tag_id) WHERE in_local GROUP BY 1, 2)) WHERE rn <= 50""",
    ("fields", "file_tags"),
)
part(
    "source_rows",
    """SELECT query_id, chunk_id, source, score, rank FROM (SELECT query_id, o_orderkey AS chunk_id, source, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, o_orderkey) AS rank
         FROM orders JOIN source_sim ON vec_id = o_orderkey % (SELECT n FROM nv)) WHERE rank <= 100 AND score > 0
       UNION ALL SELECT query_id, chunk_id, 'anchor_direct', score, rank FROM anchor_rows""",
    ("source_sim", "anchor_rows", "nv"),
)
part(
    "cand_union",
    f"""SELECT query_id, chunk_id, union_score, rn AS union_rank, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, round(union_score, 9) DESC, chunk_id) AS rn FROM (
          SELECT query_id, chunk_id, count(*) AS k, {c01(f"0.5e0 * max(nm) + 0.25e0 * avg(nm) + 0.25e0 * {c01('20 * sum(1e0 / (60 + rank))')} + least(0.05e0 * (count(*) - 1), 0.2e0)")} AS union_score FROM (
            SELECT *, CASE WHEN hi - lo > 1e-12 THEN {c01('(score - lo) / (hi - lo)')} ELSE {c01('1e0 / rank')} END AS nm FROM (
              SELECT *, min(score) OVER (PARTITION BY query_id, source) AS lo, max(score) OVER (PARTITION BY query_id, source) AS hi FROM source_rows)) GROUP BY 1, 2)) WHERE rn <= 300""",
    ("source_rows",),
)
part(
    "cands",
    """SELECT u.*, max(exact) FILTER (WHERE source = 'query_knn') AS query_score, max(exact) FILTER (WHERE source = 'denoised_knn') AS denoised_score,
         max(exact) FILTER (WHERE source = 'local_knn') AS local_score, max(exact) FILTER (WHERE source = 'transfer_knn') AS transfer_score
       FROM cand_union u JOIN source_sim s ON s.query_id = u.query_id AND s.vec_id = u.chunk_id % (SELECT n FROM nv) GROUP BY ALL""",
    ("cand_union", "source_sim", "nv"),
)
part(
    "norm_fields",
    "SELECT query_id, tag_id, local / max(local) OVER (PARTITION BY query_id) AS local, transfer / max(transfer) OVER (PARTITION BY query_id) AS transfer, in_local, in_transfer FROM fields",
    ("fields",),
)
part(
    "curve",
    f"""SELECT c.query_id, c.chunk_id, f.tag_id, f.position, {c01('list_inner_product(cv.v, tv.v) / (cv.m * tv.m)')} AS cc, tv.vec_id AS tvec,
          coalesce(n.local, 0) AS local, coalesce(n.transfer, 0) AS transfer, coalesce(in_local, false) AS in_local, coalesce(in_transfer, false) AS in_transfer
        FROM cand_union c JOIN file_tags f ON f.file_id = c.chunk_id JOIN vec cv ON cv.vec_id = c.chunk_id % (SELECT n FROM nv) JOIN vec tv ON tv.vec_id = f.tag_id % (SELECT n FROM nv)
        LEFT JOIN norm_fields n ON n.query_id = c.query_id AND n.tag_id = f.tag_id""",
    ("cand_union", "file_tags", "vec", "norm_fields", "nv"),
)
part(
    "steps",
    f"""SELECT *, sqrt(local * local2) AS lp, sqrt(transfer * transfer2) AS tp, CASE WHEN fw + rv > 0 THEN {c01('fw / (fw + rv)')} ELSE 0.05e0 END AS dir,
          (in_local AND in_local2) AS ls, (in_transfer AND in_transfer2) AS ts,
          {c01(f"0.5e0 * {c01('(cs + 1) / 2')} + 0.5e0 * sqrt(greatest(sqrt(local * local2), sqrt(transfer * transfer2)) * greatest(local2, transfer2))")} AS cont,
          ((in_local AND in_local2) OR (in_transfer AND in_transfer2)) AND fw + rv > 0 AS ok FROM (
        SELECT a.query_id, a.chunk_id, a.local, a.transfer, a.in_local, a.in_transfer, b.local AS local2, b.transfer AS transfer2, b.in_local AS in_local2, b.in_transfer AS in_transfer2,
          list_inner_product(va.v, vb.v) / (va.m * vb.m) AS cs, coalesce(e.weight, 0) AS fw, coalesce(r.weight, 0) AS rv
        FROM (SELECT *, lead(tag_id) OVER (PARTITION BY query_id, chunk_id ORDER BY position) AS nxt FROM curve) a
        JOIN curve b ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.tag_id = a.nxt
        JOIN vec va ON va.vec_id = a.tvec JOIN vec vb ON vb.vec_id = b.tvec
        LEFT JOIN transport e ON e.src = a.tag_id AND e.dst = a.nxt LEFT JOIN transport r ON r.src = a.nxt AND r.dst = a.tag_id)""",
    ("curve", "vec", "transport"),
)
part(
    "path",
    f"""SELECT *, {c01('path_core * (0.5e0 + 0.25e0 * support_coverage + 0.25e0 * tag_closure)')} AS path_quality FROM (
          SELECT b.query_id, b.chunk_id, b.tag_closure, {c01('coalesce(mq, single)')} AS path_core, coalesce(sup, 0) AS support_coverage, coalesce(segments, 0) AS segments, coalesce(tsegs, 0) AS transfer_segments
          FROM (SELECT query_id, chunk_id, avg(cc) AS tag_closure, max(0.5e0 * greatest(local, transfer)) AS single FROM curve GROUP BY 1, 2) b
          LEFT JOIN (SELECT query_id, chunk_id, count(*) AS segments, avg(ok::INTEGER::DOUBLE) AS sup, count(*) FILTER (WHERE ok AND ts AND (NOT ls OR tp > lp)) AS tsegs,
              avg(CASE WHEN ok THEN {c01('(0.6e0 * lp + 0.4e0 * tp) * sqrt(greatest(dir, 0.05e0)) * sqrt(cont)')} ELSE 0 END) AS mq FROM steps GROUP BY 1, 2) USING (query_id, chunk_id))""",
    ("curve", "steps"),
)
part(
    "simpair",
    "SELECT a.vec_id AS va, b.vec_id AS vb, round(list_inner_product(a.v, b.v) / (a.m * b.m), 9) AS sim FROM vec a CROSS JOIN vec b WHERE round(list_inner_product(a.v, b.v) / (a.m * b.m), 9) >= 0.48",
    ("vec",),
)
part(
    "aligned",
    f"""SELECT query_id, chunk_id, node, weight, hop, tag_id, position, cc AS closure, q AS quality FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id, node ORDER BY (node = tag_id) DESC, round(q, 9) DESC, position) AS rn FROM (
          SELECT c.query_id, c.chunk_id, o.tag_id AS node, greatest(o.normalized, 1e-9) AS weight, o.hop, c.tag_id, c.position, c.cc,
            CASE WHEN o.tag_id = c.tag_id THEN sqrt(c.cc) ELSE sqrt({c01('(least(s.sim, 1) - 0.48e0) / 0.52e0')} * c.cc) END AS q
          FROM curve c JOIN simpair s ON s.vb = c.tvec JOIN obs_nodes o ON o.query_id = c.query_id AND o.tag_id % (SELECT n FROM nv) = s.va)) WHERE rn = 1""",
    ("curve", "simpair", "obs_nodes", "nv"),
)
part(
    "kept_edges",
    """SELECT query_id, src, dst, greatest(normalized_flow, 1e-9) AS w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY flow DESC, src, dst) AS rn FROM obs_edges WHERE normalized_flow >= 0.015) WHERE rn <= 96""",
    ("obs_edges",),
)
part(
    "edge_match",
    f"""SELECT *, {c01('sqrt(sq * dq) * dist * dir * ind')} AS eq FROM (SELECT k.query_id, a.chunk_id, k.w, a.quality AS sq, b.quality AS dq, coalesce(i.independent, 1) AS ind,
          exp(-abs(greatest(abs(b.hop - a.hop), 1) / m.mh - abs(b.position - a.position) / sp.span) / 0.35e0) AS dist, CASE WHEN b.position > a.position THEN 1e0 ELSE 0.25e0 END AS dir
        FROM kept_edges k JOIN aligned a ON a.query_id = k.query_id AND a.node = k.src JOIN aligned b ON b.query_id = k.query_id AND b.chunk_id = a.chunk_id AND b.node = k.dst AND b.tag_id <> a.tag_id
        JOIN (SELECT query_id, greatest(max(hop), 1)::DOUBLE AS mh FROM obs_nodes GROUP BY 1) m ON m.query_id = k.query_id
        JOIN (SELECT query_id, chunk_id, greatest(max(position) - min(position), 1)::DOUBLE AS span FROM curve GROUP BY 1, 2) sp ON sp.query_id = k.query_id AND sp.chunk_id = a.chunk_id
        LEFT JOIN independent i ON i.src = k.src AND i.dst = k.dst AND i.file_id = a.chunk_id)""",
    ("kept_edges", "aligned", "obs_nodes", "curve", "independent"),
)
part(
    "topo",
    f"""SELECT *, {c01('0.18e0 * node_alignment + 0.22e0 * distance + 0.18e0 * direction + 0.42e0 * edge_topology')} AS edge_graph, {c01('sqrt(node_alignment * mean_closure)')} AS node_graph,
          CASE WHEN me > 0 THEN {c01('cbrt(node_coverage * edge_coverage * mean_closure)')} WHEN mn > 0 THEN least(0.2e0, {c01('sqrt(node_coverage * mean_closure)')}) ELSE 0 END AS reliability FROM (
        SELECT c.query_id, c.chunk_id, coalesce({c01('mw / nt')}, 0) AS node_coverage, coalesce({c01('qm / mw')}, 0) AS node_alignment, coalesce(mc, 0) AS mean_closure,
          coalesce({c01('em / et')}, 0) AS edge_coverage, coalesce({c01('dm / em')}, 0) AS distance, coalesce({c01('rm / em')}, 0) AS direction, coalesce({c01('tm / em')}, 0) AS edge_topology, coalesce(mn, 0) AS mn, coalesce(me, 0) AS me
        FROM cand_union c LEFT JOIN (SELECT query_id, sum(greatest(normalized, 1e-9)) AS nt FROM obs_nodes GROUP BY 1) n ON n.query_id = c.query_id
        LEFT JOIN (SELECT query_id, sum(w) AS et FROM kept_edges GROUP BY 1) e ON e.query_id = c.query_id
        LEFT JOIN (SELECT query_id, chunk_id, count(*) AS mn, sum(weight) AS mw, sum(weight * quality) AS qm, avg(closure) AS mc FROM aligned GROUP BY 1, 2) a ON a.query_id = c.query_id AND a.chunk_id = c.chunk_id
        LEFT JOIN (SELECT query_id, chunk_id, count(*) AS me, sum(w) AS em, sum(w * dist) AS dm, sum(w * dir) AS rm, sum(w * eq) AS tm FROM edge_match GROUP BY 1, 2) x ON x.query_id = c.query_id AND x.chunk_id = c.chunk_id)""",
    ("cand_union", "obs_nodes", "kept_edges", "aligned", "edge_match"),
)
part(
    "observed",
    f"""SELECT query_id, chunk_id, {c01(f"greatest(0.75e0 * {c01('hits / ns')}, boundary)")} AS direct, boundary, closure, query_chunk, lc, tc, lm, tm,
          {c01(f"0.25e0 * lc + 0.2e0 * tc + 0.2e0 * lm + 0.15e0 * tm + 0.2e0 * (1 - abs(lm - tm))")} * (1 - 0.5e0 * tail) AS thematic FROM (
        SELECT c.query_id, c.chunk_id, coalesce(hits, 0)::DOUBLE AS hits, ns, CASE WHEN coalesce(bd, 0) >= 0.55e0 THEN bd ELSE 0 END AS boundary, coalesce(lc, 0) AS lc, coalesce(tc, 0) AS tc, coalesce(lm, 0) AS lm, coalesce(tm, 0) AS tm, coalesce(tail, 0) AS tail,
          {c01('query_score')} AS query_chunk, {c01(f"0.65e0 * {c01('query_score')} + 0.35e0 * coalesce(tag_closure, 0)")} AS closure
        FROM cands c LEFT JOIN path p USING (query_id, chunk_id) LEFT JOIN (SELECT query_id, count(*) AS ns FROM obs_nodes GROUP BY 1) USING (query_id)
        LEFT JOIN (SELECT u.query_id, u.chunk_id, count(o.tag_id) AS hits, avg(u.in_local::INTEGER::DOUBLE) AS lc, avg(u.in_transfer::INTEGER::DOUBLE) AS tc, avg(u.local) AS lm, avg(u.transfer) AS tm,
             avg(((u.local > 0 OR u.transfer > 0) AND NOT u.in_local AND NOT u.in_transfer)::INTEGER::DOUBLE) AS tail, max(sqrt({c01('list_inner_product(qv.v, t.v) / (qv.m * t.m)')} * u.cc)) AS bd
           FROM curve u JOIN qv ON qv.query_id = u.query_id JOIN vec t ON t.vec_id = u.tvec LEFT JOIN obs_nodes o ON o.query_id = u.query_id AND o.tag_id = u.tag_id GROUP BY 1, 2) g USING (query_id, chunk_id))""",
    ("cands", "path", "obs_nodes", "curve", "qv", "vec"),
)
part(
    "contacts",
    """SELECT * FROM (SELECT c.query_id, c.chunk_id, o.tag_id AS seed, o.source_mass AS mass, c.tag_id, c.cc, o.tag_id = c.tag_id AS ex,
           row_number() OVER (PARTITION BY c.query_id, c.chunk_id, o.tag_id ORDER BY (o.tag_id = c.tag_id) DESC, s.sim DESC, c.position DESC) AS rn
         FROM curve c JOIN simpair s ON s.vb = c.tvec AND s.sim >= 0.8 JOIN obs_nodes o ON o.query_id = c.query_id AND o.hop = 0 AND o.tag_id % (SELECT n FROM nv) = s.va) WHERE rn = 1""",
    ("curve", "simpair", "obs_nodes", "nv"),
)
part(
    "strengths",
    f"""SELECT query_id, chunk_id, {c01('coalesce(score * rel, 0)')} AS strength, coalesce(contacted, 0) AS contacted, coalesce(score, 0) AS anchor_score, coalesce(rel, 0) AS anchor_reliability FROM cand_union LEFT JOIN (
          SELECT query_id, chunk_id, CASE WHEN max(x) >= 1 THEN 1e0 ELSE {c01('1 - exp(sum(ln(1 - x)) FILTER (WHERE x < 1))')} END AS score, {c01('sqrt(avg(cc) * least(count(*) / 2e0, 1))')} AS rel, count(*) AS contacted FROM (
            SELECT t.*, {c01(f"{c01('mass / top')} * coalesce(specificity, 1) * cc * greatest(0.15e0, 1 - pool / nc) * CASE WHEN ex THEN 1e0 ELSE 0.7e0 END")} AS x FROM (
              SELECT *, count(*) OVER (PARTITION BY query_id, seed) AS pool FROM contacts) t
            JOIN (SELECT query_id, max(source_mass) AS top FROM obs_nodes WHERE hop = 0 GROUP BY 1) USING (query_id) JOIN (SELECT query_id, count(*) AS nc FROM cand_union GROUP BY 1) USING (query_id)
            LEFT JOIN specificity USING (tag_id)) GROUP BY 1, 2) USING (query_id, chunk_id)""",
    ("cand_union", "contacts", "obs_nodes", "specificity"),
)
part(
    "morph",
    f"""SELECT *, CASE WHEN atomic >= propositional AND atomic >= narrative THEN 'atomic' WHEN narrative >= propositional THEN 'narrative' ELSE 'propositional' END AS mode FROM (
        SELECT query_id, conf AS confidence, depth, fwd, chain, branching, merging, growth, conf * exp(la) / (exp(la) + exp(lp) + exp(ln_)) + (1 - conf) / 3 AS atomic, conf * exp(lp) / (exp(la) + exp(lp) + exp(ln_)) + (1 - conf) / 3 AS propositional,
          conf * exp(ln_) / (exp(la) + exp(lp) + exp(ln_)) + (1 - conf) / 3 AS narrative FROM (
        SELECT *, 1.45e0 * shallow + 0.9e0 * conc - 1.25e0 * depth - 0.65e0 * growth - 0.45e0 * chain AS la, 1.25e0 * (0.35e0 * same + 0.35e0 * branching + 0.3e0 * merging) + 0.7e0 * (1 - abs(2 * depth - 1)) + 0.35e0 * dvar - 0.25e0 * chain AS lp,
          1.4e0 * depth + 1.15e0 * chain + 0.8e0 * fwd + 0.65e0 * growth - 0.65e0 * branching - 0.3e0 * conc AS ln_ FROM (
        SELECT *, {c01('chain_fit * sqrt(fwd) * (0.35e0 + 0.65e0 * depth) * (1 - 0.5e0 * branching)')} AS chain, {c01('(levels - 1) / mh * sqrt(depth)')} AS growth, sqrt((1 - exp(-n / 8)) * (1 - exp(-m / 8))) AS conf FROM (
        SELECT n.*, fwd, same, chain_fit, branching, merging, m FROM (
          SELECT query_id, count(*) AS n, 1 - exp(-(sum(normalized * hop) / sum(normalized)) / 1.75e0) AS depth,
            1 - exp(-sqrt(greatest(0, sum(normalized * hop * hop) / sum(normalized) - pow(sum(normalized * hop) / sum(normalized), 2))) / 1.5e0) AS dvar,
            sum(normalized) FILTER (WHERE hop <= 1) / sum(normalized) AS shallow, {c01('(sum(normalized * normalized) / pow(sum(normalized), 2) - 1e0 / count(*)) / (1 - 1e0 / count(*))')} AS conc, max(hop) AS mh, count(DISTINCT hop) AS levels FROM obs_nodes GROUP BY 1) n
        JOIN (SELECT e.query_id, count(*) AS m, coalesce(sum(normalized_flow) FILTER (WHERE coalesce(d.hop, 0) > coalesce(s.hop, 0)), 0) / sum(normalized_flow) AS fwd, coalesce(sum(normalized_flow) FILTER (WHERE coalesce(d.hop, 0) = coalesce(s.hop, 0)), 0) / sum(normalized_flow) AS same
              FROM obs_edges e LEFT JOIN obs_nodes s ON s.query_id = e.query_id AND s.tag_id = e.src LEFT JOIN obs_nodes d ON d.query_id = e.query_id AND d.tag_id = e.dst GROUP BY 1) f USING (query_id)
        JOIN (SELECT query_id, avg((coalesce(i, 0) <= 1 AND coalesce(o, 0) <= 1)::INTEGER::DOUBLE) AS chain_fit, {c01('avg(greatest(coalesce(o, 0) - 1, 0))')} AS branching, {c01('avg(greatest(coalesce(i, 0) - 1, 0))')} AS merging
              FROM obs_nodes LEFT JOIN (SELECT query_id, src AS tag_id, count(*) AS o FROM obs_edges GROUP BY 1, 2) USING (query_id, tag_id) LEFT JOIN (SELECT query_id, dst AS tag_id, count(*) AS i FROM obs_edges GROUP BY 1, 2) USING (query_id, tag_id) WHERE hop > 0 GROUP BY 1) g USING (query_id)))))""",
    ("obs_nodes", "obs_edges"),
)
part(
    "omega",
    f"""SELECT *, CASE WHEN omega < 0.12 THEN 'collapsed' WHEN omega < 0.45 THEN 'sparse' ELSE 'dense' END AS regime FROM (SELECT query_id, oe AS omega_edge, om AS omega_emerge, fl AS omega_flow, {c01('cbrt(greatest(oe, 0.02e0) * greatest(om, 0.02e0) * greatest(fl, 0.02e0))')} AS omega FROM (
        SELECT query_id, {c01('k / (0.5e0 * seeds)')} AS oe, {c01('(reached - seeds) / (0.3e0 * seeds)')} AS om, {c01('ent / ln(k)')} AS fl FROM (SELECT query_id, count(*) FILTER (WHERE hop = 0) AS seeds, count(*) AS reached FROM obs_nodes GROUP BY 1)
        JOIN (SELECT query_id, count(*) AS k, -sum(p * ln(p)) AS ent FROM (SELECT query_id, flow / sum(flow) OVER (PARTITION BY query_id) AS p FROM obs_edges) GROUP BY 1) USING (query_id)))""",
    ("obs_nodes", "obs_edges"),
)
part(
    "scored",
    f"""SELECT *, CASE WHEN mode = 'atomic' THEN 'atomic_concept' WHEN closure >= 0.55 AND (evidence >= 0.55 OR (pure >= max(pure) OVER (PARTITION BY query_id) - 0.03e0 AND query_score >= 0.55)) THEN 'direct_answer'
          WHEN cbrt(edge_coverage * reliability * closure) >= 0.35 THEN 'structural_explanation' ELSE 'thematic_neighbor' END AS role FROM (
        SELECT c.query_id, c.chunk_id, c.union_score, c.union_rank, c.query_score, mode, closure, greatest(boundary, direct) AS evidence, node_coverage, node_alignment, edge_coverage, reliability,
          {c01(f"{c01(f'''(0.25e0 * {c01('query_score')} + 0.2e0 * {c01('local_score')} + 0.15e0 * {c01('transfer_score')}) / 0.6e0''')} + least(0.08e0 * {c01(f'''0.625e0 * path_quality + 0.375e0 * {c01('0.35e0 * lc + 0.25e0 * tc + 0.25e0 * lm + 0.15e0 * tm')}''')} * sqrt({c01('path_quality / 0.15e0')} * query_chunk), 0.08e0)")} AS pure,
          {c01('atomic * (0.75e0 * node_graph + 0.25e0 * edge_graph) + propositional * (0.25e0 * node_graph + 0.75e0 * edge_graph) + narrative * (0.15e0 * node_graph + 0.85e0 * edge_graph)')} AS graph
        FROM cands c LEFT JOIN (SELECT query_id, chunk_id, path_quality FROM path) USING (query_id, chunk_id) JOIN topo USING (query_id, chunk_id) JOIN observed USING (query_id, chunk_id) JOIN morph USING (query_id))""",
    ("cands", "path", "topo", "observed", "morph"),
)
part(
    "peer_w",
    """SELECT a.query_id, a.chunk_id, b.chunk_id AS peer, b.union_rank AS peer_rank, b.graph AS pg, a.graph AS g,
         CASE WHEN a.role = b.role THEN 1e0 ELSE 0.35e0 END * exp(-0.5e0 * (pow((b.pure - a.pure) / 0.04e0, 2) + pow((b.closure - a.closure) / 0.1e0, 2) + pow((b.evidence - a.evidence) / 0.12e0, 2))) AS w0
       FROM scored a JOIN scored b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id""",
    ("scored",),
)
part(
    "peers",
    """SELECT query_id, chunk_id, g, pg, CASE WHEN w0 >= 1e-4 THEN w0 ELSE 1e-4 END AS w FROM (SELECT *, count(*) FILTER (WHERE w0 >= 1e-4) OVER (PARTITION BY query_id, chunk_id) AS have,
         row_number() OVER (PARTITION BY query_id, chunk_id, w0 >= 1e-4 ORDER BY peer_rank) AS rk FROM peer_w) WHERE w0 >= 1e-4 OR rk <= 3 - have""",
    ("peer_w",),
)
part(
    "innov",
    f"""SELECT query_id, chunk_id, {c01("CASE WHEN front > 0 AND role <> 'direct_answer' AND mode <> 'atomic' THEN least(b, greatest(0, front - 0.005e0 - pure)) ELSE b END")} AS bonus FROM (
        SELECT s.*, max(pure) FILTER (WHERE role = 'direct_answer') OVER (PARTITION BY query_id) AS front,
          least(greatest(0, s.graph - ex - sqrt(va * (1 + 1 / greatest(ne, 1)))) * {c01(f"{c01('ne / 2.5e0')} * CASE WHEN mode = 'atomic' THEN sqrt(closure * {c01('0.55e0 * node_coverage + 0.45e0 * node_alignment')}) ELSE cbrt(closure * {c01('0.75e0 * edge_coverage + 0.25e0 * node_coverage')} * {c01('0.7e0 * reliability + 0.3e0 * node_alignment')}) END")} * 0.5e0
            * CASE role WHEN 'atomic_concept' THEN 1e0 WHEN 'direct_answer' THEN 0.35e0 WHEN 'structural_explanation' THEN 0.7e0 ELSE 0.15e0 END,
            CASE role WHEN 'atomic_concept' THEN 0.08e0 WHEN 'direct_answer' THEN 0.02e0 WHEN 'structural_explanation' THEN 0.045e0 ELSE 0.008e0 END, 0.08e0) AS b
        FROM scored s JOIN (SELECT p.query_id, p.chunk_id, ex, sum(w * pow(pg - ex, 2)) / sum(w) AS va, pow(sum(w), 2) / sum(w * w) AS ne FROM peers p
          JOIN (SELECT query_id, chunk_id, sum(w * pg) / sum(w) AS ex FROM peers GROUP BY 1, 2) USING (query_id, chunk_id) GROUP BY 1, 2, 3) USING (query_id, chunk_id))""",
    ("scored", "peers"),
)
part(
    "ranked",
    f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(union_score, 9) DESC, union_rank)::INTEGER AS rank FROM (
        SELECT query_id, chunk_id, union_score, union_rank, pure, graph, strength, bonus * omega AS topology_bonus, 0.1e0 * act AS anchor_bonus, {c01('pure + bonus * omega + 0.1e0 * act')} AS score, omega, regime,
          CASE WHEN lead = 1 AND strength >= 0.1 AND strength >= 2 * coalesce(second, 0) THEN 'direct_answer' WHEN omega < 0.12 AND role = 'structural_explanation' THEN 'thematic_neighbor' ELSE role END AS role FROM (
        SELECT *, CASE WHEN strength <= th THEN 0 WHEN 0.2e0 - th > 1e-12 THEN pow({c01('(strength - th) / (0.2e0 - th)')}, 2) * (3 - 2 * {c01('(strength - th) / (0.2e0 - th)')}) ELSE 1 END AS act,
          nth_value(strength, 2) OVER (PARTITION BY query_id ORDER BY lead ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM (
        SELECT *, {c01('greatest(0.05e0, avg(strength) OVER q + 2 * stddev_pop(strength) OVER q)')} AS th, row_number() OVER (PARTITION BY query_id ORDER BY round(strength, 9) DESC, union_rank) AS lead
        FROM scored JOIN innov USING (query_id, chunk_id) JOIN strengths USING (query_id, chunk_id) JOIN omega USING (query_id) WINDOW q AS (PARTITION BY query_id))))""",
    ("scored", "innov", "strengths", "omega"),
)

QID = "query_id::BIGINT AS query_id"


@query("anchor_direct", f"SELECT {QID}, chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM anchor_rows", ("anchor_rows",))
def _(spark, d):
    return anchors(spark, d).withColumn("score", F.round("score", 6))


@query(
    "rank_fusion_union",
    f"SELECT {QID}, chunk_id, union_rank::INTEGER AS union_rank, round(union_score, 6) AS union_score, round(query_score, 6) AS query_score, round(local_score, 6) AS local_score, round(transfer_score, 6) AS transfer_score, k AS n_sources FROM cands",
    ("cands",),
)
def _(spark, d):
    return candidates(spark, d).select(
        "query_id", "chunk_id", "union_rank", *[r6(F.col(x), x) for x in ("union_score", "query_score", "local_score", "transfer_score")], F.size("sources").cast("bigint").alias("n_sources")
    )


@query(
    "path_geometry",
    f"SELECT {QID}, chunk_id, round(path_core, 6) AS path_core, round(tag_closure, 6) AS tag_closure, round(support_coverage, 6) AS support_coverage, round(path_quality, 6) AS path_quality, transfer_segments FROM path",
    ("path",),
)
def _(spark, d):
    return path(spark, d).select("query_id", "chunk_id", *[r6(F.col(x), x) for x in ("path_core", "tag_closure", "support_coverage", "path_quality")], "transfer_segments")


TOPO = ("node_coverage", "node_alignment", "edge_coverage", "edge_graph", "node_graph", "reliability")


@query("topology_alignment", f"SELECT {QID}, chunk_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in TOPO) + " FROM topo", ("topo",))
def _(spark, d):
    return topology(spark, d).select("query_id", "chunk_id", *[r6(F.col(x), x) for x in TOPO])


@query("observables", f"SELECT {QID}, chunk_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("direct", "thematic", "boundary", "closure")) + " FROM observed", ("observed",))
def _(spark, d):
    return seen(spark, d).select("query_id", "chunk_id", *[r6(F.col(x), x) for x in ("direct", "thematic", "boundary", "closure")])


@query("anchor_strength", f"SELECT {QID}, chunk_id, round(strength, 6) AS strength, round(anchor_score, 6) AS anchor_score, contacted FROM strengths", ("strengths",))
def _(spark, d):
    return strength(spark, d).select("query_id", "chunk_id", r6(F.col("strength"), "strength"), r6(F.col("anchor_score"), "anchor_score"), "contacted")


MORPH = ("atomic", "propositional", "narrative", "confidence", "depth", "fwd", "chain", "branching", "merging", "growth")


@query("morphology", f"SELECT {QID}, mode, " + ", ".join(f"round({x}, 6) AS {x}" for x in MORPH) + " FROM morph", ("morph",))
def _(spark, d):
    return shape(spark, d).select("query_id", "mode", *[r6(F.col(x), x) for x in MORPH])


@query("omega", f"SELECT {QID}, regime, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("omega", "omega_edge", "omega_emerge", "omega_flow")) + " FROM omega", ("omega",))
def _(spark, d):
    return R.observability(*observation(spark, d)).select("query_id", "regime", *[r6(F.col(x), x) for x in ("omega", "omega_edge", "omega_emerge", "omega_flow")])


@query("roles", f"SELECT {QID}, chunk_id, role, round(pure, 6) AS pure_score, round(graph, 6) AS graph_score FROM scored", ("scored",))
def _(spark, d):
    return roles(spark, d).select("query_id", "chunk_id", "role", r6(F.col("pure_score"), "pure_score"), r6(F.col("graph_score"), "graph_score"))


@query("peer_innovation", f"SELECT {QID}, chunk_id, round(bonus, 6) AS innovation_bonus FROM innov", ("innov",))
def _(spark, d):
    return R.peer_innovation(roles(spark, d)).withColumn("innovation_bonus", F.round("innovation_bonus", 6))


@query(
    "final_rank",
    f"SELECT {QID}, chunk_id, rank, role, round(score, 6) AS score, round(topology_bonus, 6) AS topology_bonus, round(anchor_bonus, 6) AS anchor_bonus, regime FROM ranked",
    ("ranked",),
)
def _(spark, d):
    return ranked(spark, d).select("query_id", "chunk_id", "rank", "role", *[r6(F.col(x), x) for x in ("score", "topology_bonus", "anchor_bonus")], "regime")


@query(
    "matched_tags",
    f"SELECT {QID}, chunk_id, list_sort(list(DISTINCT p_name)) AS matched_tags FROM curve JOIN part ON p_partkey = tag_id WHERE in_local OR in_transfer GROUP BY 1, 2",
    ("curve",),
)
def _(spark, d):
    return matched_names_for(spark, d)


@query(
    "anchor_threshold_sweep",
    f"""SELECT {QID}, z, round(th, 6) AS threshold, count(*) FILTER (WHERE strength > th) AS passing FROM (
          SELECT query_id, strength, z, {c01('greatest(0.05e0, avg(strength) OVER (PARTITION BY query_id, z) + z * stddev_pop(strength) OVER (PARTITION BY query_id, z))')} AS th
          FROM strengths CROSS JOIN (SELECT unnest([2e0, 1.5e0, 1e0, 0.5e0, 0e0]) AS z)) GROUP BY ALL""",
    ("strengths",),
)
def _(spark, d):
    return R.anchor_threshold_sweep(strength(spark, d)).withColumn("threshold", F.round("threshold", 6))
