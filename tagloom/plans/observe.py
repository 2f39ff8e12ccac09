"""Query observation: axis analysis, residual pyramid, seed gating and spike propagation, for many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.columns import clamp, clamp01, positive
from tagloom.functions.text import technical_name
from tagloom.functions.vectors import dot, magnitude
from tagloom.operators.distances import nearest_by_distance
from tagloom.operators.graph import ListedGraph, strongest_out_edges
from tagloom.operators.neighbours import top_neighbours
from tagloom.operators.running import top_n
from tagloom.params import PyramidParams, SpikeParams
from tagloom.session import broadcast_if_fits, cut_lineage

# fixed values: axis labels of a social world
SOCIAL_WORLDS = "politics|society|history|economics|culture"


def axis_basis(tag_vectors: DataFrame, axes: int = 64) -> DataFrame:
    """(axis, mean, basis, energy, label): principal axes of the tag vectors, label = tag with the largest projection.

    Partial second moments are summed per partition; only the dim x dim matrix reaches the driver.
    """
    spark = tag_vectors.sparkSession

    def moments(batches):
        total = outer = None
        n = 0
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack(pdf["vector"]).astype(np.float64)
            n += len(m)
            total = m.sum(axis=0) if total is None else total + m.sum(axis=0)
            outer = m.T @ m if outer is None else outer + m.T @ m
        if n:
            for i in range(len(total)):
                yield pd.DataFrame({"i": [i], "n": [n], "total": [total[i]], "line": [outer[i]]})

    cells = tag_vectors.select("vector").mapInPandas(moments, "i int, n bigint, total double, line array<double>")
    lines = (
        cells.select("i", "n", "total", F.posexplode("line").alias("j", "x")).groupBy("i", "j")
        .agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("total").alias("total"))
        .groupBy("i").agg(F.first("n").alias("n"), F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("j", "x")))["x"].alias("line"))
        .orderBy("i").collect()
    )
    if not lines:
        return spark.createDataFrame([], "axis int, mean array<double>, basis array<double>, energy double, label bigint")
    n = lines[0]["n"]
    mean = np.array([r["total"] for r in lines]) / n
    cov = np.stack([r["line"] for r in lines]) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:axes]
    rows = []
    for a, i in enumerate(top):
        v = vectors[:, i]
        v = v if v[np.argmax(np.abs(v))] > 0 else -v
        rows.append((a, mean.tolist(), v.tolist(), float(max(values[i], 0.0))))
    basis = spark.createDataFrame(rows, "axis int, mean array<double>, basis array<double>, energy double")
    axes_ = spark.sparkContext.broadcast(np.stack([r[2] for r in rows]))
    centre = spark.sparkContext.broadcast(mean)

    def farthest(batches):
        for pdf in batches:
            if len(pdf):
                shadow = np.round(np.abs((np.stack(pdf["vector"]).astype(np.float64) - centre.value) @ axes_.value.T), 9)
                ids = pdf["tag_id"].to_numpy()
                for axis in range(shadow.shape[1]):
                    top = shadow[:, axis].max()
                    yield pd.DataFrame({"axis": [axis], "shadow": [top], "tag_id": [ids[shadow[:, axis] == top].min()]})

    best = tag_vectors.select("tag_id", "vector").mapInPandas(farthest, "axis int, shadow double, tag_id bigint")
    labels = best.groupBy("axis").agg(F.min_by("tag_id", F.struct(-F.col("shadow"), F.col("tag_id"))).alias("label"))
    return basis.join(labels, "axis")


def axis_analysis(queries: DataFrame, basis: DataFrame) -> DataFrame:
    """(query_id, logic_depth, entropy, resonance, axes, bridges, world): how a query spreads over the axes."""
    # the basis has at most 64 rows: one array value that every query unfolds
    axes = basis.agg(F.collect_list(F.struct("axis", "label", "mean", "basis")).alias("b")).scalar()
    centred = F.zip_with("vector", "a.mean", lambda x, m: x.cast("double") - m)
    p = queries.select("query_id", "vector").withColumn("a", F.explode(axes)).select(
        "query_id", F.col("a.axis").alias("axis"), F.col("a.label").alias("label"), dot(centred, F.col("a.basis")).alias("projection")
    )
    totals = p.groupBy("query_id").agg(F.sum(F.col("projection") ** 2).alias("total"), F.count(F.lit(1)).alias("n"))
    shares = p.join(totals.filter("total > 1e-12"), "query_id").withColumn("share", F.col("projection") ** 2 / F.col("total"))
    info = F.when(F.col("share") > 1e-9, -F.col("share") * F.log2("share"))
    dominant = F.when(F.col("share") > 0.05, F.struct((-F.col("share")).alias("neg"), F.col("axis"), F.col("label")))
    summed = shares.groupBy("query_id").agg(
        F.first("n").alias("n"), F.sum(info).alias("info"), F.array_sort(F.collect_list(dominant)).alias("axes")
    )
    entropy = F.when(F.col("n") > 1, clamp01(F.coalesce("info", F.lit(0.0)) / F.log2(F.col("n").cast("double")))).otherwise(0.0)
    strengths = F.filter(
        F.transform(F.slice("axes", 2, F.greatest(F.size("axes"), F.lit(1))), lambda a: F.sqrt(a["neg"] * F.col("axes")[0]["neg"])),
        lambda s: s > 0.15,
    )
    analysed = summed.withColumns({"entropy": entropy, "strengths": strengths}).select(
        "query_id", (1 - F.col("entropy")).alias("logic_depth"), "entropy",
        F.aggregate("strengths", F.lit(0.0), lambda s, x: s + x).alias("resonance"),
        F.size("axes").alias("axes"), F.size("strengths").alias("bridges"), F.try_element_at("axes", F.lit(1))["label"].alias("world"),
    )
    return queries.select("query_id").join(analysed, "query_id", "left").select(
        "query_id",
        F.coalesce("logic_depth", F.lit(0.0)).alias("logic_depth"),
        F.coalesce("entropy", F.lit(1.0)).alias("entropy"),
        F.coalesce("resonance", F.lit(0.0)).alias("resonance"),
        F.coalesce("axes", F.lit(0)).alias("axes"),
        F.coalesce("bridges", F.lit(0)).alias("bridges"),
        "world",
    )


def project_level(residual: np.ndarray, tags: np.ndarray) -> dict:
    """One query and its few tag vectors in rank order: coefficients, next residual and handshake features."""
    units, coefficients = [], np.zeros(len(tags))
    for i, t in enumerate(tags):
        v = t.copy()
        for u in units:
            v -= (v @ u) * u
        norm = np.sqrt(v @ v)
        if norm > 1e-12:
            v /= norm
            coefficients[i] = abs(residual @ v)
            units.append(v)
    explained = sum(((residual @ u) * u for u in units), np.zeros_like(residual))
    delta = residual[None, :] - tags
    distance = np.sqrt((delta * delta).sum(axis=1))
    direction = np.where(distance[:, None] > 1e-9, delta / np.maximum(distance, 1e-12)[:, None], 0.0)
    coherence = min(1.0, float(np.sqrt((direction.mean(axis=0) ** 2).sum())))
    lead = np.abs(direction[:5] @ direction[:5].T)
    pairs = lead[np.triu_indices(len(lead), 1)]
    pattern = min(1.0, float(pairs.mean())) if len(pairs) else 0.0
    return {
        "coefficients": coefficients,
        "residual": residual - explained,
        "distance": distance,
        "coherence": coherence,
        "pattern": pattern,
        "noise": (1 - coherence) * (1 - pattern),
    }


def _explain_level(level: int):
    def explain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        residual = np.asarray(pdf["residual"].iloc[0], dtype=np.float64)
        out = project_level(residual, np.stack(pdf["vector"]).astype(np.float64))
        before, after, e0 = float(residual @ residual), float(out["residual"] @ out["residual"]), float(pdf["energy0"].iloc[0])
        entries = [
            {"tag_id": int(t), "rank": int(r), "similarity": 1.0 / (1.0 + float(dd) ** 2), "contribution": float(c), "distance": float(dd)}
            for t, r, c, dd in zip(pdf["item_id"], pdf["rank"], out["coefficients"], out["distance"])
        ]
        row = [int(pdf["query_id"].iloc[0]), level, entries, out["residual"].tolist(), e0, max(before - after, 0.0) / e0, after / e0]
        row += [out["coherence"], out["pattern"], out["noise"]]
        names = ["query_id", "level", "tags", "vector", "energy0", "explained", "ratio", "coherence", "pattern", "noise"]
        return pd.DataFrame([row], columns=names)

    return explain


def residual_pyramid(queries: DataFrame, tag_vectors: DataFrame, p: PyramidParams = PyramidParams()) -> tuple[DataFrame, DataFrame]:
    """Explain each query by its nearest tags, then its remainder by the next ones.

    Returns (levels, features): levels (query_id, level, tag_id, rank, similarity, contribution), features per query.
    """
    start = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    open_ = cut_lineage(start.withColumn("energy0", magnitude(F.col("vector")) ** 2).filter("energy0 > 1e-12"), "pyramid")
    tags = tag_vectors.select(F.col("tag_id").alias("item_id"), "vector")
    schema = (
        "query_id bigint, level int, tags array<struct<tag_id:bigint,rank:int,similarity:double,contribution:double,distance:double>>, "
        "vector array<double>, energy0 double, explained double, ratio double, coherence double, pattern double, noise double"
    )
    done = None
    for level in range(p.levels):
        near = nearest_by_distance(open_, tags, p.top_k)
        rows = near.join(tags, "item_id").join(open_.select("query_id", F.col("vector").alias("residual"), "energy0"), "query_id")

        step = cut_lineage(rows.groupBy("query_id").applyInPandas(_explain_level(level), schema), "pyramid")
        done = step if done is None else done.unionByName(step)
        open_ = step.filter(F.col("ratio") >= p.stop_ratio).select("query_id", "vector", "energy0")
    levels = done.select("query_id", "level", F.explode("tags").alias("t")).select("query_id", "level", "t.*")
    first = F.col("level") == 0
    sums = done.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("depth"),
        clamp01(F.sum("explained")).alias("coverage"),
        F.max(F.when(first, F.col("coherence"))).alias("novelty_signal"),
        F.max(F.when(first, F.col("pattern"))).alias("coherence"),
        F.max(F.when(first, F.col("noise"))).alias("noise"),
    )
    features = queries.select("query_id").join(sums, "query_id", "left").select(
        "query_id",
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.when(F.col("depth") > 0, clamp01(0.7 * (1 - F.col("coverage")) + 0.3 * F.col("novelty_signal"))).otherwise(1.0).alias("novelty"),
        F.coalesce("coherence", F.lit(0.0)).alias("coherence"),
        clamp01(F.col("coverage") * F.col("coherence") * (1 - F.col("noise"))).alias("activation"),
    )
    return levels, features


def gate_seeds(
    levels: DataFrame,
    features: DataFrame,
    axes: DataFrame,
    tags: DataFrame,
    core: DataFrame | None = None,
    world_names: DataFrame | None = None,
    p: PyramidParams = PyramidParams(),
) -> tuple[DataFrame, DataFrame]:
    """(seeds, boosts): weighted start tags, and per query the blend factor alpha and the core boost.

    The first level a tag appears in wins. `core` (query_id, name) marks wanted tags; `world_names` (world, world_name)
    names the strongest axis.
    """
    first = levels.groupBy("query_id", "tag_id").agg(F.min_by(F.struct("level", "similarity", "contribution"), F.struct("level", "rank")).alias("f")).select("query_id", "tag_id", "f.*")
    world = axes if world_names is None else axes.join(broadcast_if_fits(world_names), "world", "left")
    if world_names is None:
        world = world.withColumn("world_name", F.lit(None).cast("string"))
    name = F.coalesce("world_name", F.lit("Unknown"))
    dynamic = F.col("logic_depth") * (1 + F.log1p("resonance")) / (1 + 0.5 * F.col("entropy")) * (0.5 + F.col("activation"))
    core_boost = p.core_boost_low + p.core_boost_range * (0.5 * F.col("logic_depth") + 0.5 * (1 - F.col("coverage")))
    boosts = world.join(features, "query_id").select(
        "query_id",
        clamp01(0.6 * clamp(dynamic, 0.3, 2.0)).alias("alpha"),
        core_boost.alias("core_boost"),
        (name == "Unknown").alias("world_unknown"),
        F.lower(name).rlike(SOCIAL_WORLDS).alias("social"),
        ((name != "Unknown") & technical_name(name, False)).alias("technical_world"),
    )
    rows = first.join(tags.select("tag_id", "name"), "tag_id").join(boosts, "query_id")
    if core is not None:
        marked = core.select("query_id", F.lower("name").alias("core_name")).distinct().withColumn("is_core", F.lit(True))
        rows = rows.withColumn("core_name", F.lower("name")).join(marked, ["query_id", "core_name"], "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
    else:
        rows = rows.withColumn("is_core", F.lit(False))
    penalty = F.when(F.col("world_unknown"), p.language_penalty_unknown).otherwise(p.language_penalty)
    language = F.when(technical_name(F.col("name")) & ~F.col("technical_world"), F.when(F.col("social"), F.sqrt(penalty)).otherwise(penalty)).otherwise(1.0)
    relevance = F.when(F.col("similarity") != 0, F.col("similarity")).otherwise(0.5)
    gain = F.when(F.col("is_core"), F.col("core_boost") * (0.95 + 0.1 * relevance)).otherwise(1.0)
    weight = positive(F.col("contribution")) * F.pow(F.lit(p.level_decay), F.col("level")) * language * gain
    seeds = rows.select("query_id", "tag_id", weight.alias("energy"), "is_core").filter("energy > 0")
    return seeds, boosts.select("query_id", "alpha", "core_boost")


def cosine_seeds(queries: DataFrame, tag_vectors: DataFrame, k: int = 10) -> DataFrame:
    """Plain seeds: the k nearest tags of each query, weighted by cosine."""
    near = top_neighbours(queries, tag_vectors.select(F.col("tag_id").alias("item_id"), "vector"), k)
    return near.filter("score > 0").select("query_id", F.col("item_id").alias("tag_id"), F.col("score").alias("energy"), F.lit(False).alias("is_core"))


def propagate(
    seeds: DataFrame, transport: DataFrame | ListedGraph, p: SpikeParams = SpikeParams(), anchor: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Spread seed energy over the strongest out-edges for a few hops. Returns (nodes, edges) per query.

    A state is (query, previous, node). Each hop is one join with at most `neighbours` edges per state and one
    aggregation that yields both the edge flows and the next states; states are capped per query by energy. A `ListedGraph`
    is asked in each hop for the out-edges of the nodes that fire, at most `max_states` per query.
    """
    weights = p.hop_weights()

    def strongest(edges: DataFrame) -> DataFrame:
        graph = edges if "rank" in edges.columns else strongest_out_edges(edges, p.neighbours)
        if anchor is not None:
            graph = graph.join(anchor.select(F.col("tag_id").alias("dst"), "anchor_gain"), "dst", "left")
        else:
            graph = graph.withColumn("anchor_gain", F.lit(1.0))
        return cut_lineage(
            graph.select(
                F.col("src").alias("node"), "dst", F.col("weight").alias("w"),
                (F.col("wormhole") | (F.col("weight") * F.coalesce("anchor_gain", F.lit(1.0)) >= p.tension)).alias("worm"),
            ),
            "spike-graph",
        )

    listed = isinstance(transport, ListedGraph)
    if listed:
        known = transport.damping.select(F.col("tag_id").alias("node"))
    else:
        graph = strongest(transport)
        known = graph.select("node").union(graph.select("dst")).distinct()
    start = seeds.filter("energy > 0").join(known.withColumnRenamed("node", "tag_id"), "tag_id", "left_semi").groupBy("query_id", F.col("tag_id").alias("node")).agg(
        F.sum("energy").alias("energy"), F.bool_or("is_core").alias("is_core")
    )
    start = cut_lineage(start, "spike-seeds")
    states = start.select(
        "query_id", F.lit(None).cast("bigint").alias("prev"), "node", "energy", F.lit(p.momentum).alias("momentum"), F.col("node").alias("seed_id")
    )
    reached = start.select("query_id", "node", (F.col("energy") * weights[0]).alias("energy"), F.lit(0).alias("hop"), F.lit(-1).cast("bigint").alias("prev"), F.col("node").alias("seed_id"), "is_core")
    flows = None
    for hop in range(p.hops):
        fired = states.filter((F.col("energy") >= p.firing) & (F.col("momentum") >= 0))
        if listed:
            graph = strongest(transport.out_edges(fired.select(F.col("node").alias("tag"))))
        back = F.coalesce(F.col("prev") == F.col("dst"), F.lit(False))
        decay = F.when(F.col("worm"), p.wormhole_decay).otherwise(p.decay)
        moved = (
            fired.join(graph, "node")
            .withColumns({"back": back, "inj": F.col("energy") * F.col("w") * decay * F.when(back, p.return_factor).otherwise(1.0)})
            .filter(F.col("inj") >= p.min_current)
            .withColumn("next_m", F.col("momentum") - F.when(F.col("worm"), 0.0).otherwise(1.0))
        )
        lives = (F.col("next_m") >= 0) | F.col("worm")
        agg = moved.groupBy("query_id", F.col("node").alias("src"), "dst").agg(
            F.sum("inj").alias("flow"),
            F.max("inj").alias("max_flow"),
            F.first("w").alias("conductance"),
            F.lit(hop + 1).alias("hop"),
            F.bool_or("worm").alias("wormhole"),
            F.bool_or("back").alias("immediate_return"),
            F.sum(F.when(lives, F.col("inj"))).alias("energy"),
            F.max(F.when(lives, F.col("next_m"))).alias("momentum"),
            F.min_by("seed_id", F.when(lives, F.coalesce("prev", F.lit(-1)))).alias("seed_id"),
        )
        agg = cut_lineage(agg, "spike-flows")
        flows = agg if flows is None else flows.unionByName(agg)
        alive = agg.filter("energy IS NOT NULL").select("query_id", F.col("src").alias("prev"), F.col("dst").alias("node"), "energy", "momentum", "seed_id")
        states = cut_lineage(top_n(alive, ["query_id"], [F.desc("energy"), F.asc("prev"), F.asc("node")], p.max_states).drop("rank"), "spike-states")
        here = states.select("query_id", "node", (F.col("energy") * weights[hop + 1]).alias("energy"), F.lit(hop + 1).alias("hop"), "prev", "seed_id", F.lit(False).alias("is_core"))
        reached = reached.unionByName(here)
    parents = flows.groupBy("query_id", F.col("dst").alias("node")).agg(
        F.max_by(F.struct(F.col("src").alias("parent_id"), F.col("max_flow").alias("parent_flow")), F.struct("max_flow", -F.col("hop"), -F.col("src"))).alias("p")
    )
    nodes = reached.groupBy("query_id", "node").agg(
        F.sum("energy").alias("energy"), F.min("hop").alias("hop"), F.min_by("seed_id", F.struct("hop", "prev")).alias("seed_id"), F.bool_or("is_core").alias("is_core")
    )
    totals = nodes.groupBy("query_id").agg(F.max("energy").alias("top"), F.sum("energy").alias("total"))
    nodes = nodes.join(totals, "query_id").join(parents, ["query_id", "node"], "left").select(
        "query_id", F.col("node").alias("tag_id"), "energy",
        F.when(F.col("top") > 0, F.col("energy") / F.col("top")).otherwise(0.0).alias("normalized"),
        F.when(F.col("total") > 0, F.col("energy") / F.col("total")).otherwise(0.0).alias("source_mass"),
        "hop", F.when(F.col("hop") > 0, "emergent").when(F.col("is_core"), "core").otherwise("seed").alias("source_type"),
        "seed_id", "p.parent_id", "p.parent_flow",
    )
    edges = flows.groupBy("query_id", "src", "dst").agg(
        F.sum("flow").alias("flow"), F.max("max_flow").alias("max_flow"), F.first("conductance").alias("conductance"),
        F.min("hop").alias("min_hop"), F.bool_or("wormhole").alias("wormhole"), F.bool_or("immediate_return").alias("immediate_return"),
    )
    peak = edges.groupBy("query_id").agg(F.max("flow").alias("peak"))
    edges = edges.join(peak, "query_id").withColumn("normalized_flow", F.when(F.col("peak") > 0, F.col("flow") / F.col("peak")).otherwise(0.0)).drop("peak")
    return nodes, edges


def matched_tags(selected: DataFrame, tags: DataFrame, p: PyramidParams = PyramidParams()) -> DataFrame:
    """(query_id, matched, core): names of fused tags above the output threshold, core ones always."""
    top = selected.groupBy("query_id").agg(F.max("weight").alias("top"))
    named = selected.join(tags.select("tag_id", "name"), "tag_id").join(top, "query_id")
    limit = F.when(technical_name(F.col("name")), p.technical_output).otherwise(p.plain_output)
    shown = F.when(F.col("is_core") | (F.col("weight") > F.col("top") * limit), F.col("name"))
    return named.groupBy("query_id").agg(
        F.array_sort(F.collect_set(shown)).alias("matched"), F.array_sort(F.collect_set(F.when(F.col("is_core"), F.col("name")))).alias("core")
    )




def query_state(axes: DataFrame, features: DataFrame) -> DataFrame:
    """Axis and pyramid numbers of a query, as the curve ranking weighs them."""
    f = features.select("query_id", F.col("coverage").alias("coverage_q"), "novelty", "depth")
    return axes.join(f, "query_id").select("query_id", "logic_depth", "entropy", "resonance", "coverage_q", "novelty", "depth")
