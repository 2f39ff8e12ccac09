"""Fusion of observed tags into one vector, and restart-diffusion fields over the tag graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.ledger import cumulative_domain
from tagloom.operators.running import top_n
from tagloom.operators.walks import BLOCK, LANE_BYTES, BlockedGraph, Walk
from tagloom.params import FieldParams, PyramidParams
from tagloom.plans.panels import assign_slots, to_panels
from tagloom.session import cut_lineage, new_stage_path, write_once

# Edges of one partition of the graph in a walk.
PART_EDGES = 4_000_000


def fuse(
    queries: DataFrame,
    nodes: DataFrame,
    seeds: DataFrame,
    boosts: DataFrame,
    tag_vectors: DataFrame,
    core: DataFrame | None = None,
    ghosts: DataFrame | None = None,
    p: PyramidParams = PyramidParams(),
) -> tuple[DataFrame, DataFrame]:
    """(fused, selected): blended query vectors and the tags that carry them.

    Per query at most the seeds, `emergent_top` emergent tags, missing core tags and ghost tags meet in one group.
    `core` (query_id, tag_id) lists wanted tags; `ghosts` (query_id, ghost_id < 0, vector, is_core) are outside the graph.
    """
    live = nodes.filter("energy > 0").select("query_id", "tag_id", "energy")
    marked = live.join(seeds.select("query_id", "tag_id", F.col("energy").alias("seed_weight"), "is_core"), ["query_id", "tag_id"], "left")
    observed = marked.filter("seed_weight IS NOT NULL").select("query_id", "tag_id", F.greatest("seed_weight", "energy").alias("weight"), "is_core")
    emergent = top_n(
        marked.filter("seed_weight IS NULL").select("query_id", "tag_id", "energy"), ["query_id"], [F.desc("energy"), F.asc("tag_id")], p.emergent_top
    ).select("query_id", "tag_id", F.col("energy").alias("weight"), F.lit(False).alias("is_core"))
    merged = observed.unionByName(emergent)
    base = boosts.join(merged.groupBy("query_id").agg((F.max("weight") / p.base_divisor).alias("base")), "query_id", "left").select(
        "query_id", "alpha", "core_boost", F.coalesce("base", F.lit(1.0)).alias("base")
    )
    if core is not None:
        missing = core.select("query_id", "tag_id").distinct().join(merged, ["query_id", "tag_id"], "left_anti").join(base, "query_id")
        merged = merged.unionByName(missing.select("query_id", "tag_id", (F.col("base") * F.col("core_boost")).alias("weight"), F.lit(True).alias("is_core")))
    carried = merged.join(tag_vectors.select("tag_id", "vector"), "tag_id").select("query_id", "tag_id", "weight", "is_core", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    if ghosts is not None:
        g = ghosts.join(base, "query_id").select(
            "query_id", F.col("ghost_id").alias("tag_id"), (F.col("base") * F.when(F.col("is_core"), F.col("core_boost")).otherwise(1.0)).alias("weight"),
            "is_core", F.transform("vector", lambda x: x.cast("double")).alias("vector"),
        )
        carried = carried.unionByName(g)

    def dedup(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "tag_id"], ascending=[False, True])
        m = np.stack(pdf["vector"]).astype(np.float64)
        norm = np.sqrt((m * m).sum(axis=1))
        u = m / np.where(norm > 0, norm, 1.0)[:, None]
        near = u @ u.T > p.dedup_cosine
        ids, weight, is_core = pdf["tag_id"].to_numpy(), pdf["weight"].to_numpy().copy(), pdf["is_core"].to_numpy().copy()
        kept: list[int] = []
        for i in range(len(ids)):
            twin = next((k for k in kept if near[i, k]), None)
            if norm[i] <= 1e-12:
                continue
            if twin is None:
                kept.append(i)
            else:
                weight[twin] += weight[i] * p.dedup_share
                is_core[twin] |= is_core[i]
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "tag_id": ids[kept], "weight": weight[kept], "is_core": is_core[kept], "vector": [m[k] for k in kept]})

    selected = cut_lineage(
        carried.groupBy("query_id").applyInPandas(dedup, "query_id bigint, tag_id bigint, weight double, is_core boolean, vector array<double>"), "fusion"
    )
    context = weighted_means(selected, ["query_id"], "weight")
    blended = queries.select("query_id", "vector").join(base.select("query_id", "alpha"), "query_id").join(
        context.withColumnRenamed("vector", "context"), "query_id", "left"
    )
    mix = F.when(
        F.col("context").isNull(), F.transform("vector", lambda x: x.cast("double"))
    ).otherwise(F.zip_with("vector", "context", lambda q, c: (1 - F.col("alpha")) * q.cast("double") + F.col("alpha") * c))
    from tagloom.functions.vectors import normalised

    return blended.select("query_id", normalised(mix).alias("vector")), selected.drop("vector")


def weighted_means(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, vector): normalised weighted mean of vectors, as dense partial sums per batch and a final sum."""
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            for key, g in pdf.groupby(keys, sort=False):
                w = g[weight].to_numpy(dtype=np.float64)
                total = w @ np.stack(g["vector"]).astype(np.float64)
                yield pd.DataFrame([[*(key if isinstance(key, tuple) else (key,)), total]], columns=[*keys, "vector"])

    parts = df.select(*keys, weight, "vector").filter(F.col(weight) > 0).mapInPandas(partial, f"{key_schema}, vector array<double>")
    summed = parts.select(*keys, F.posexplode("vector").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    dense = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("vector"))
    from tagloom.functions.vectors import normalised

    return dense.select(*keys, normalised(F.col("vector")).alias("vector"))


def series_length(alpha: float, p: FieldParams = FieldParams(), row_mass: float = 0.95) -> int:
    """Steps after which nothing larger than the tolerance is left: each step shrinks the remainder by alpha * row_mass."""
    return min(p.max_iterations, math.ceil(math.log(p.tolerance) / math.log(alpha * row_mass)))


def _coefficient(alpha: float, steps: int):
    return F.when(F.col("step") < steps, (1 - alpha) * F.pow(F.lit(alpha), F.col("step"))).otherwise(alpha**steps)


def _blocked_fields(mass: DataFrame, slots: DataFrame, width: int, graph: BlockedGraph, p: FieldParams, steps: int) -> DataFrame:
    """`dual_fields` in blocks, a few panels at a time: as many as a lane has room for."""
    spark = mass.sparkSession
    cols = [f"y{i}" for i in range(width)]
    y = cut_lineage(to_panels(mass, slots, "node", "m").select("panel", "node", *cols), "field-0")
    factors = {"local": _coefficient(p.alpha_local, steps), "transfer": _coefficient(p.alpha_transfer, steps)}
    panels = sorted(r["panel"] for r in slots.select("panel").distinct().collect())
    root = new_stage_path(spark, "field-terms")
    probe = Walk(graph, width)
    at_once = min(max(1, LANE_BYTES // (math.ceil(probe.n_blocks / probe.lanes) * probe.span * width * 8)), max(1, len(panels)))
    with Walk(graph, width, at_once) as walk:
        for g in range(0, len(panels), at_once):
            write_once(walk.blocks(y.filter(F.col("panel").isin(panels[g : g + at_once]))), f"{root}/group={g}/step=0")
            now = spark.read.schema(BLOCK).parquet(f"{root}/group={g}/step=0")
            for k in range(1, steps + 1):
                now = walk.step(now, f"{root}/group={g}/step={k}")
        terms = spark.read.schema("panel bigint, i int, y binary, step int").parquet(*[f"{root}/group={g}" for g in range(0, len(panels), at_once)]) if panels else None
    # Tags without edges keep what they start with.
    alone = mass.join(graph.places.select(F.col("tag_id").alias("node")), "node", "left_anti").groupBy("query_id", F.col("node").alias("tag_id")).agg(F.sum("m").alias("m"))
    first = alone.withColumn("step", F.lit(0)).select("query_id", "tag_id", *[(F.col("m") * f).alias(n) for n, f in factors.items()])
    if terms is None:
        return first
    return walk.spread(terms, factors).join(F.broadcast(slots), ["panel", "slot"]).select("query_id", "tag_id", *factors).unionByName(first)


def dual_fields(source: DataFrame, transport: DataFrame | BlockedGraph, p: FieldParams = FieldParams(), steps: int | None = None) -> DataFrame:
    """(query_id, tag_id, local, transfer): two restart diffusions of the source masses over the graph.

    Both fields are sums over the same powers of the transport step, so one walk serves them. Queries travel as
    panels of PANEL columns: a step joins each edge once per panel instead of once per query. A `BlockedGraph` is walked in
    blocks, without a row an edge.
    """
    steps = steps or max(series_length(p.alpha_local, p), series_length(p.alpha_transfer, p))
    spark = source.sparkSession
    mass = source.filter("source_mass > 0").select("query_id", F.col("tag_id").alias("node"), F.col("source_mass").alias("m"))
    slots = assign_slots(mass)
    width = (slots.agg(F.max("slot").alias("s")).first()["s"] or 0) + 1
    if isinstance(transport, BlockedGraph):
        return _blocked_fields(mass, slots, width, transport, p, steps)
    cols = [f"y{i}" for i in range(width)]
    y = cut_lineage(to_panels(mass, slots, "node", "m").select("panel", "node", *cols), "field-0")
    root = new_stage_path(spark, "field-terms")
    schema = y.schema
    y.write.parquet(f"{root}/step=0")
    # One row per source tag with its edges, partitioned and sorted by it: a step sorts and shuffles only the panels and lays out
    # the edges of reached tags. Few partitions, so that masses of one target are summed before they are shuffled.
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(transport.count() / PART_EDGES))
    listed = transport.select(F.col("src").alias("node"), "dst", F.col("weight").alias("w")).repartition(parts, "node").groupBy("node")
    edges = listed.agg(F.collect_list(F.struct("dst", "w")).alias("out")).sortWithinPartitions("node").persist()
    try:
        for k in range(1, steps + 1):
            spread = y.join(edges, "node").select("panel", *cols, F.explode("out").alias("e"))
            nxt = spread.groupBy("panel", F.col("e.dst").alias("node")).agg(*[F.sum(F.col(c) * F.col("e.w")).alias(c) for c in cols])
            write_once(nxt, f"{root}/step={k}")
            y = spark.read.schema(schema).parquet(f"{root}/step={k}")
    finally:
        edges.unpersist()
    terms = spark.read.parquet(root)

    sums = terms.groupBy("panel", "node").agg(
        *[F.sum(F.col(c) * _coefficient(p.alpha_local, steps)).alias(f"l{i}") for i, c in enumerate(cols)],
        *[F.sum(F.col(c) * _coefficient(p.alpha_transfer, steps)).alias(f"t{i}") for i, c in enumerate(cols)],
    )
    lanes = F.filter(
        F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"l{i}").alias("local"), F.col(f"t{i}").alias("transfer")) for i in range(width)]),
        lambda v: (v["local"] > 0) | (v["transfer"] > 0),
    )
    return sums.select("panel", F.col("node").alias("tag_id"), F.explode(lanes).alias("v")).select("panel", "tag_id", "v.*").join(slots, ["panel", "slot"]).select(
        "query_id", "tag_id", "local", "transfer"
    )


def field_domains(fields: DataFrame, p: FieldParams = FieldParams()) -> DataFrame:
    """Fields with flags for the tags that hold the first share of each field's mass."""
    local = cumulative_domain(fields.select("query_id", "tag_id", "local"), ["query_id"], "local", "tag_id", p.local_domain)
    transfer = cumulative_domain(fields.select("query_id", "tag_id", "transfer"), ["query_id"], "transfer", "tag_id", p.transfer_domain)
    return (
        fields.join(local.select("query_id", "tag_id", F.lit(True).alias("in_local")), ["query_id", "tag_id"], "left")
        .join(transfer.select("query_id", "tag_id", F.lit(True).alias("in_transfer")), ["query_id", "tag_id"], "left")
        .withColumns({"in_local": F.coalesce("in_local", F.lit(False)), "in_transfer": F.coalesce("in_transfer", F.lit(False))})
    )


def field_vectors(fields: DataFrame, tag_vectors: DataFrame, column: str) -> DataFrame:
    """(query_id, vector): mass-weighted mean of tag vectors, normalised."""
    rows = fields.select("query_id", "tag_id", F.col(column).alias("w")).join(tag_vectors.select("tag_id", "vector"), "tag_id")
    return weighted_means(rows, ["query_id"], "w")
