"""Weighted, directed tag co-occurrence graph with per-note provenance."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tagloom.functions.columns import clamp, clamp01
from tagloom.operators.order_stats import upper_median
from tagloom.params import GraphParams
from tagloom.session import broadcast_if_fits, cut_lineage

# Pairs that a task adds up, about; pairs of a tag above which they are shuffled one by one, and buckets that tell where such tags are.
TASK_PAIRS = 1_000_000
HOT_PAIRS = 2_000_000
HOT_BUCKETS = 65_536
# Tags (8 bytes each) that may be shipped to every task to find their out-edges.
ASKED_TAGS = 1_000_000


def tag_lists(file_tags: DataFrame, max_tags: int = 100, numbered: bool = False, carried: dict[str, str] | None = None) -> DataFrame:
    """(file_id, tags, positions): each file of 2..max_tags tags in one row, its tags in order of position.

    `numbered` leaves the positions out: they are the places in the list, from 1, and `position` only orders the tags. `carried`
    names more lists and the columns they are of. Rows stream through a task file by file; of an oversized file it holds
    max_tags + 1 rows, then the size rule drops it.
    """
    listed = {"tags": "tag_id"} | ({} if numbered else {"positions": "position"}) | (carried or {})
    rows = file_tags.select("file_id", "tag_id", "position", *(carried or {}).values()).repartition("file_id").sortWithinPartitions("file_id")
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("file_id", kinds["file_id"]), *(T.StructField(k, T.ArrayType(kinds[v])) for k, v in listed.items())])

    def whole(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(starts, append=len(rows))
        kept = (sizes >= 2) & (sizes <= max_tags)
        mine = np.flatnonzero(np.repeat(kept, sizes))
        inside = rows.take(pa.array(mine))
        order = np.lexsort([*_keys(inside["tag_id"]), *_keys(inside["position"]), np.repeat(np.flatnonzero(kept), sizes[kept])])
        mine = pa.array(mine[order])
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, rows[v].combine_chunks().take(mine)) for v in listed.values()]
        return pa.RecordBatch.from_arrays([rows["file_id"].combine_chunks().take(pa.array(starts[kept])), *lists], ["file_id", *listed])

    def lists(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            file, unknown = rows["file_id"].fill_null(0).to_numpy(), rows["file_id"].is_null().to_numpy()
            starts = np.concatenate([[0], 1 + np.flatnonzero((file[1:] != file[:-1]) | (unknown[1:] != unknown[:-1]))])
            yield whole(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1], max_tags + 1)
        if held is not None:
            yield whole(held, np.zeros(1, dtype=np.int64))

    return rows.mapInArrow(lists, schema)


def _keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Sort keys of a column of whole numbers, the last one first; nulls come before all."""
    return [column.fill_null(0).to_numpy(), column.is_valid().to_numpy()] if column.null_count else [column.to_numpy()]


def _listed(file_tags: DataFrame, max_tags: int) -> DataFrame:
    return file_tags if "tags" in file_tags.columns else tag_lists(file_tags, max_tags)


def ordered_pairs(file_tags: DataFrame, max_tags: int = 100) -> DataFrame:
    """Pairs left-before-right inside each file of 2..max_tags tags; `file_tags` may be given as its `tag_lists`."""
    lists = _listed(file_tags, max_tags)
    lists = lists.withColumns({"n": F.size("tags"), "repeats": F.size(F.array_distinct("tags")) < F.size("tags")})
    left = lists.select("*", F.posexplode("tags").alias("_i", "tag_l"))
    right = left.select("*", F.posexplode("tags").alias("_j", "tag_r")).filter((F.col("_j") > F.col("_i")) & (F.col("tag_l") != F.col("tag_r")))
    return right.select("file_id", "n", "tag_l", "tag_r", _place(lists, "_i").alias("pos_l"), _place(lists, "_j").alias("pos_r"), "repeats")


def _place(lists: DataFrame, at: str) -> Column:
    """Position of the tag that stands at index `at` of its list."""
    return F.col("positions")[F.col(at)] if "positions" in lists.columns else F.col(at) + 1


def semantic_gain(similarity: Column, p: GraphParams) -> Column:
    s = F.coalesce(similarity, F.lit(p.low_similarity))
    bell = p.bell_base + p.bell_height * F.exp(-((s - p.bell_center) ** 2) / (2 * p.bell_width**2))
    return F.when(s < p.low_branch, p.low_base + s).otherwise(bell)


class _Columns:
    greatest, least, exp, lit = F.greatest, F.least, F.exp, F.lit

    @staticmethod
    def where(test, a, b):
        return F.when(test, a).otherwise(b)


class _Arrays:
    greatest, least, exp, lit, where = np.maximum, np.minimum, np.exp, float, np.where


def _pair_weights(n, pos_l, pos_r, p: GraphParams, sem, reverse, on=_Columns):
    """What a file of n tags adds to the edge from its left to its right tag, and to the edge back; of columns or of arrays."""

    def phi(pos):
        span = on.greatest(n - 1, on.lit(1))
        return p.position_top - p.position_drop * on.greatest(pos - 1, on.lit(0)) / span

    step = on.greatest(pos_r - pos_l, on.lit(1)) - 1
    base = phi(pos_l) * phi(pos_r)
    if p.distance_decay:
        base = base * on.exp(-p.distance_decay * step)
    ordered = (pos_l > 0) & (pos_r > 0)
    forward = on.where(ordered, base * p.forward_gain * sem, p.unordered_gain * sem)
    backward = on.where(ordered, on.least(base * reverse * sem, base * p.forward_gain * sem * p.reverse_ceiling), p.unordered_gain * sem)
    return forward, backward


def _reverse(p: GraphParams) -> float:
    return min(max(p.reverse_gain, p.reverse_low), p.reverse_high)


def fact_edges(
    file_tags: DataFrame,
    p: GraphParams = GraphParams(),
    similarity: DataFrame | None = None,
    anchor: DataFrame | None = None,
) -> DataFrame:
    """(src, dst, weight): both directions of every ordered pair, summed over files."""
    pairs = ordered_pairs(file_tags, p.max_tags)
    if p.semantic_gain and similarity is not None:
        pairs = pairs.withColumns(
            {"tag_a": F.least("tag_l", "tag_r"), "tag_b": F.greatest("tag_l", "tag_r")}
        ).join(similarity.select("tag_a", "tag_b", "similarity"), ["tag_a", "tag_b"], "left")
        sem = semantic_gain(F.col("similarity"), p)
    else:
        sem = F.lit(1.0)

    reverse = F.lit(_reverse(p))
    if p.reverse_anchor_boost and anchor is not None:
        pairs = pairs.join(
            anchor.select(F.col("tag_id").alias("tag_l"), F.col("anchor_gain").alias("anchor_l")), "tag_l", "left"
        )
        boost = F.least(F.coalesce(F.col("anchor_l"), F.lit(1.0)), F.lit(p.anchor_cap))
        reverse = clamp(reverse * boost, p.reverse_low, p.reverse_high)
    forward, backward = _pair_weights(F.col("n"), F.col("pos_l"), F.col("pos_r"), p, sem, reverse)
    # Both directions of a pair of tags are summed in one row.
    up = F.col("tag_l") < F.col("tag_r")
    sums = (
        pairs.select(
            F.least("tag_l", "tag_r").alias("tag_a"), F.greatest("tag_l", "tag_r").alias("tag_b"),
            F.when(up, forward).otherwise(backward).alias("ab"), F.when(up, backward).otherwise(forward).alias("ba"),
        )
        .groupBy("tag_a", "tag_b")
        .agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    )
    both = F.array(
        F.struct(F.col("tag_a").alias("src"), F.col("tag_b").alias("dst"), F.col("ab").alias("weight")),
        F.struct(F.col("tag_b").alias("src"), F.col("tag_a").alias("dst"), F.col("ba").alias("weight")),
    )
    return sums.select(F.explode(both).alias("e")).select("e.*").filter(F.col("weight") > 0)


def edge_provenance(file_tags: DataFrame, p: GraphParams = GraphParams(), only: DataFrame | None = None) -> DataFrame:
    """(src, dst, file_id, mass): how much of each edge one note contributes.

    `only` (src, dst) restricts the work to some edges before anything is shuffled for the sums.
    """
    pairs = ordered_pairs(file_tags, p.max_tags)
    if only is not None:
        wanted = only.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).distinct()
        pairs = pairs.withColumns({"_a": F.least("tag_l", "tag_r"), "_b": F.greatest("tag_l", "tag_r")}).join(wanted, ["_a", "_b"], "left_semi").drop("_a", "_b")
    step = F.greatest(F.col("pos_r") - F.col("pos_l"), F.lit(1)) - 1
    fade = F.exp(-p.provenance_decay * step)
    directed = pairs.select(
        "file_id",
        "repeats",
        F.explode(
            F.array(
                F.struct(F.col("tag_l").alias("src"), F.col("tag_r").alias("dst"), (p.provenance_forward * fade).alias("m")),
                F.struct(F.col("tag_r").alias("src"), F.col("tag_l").alias("dst"), (p.provenance_reverse * fade).alias("m")),
            )
        ).alias("e"),
    ).select(F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), "file_id", F.col("e.m").alias("mass"), "repeats")
    # A file of distinct tags holds a pair once, so only files with repeated tags have anything to sum.
    once = directed.filter(~F.col("repeats")).drop("repeats")
    return once.unionByName(directed.filter("repeats").groupBy("src", "dst", "file_id").agg(F.sum("mass").alias("mass")))


def _conductance(wormhole: Column, ev: Column, p: GraphParams) -> Column:
    return F.when(wormhole, ev * p.wormhole_gain).otherwise(ev)


def _damping(inflow: Column, median: Column, p: GraphParams) -> Column:
    level = median + F.greatest(p.smooth_share * median, F.lit(1e-9))
    return clamp(F.pow(F.greatest(inflow / level, F.lit(1e-9)), -p.hub_exponent), p.hub_low, p.hub_high)


def _shares(damped: DataFrame, p: GraphParams) -> DataFrame:
    """(src, dst, weight, wormhole) of damped conductances `v`. One shuffle by source serves the sums and the shares."""
    own = Window.partitionBy("src")
    damped = damped.withColumns({"total": F.sum("v").over(own), "worm_total": F.sum(F.when(F.col("wormhole"), F.col("v"))).over(own)})
    reserve = F.when(F.col("worm_total") > 0, F.lit(p.wormhole_reserve)).otherwise(0.0)
    share = (p.row_mass - reserve) * F.col("v") / F.col("total")
    extra = F.when(F.col("wormhole"), reserve * F.col("v") / F.col("worm_total")).otherwise(0.0)
    return damped.select("src", "dst", (share + extra).alias("weight"), "wormhole")


def transport_edges(fact: DataFrame, p: GraphParams = GraphParams(), anchor: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight, wormhole): row-normalised conductances with hub damping."""
    ev = F.log1p(F.col("weight") * p.compression)
    fact = fact.repartition("dst")
    if anchor is None:
        rows = fact.withColumn("ev", ev).withColumn("wormhole", F.col("ev") >= p.tension)
    else:
        gain = anchor.select(F.col("tag_id").alias("dst"), "anchor_gain")
        rows = (
            fact.withColumn("ev", ev)
            .join(gain, "dst", "left")
            .withColumn("wormhole", F.col("ev") * F.coalesce(F.col("anchor_gain"), F.lit(1.0)) >= p.tension)
        )
    rows = rows.select("src", "dst", "wormhole", _conductance(F.col("wormhole"), F.col("ev"), p).alias("cond"))
    # One shuffle by target serves the inflow, its median and the damping; both are written once.
    rows = cut_lineage(rows.withColumn("inflow", F.sum("cond").over(Window.partitionBy("dst"))), "rated")
    inflow = cut_lineage(rows.filter(F.col("inflow") > 0).groupBy("dst").agg(F.max("inflow").alias("inflow")), "inflow")
    median = F.coalesce(upper_median(inflow, "inflow").scalar(), F.lit(1.0))
    pen = _damping(F.col("inflow"), F.col("median"), p)
    return _shares(rows.withColumn("median", median).select("src", "dst", "wormhole", (F.col("cond") * pen).alias("v")), p)


def _rated(own: DataFrame, p: GraphParams, outgoing: bool) -> DataFrame:
    """(tag, other, wormhole, cond): the edges from or to the tags of `own` (tags, positions, _i, tag), summed over files."""
    met = own.withColumn("n", F.size("tags")).select("*", F.posexplode("tags").alias("_j", "other")).filter(F.col("tag") != F.col("other"))
    here, there, first = _place(own, "_i"), _place(own, "_j"), F.col("_i") < F.col("_j")
    met = met.select("tag", "other", "n", first.alias("first"), F.when(first, here).otherwise(there).alias("pos_l"), F.when(first, there).otherwise(here).alias("pos_r"))
    forward, backward = _pair_weights(F.col("n"), F.col("pos_l"), F.col("pos_r"), p, F.lit(1.0), F.lit(_reverse(p)))
    leads = F.col("first") if outgoing else ~F.col("first")
    sums = met.groupBy("tag", "other").agg(F.sum(F.when(leads, forward).otherwise(backward)).alias("weight")).filter("weight > 0")
    rated = sums.withColumn("ev", F.log1p(F.col("weight") * p.compression)).withColumn("wormhole", F.col("ev") >= p.tension)
    return rated.select("tag", "other", "wormhole", _conductance(F.col("wormhole"), F.col("ev"), p).alias("cond"))


def _own(lists: DataFrame) -> DataFrame:
    return lists.drop("file_id").select("*", F.posexplode("tags").alias("_i", "tag")).filter("tag IS NOT NULL")


def _hot_tags(lists: DataFrame) -> tuple[int, DataFrame | None]:
    """Number of pairs, and the tags (tag) in more than HOT_PAIRS of them. Tags are counted only where a bucket holds as many."""
    beside = lists.select(F.explode("tags").alias("tag"), (F.size("tags") - 1).cast("bigint").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("tag"), F.lit(HOT_BUCKETS)))
    buckets = beside.groupBy("bucket").agg(F.sum("n").alias("pairs"))
    total = buckets.agg(F.sum("pairs").alias("pairs"), F.max("pairs").alias("most")).first()
    if (total["most"] or 0) <= HOT_PAIRS:
        return total["pairs"] or 0, None
    full = beside.join(F.broadcast(buckets.filter(F.col("pairs") > HOT_PAIRS)), "bucket", "left_semi")
    return total["pairs"], cut_lineage(full.groupBy("tag").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT_PAIRS).select("tag"), "hot-tags")


def _order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices that put rows with equal a next to each other, and among them those with equal b."""
    held, place = np.unique(a, return_inverse=True)
    low, span = int(b.min()), int(b.max()) - int(b.min()) + 1
    return np.argsort(place * span + (b - low)) if len(held) * span < 2**62 else np.lexsort((b, place))


def _summed(held: pa.Table, p: GraphParams, outgoing: bool, carried: str | None = None) -> tuple[np.ndarray, ...]:
    """(tag, other, weight) of the edges from or to the tags of `held` (tags, positions, _i, tag), summed over files and in order
    of tag and other; `carried` adds the entry of that list at the place of the other tag."""
    lists = held["tags"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    at = np.arange(len(lists.flatten())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = np.repeat(held["_i"].to_numpy(), sizes)
    tag, known = np.repeat(held["tag"].to_numpy(), sizes), lists.flatten().is_valid().to_numpy(zero_copy_only=False)
    other = lists.flatten().fill_null(0).to_numpy()
    met = known & (tag != other)
    if "positions" in held.column_names:
        place = held["positions"].combine_chunks().flatten().to_numpy()
        here, there = place[np.repeat(np.cumsum(sizes) - sizes, sizes) + own], place
    else:
        here, there = own + 1, at + 1
    first = own < at
    n, left, right = np.repeat(sizes, sizes), np.where(first, here, there), np.where(first, there, here)
    forward, backward = _pair_weights(n[met], left[met], right[met], p, 1.0, _reverse(p), _Arrays)
    tag, other, w = tag[met], other[met], np.where(first[met] == outgoing, forward, backward)
    extra = () if carried is None else (held[carried].combine_chunks().flatten().to_numpy(zero_copy_only=False)[met],)
    if not len(tag):
        return tag, other, w, *extra
    order = _order(tag, other)
    tag, other, w = tag[order], other[order], w[order]
    edge = np.flatnonzero(np.concatenate([[True], (tag[1:] != tag[:-1]) | (other[1:] != other[:-1])]))
    weight = np.add.reduceat(w, edge)
    edge, weight = edge[weight > 0], weight[weight > 0]
    return tag[edge], other[edge], weight, *(x[order][edge] for x in extra)


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))


def _inflow_of(p: GraphParams):
    """Adds up the lists (tags, positions, _i, tag) of a task's tags: edges first, then the conductances of each tag's edges."""

    def add(batches):
        held = pa.Table.from_batches(batches).combine_chunks() if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        tag, _, weight = _summed(held, p, False)
        if len(tag):
            ev = np.log1p(weight * p.compression)
            top = _runs(tag)
            flow = np.add.reduceat(np.where(ev >= p.tension, ev * p.wormhole_gain, ev), top)
            yield pa.RecordBatch.from_arrays([pa.array(tag[top]), pa.array(flow)], ["tag", "inflow"])

    return add


def inflows(lists: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(tag_id, inflow): conductance of all edges to a tag, straight from the `tag_lists`.

    A tag gets its lists by one shuffle, a row a file, and adds up its edges and their conductances where the lists arrive;
    edges themselves are never shuffled. Only tags of very many pairs are summed pair by pair.
    """
    own = _own(lists)
    pairs, hot = _hot_tags(lists)
    cold = (own if hot is None else own.join(F.broadcast(hot), "tag", "left_anti")).repartition(max(1, math.ceil(pairs / TASK_PAIRS)), "tag")
    schema = T.StructType([T.StructField("tag", lists.schema["tags"].dataType.elementType), T.StructField("inflow", T.DoubleType())])
    found = cold.mapInArrow(_inflow_of(p), schema)
    if hot is not None:
        found = found.unionByName(_rated(own.join(F.broadcast(hot), "tag", "left_semi"), p, False).groupBy("tag").agg(F.sum("cond").alias("inflow")))
    return found.select(F.col("tag").alias("tag_id"), "inflow")


def damped_tags(inflow: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(tag_id, damping): the factor of all edges to a tag."""
    median = F.coalesce(upper_median(inflow.filter("inflow > 0"), "inflow").scalar(), F.lit(1.0))
    return inflow.withColumn("median", median).select("tag_id", _damping(F.col("inflow"), F.col("median"), p).alias("damping"))


@dataclass(frozen=True)
class ListedGraph:
    """The transport graph of plain facts (neither semantic gain nor anchors) as its `tag_lists` and
    `damping` (tag_id, damping). Out-edges are derived for the tags that are asked for."""

    lists: DataFrame
    damping: DataFrame
    params: GraphParams = GraphParams()

    def out_edges(self, tags: DataFrame) -> DataFrame:
        """The rows of `transport_edges` whose source is one of `tags` (tag)."""
        asked = broadcast_if_fits(tags.select(F.col("tag")).distinct(), ASKED_TAGS)
        edges = _rated(_own(self.lists).join(asked, "tag", "left_semi"), self.params, True)
        to = self.damping.select(F.col("tag_id").alias("other"), "damping")
        damped = edges.join(to, "other").select(F.col("tag").alias("src"), F.col("other").alias("dst"), "wormhole", (F.col("cond") * F.col("damping")).alias("v"))
        return _shares(damped, self.params)


def inbound_mass(transport: DataFrame) -> DataFrame:
    return transport.groupBy(F.col("dst").alias("tag_id")).agg(F.sum("weight").alias("inbound"))


def hub_specificity(inbound: DataFrame, floor: float = 0.35) -> DataFrame:
    """(tag_id, inbound, specificity): 1 for quiet tags, down to the floor for the largest hub."""
    top = inbound.agg(F.max("inbound").alias("m")).scalar()
    ratio = F.when(F.col("top") > 0, F.col("inbound") / F.col("top")).otherwise(0.0)
    return inbound.withColumn("top", top).select(
        "tag_id", "inbound", F.greatest(F.lit(floor), 1 - F.sqrt(clamp01(ratio))).alias("specificity")
    )


def independent_fraction(provenance: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """(src, dst, file_id, independent): share of the edge that survives without that note."""
    return provenance.withColumn("total", F.sum("mass").over(Window.partitionBy("src", "dst"))).select(
        "src",
        "dst",
        "file_id",
        F.when(
            F.col("total") > 0,
            F.greatest(clamp01(1 - F.col("mass") / F.col("total")), F.lit(p.independent_floor)),
        )
        .otherwise(1.0)
        .alias("independent"),
    )


def cooccurring_pairs(file_tags: DataFrame, max_tags: int = 100) -> DataFrame:
    return (
        ordered_pairs(file_tags, max_tags)
        .select(F.least("tag_l", "tag_r").alias("tag_a"), F.greatest("tag_l", "tag_r").alias("tag_b"))
        .distinct()
    )


def strongest_out_edges(transport: DataFrame, k: int = 20) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return transport.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def graph_summary(edges: DataFrame, file_tags: DataFrame) -> DataFrame:
    """Single row: node, edge and tag-reuse counts."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    reuse = file_tags.groupBy("tag_id").agg(F.count_distinct("file_id").alias("files"))
    return (
        reuse.agg(
            F.count(F.lit(1)).alias("tags"),
            F.count_if(F.col("files") == 1).alias("single_use"),
            F.count_if(F.col("files") > 1).alias("reused"),
            F.max("files").alias("max_files"),
        )
        .withColumn("nodes", nodes.agg(F.count(F.lit(1)).alias("n")).scalar())
        .withColumn("edges", edges.agg(F.count(F.lit(1)).alias("n")).scalar())
    )


def order_free_digest(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Row count and digest of a table, independent of row order and partitioning.

    Every row is hashed to 60 bits; hashes are summed exactly, so partial sums combine before the shuffle.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    keys = keys or []
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(bits).alias("acc")).select(
        *keys, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), F.col("acc").cast("string")), 256).alias("digest")
    )
