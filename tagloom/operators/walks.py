"""Walks over the transport graph in blocks: a step multiplies dense blocks of masses with packed blocks of edges.

Tags have a place, a slot of a block. The edges from one block to one lane (every lanes-th block) are a cell, one row of packed
arrays. Cells are laid out by lane once; a step brings the blocks of masses to every lane, as a broadcast up to SHARED_BYTES and
by a join beyond it, adds up a lane where its cells are and never shuffles an edge. Steps are sums, so a block may arrive in
several rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.operators import graph as G
from tagloom.session import configured, cut_lineage, new_stage_path, write_once

# Bytes that a task adds up at a time.
LANE_BYTES = 48 * 1024 * 1024
# Bytes of masses that may be sent to every task, and of cells that a task may read.
SHARED_BYTES = 128 * 1024 * 1024
READ_BYTES = "1g"
# Edges of one row of packed arrays, and such rows that a reader holds at a time.
PIECE = 32_768
FEW_ROWS = {"spark_sql_parquet_columnarReaderBatchSize": "16", "spark_sql_inMemoryColumnarStorage_batchSize": "16"}
# Tags of a block at most, about.
BLOCK_TAGS = 16_384
WIDTH = 16
CELL = "i int, j int, src binary, dst binary, w binary"
BLOCK = "panel bigint, i int, y binary"


def tag_places(graph: G.ListedGraph) -> DataFrame:
    """(tag_id, block, slot, code, lanes): where each tag of the graph stands; code counts the slots of all blocks."""
    pairs = graph.lists.agg(F.sum(F.size("tags") * (F.size("tags") - 1))).first()[0] or 0
    tags = cut_lineage(graph.lists.select(F.explode("tags").alias("tag_id")).filter("tag_id IS NOT NULL").distinct(), "graph-tags")
    n = tags.count()
    blocks = max(1, math.ceil(n / BLOCK_TAGS), math.ceil(pairs / G.TASK_PAIRS))
    lanes = min(blocks, max(tags.sparkSession.sparkContext.defaultParallelism, math.ceil(n * WIDTH * 8 / LANE_BYTES)))
    slot = F.row_number().over(Window.partitionBy("block").orderBy("tag_id")) - 1
    placed = cut_lineage(tags.withColumn("block", F.pmod(F.xxhash64("tag_id"), F.lit(blocks)).cast("int")).withColumn("slot", slot), "graph-slots")
    span = (placed.agg(F.max("slot")).first()[0] or 0) + 1
    return placed.select("tag_id", "block", "slot", (F.col("block").cast("bigint") * span + F.col("slot")).alias("code"), F.lit(span).alias("span"), F.lit(blocks).alias("blocks"), F.lit(lanes).alias("lanes"))


def _sizes(places: DataFrame) -> tuple[int, int, int]:
    """Slots of a block, blocks, lanes."""
    row = places.select("span", "blocks", "lanes").first()
    return (row["span"], row["blocks"], row["lanes"]) if row else (1, 1, 1)


def _cells(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, span: int, lanes: int) -> list[tuple]:
    """Edges (codes) of one source block as cells, a row a lane."""
    block, slot = np.divmod(dst, span)
    lane, at = block % lanes, (block // lanes) * span + slot
    order = np.lexsort((src, at, lane))
    lane, at, weight = lane[order], at[order].astype(np.int32), weight[order]
    i, src = int(src[0] // span), (src[order] % span).astype(np.int32)
    ends = np.append(G._runs(lane), len(lane))
    cuts = ((a, min(a + PIECE, end)) for start, end in zip(ends[:-1], ends[1:]) for a in range(start, end, PIECE))
    return [(i, int(lane[a]), src[a:b].tobytes(), at[a:b].tobytes(), weight[a:b].tobytes()) for a, b in cuts]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def edge_cells(graph: G.ListedGraph, places: DataFrame) -> DataFrame:
    """The weights of `transport_edges` as cells. A source block gets its lists by one shuffle, a row a file and tag."""
    p, lists = graph.params, graph.lists
    span, _, lanes = _sizes(places)
    named = lists.select("file_id", F.posexplode("tags").alias("position", "tag"), *(["positions"] if "positions" in lists.columns else []))
    if "positions" in lists.columns:
        named = named.withColumn("place", F.col("positions")[F.col("position")]).drop("positions")
    known = places.select(F.col("tag_id").alias("tag"), F.col("code").alias("tag_id")).join(graph.damping.select(F.col("tag_id").alias("tag"), "damping"), "tag", "left")
    carried = {"dampings": "damping"} | ({"positions": "place"} if "positions" in lists.columns else {})
    coded = G.tag_lists(named.join(known, "tag", "left"), p.max_tags, numbered=True, carried=carried)
    own = G._own(cut_lineage(coded, "graph-lists"))
    _, hot = G._hot_tags(lists)
    if hot is not None:
        own = own.join(F.broadcast(hot.join(places, F.col("tag") == F.col("tag_id")).select(F.col("code").alias("tag"))), "tag", "left_anti")

    def packed(held: pa.Table) -> pa.Table:
        src, dst, weight, damping = G._summed(held.combine_chunks(), p, True, "dampings")
        kept = ~np.isnan(damping)
        src, dst, weight, damping = src[kept], dst[kept], weight[kept], damping[kept]
        if not len(src):
            return _table([], CELL)
        ev = np.log1p(weight * p.compression)
        worm = ev >= p.tension
        v = np.where(worm, ev * p.wormhole_gain, ev) * damping
        top = G._runs(src)
        runs = np.diff(np.append(top, len(src)))
        total, tunnel = np.add.reduceat(v, top), np.add.reduceat(np.where(worm, v, 0.0), top)
        reserve = np.where(tunnel > 0, p.wormhole_reserve, 0.0)
        share = np.repeat((p.row_mass - reserve) / total, runs) * v
        extra = np.repeat(reserve / np.where(tunnel > 0, tunnel, 1.0), runs) * np.where(worm, v, 0.0)
        return _table(_cells(src, dst, share + extra, span, lanes), CELL)

    found = own.withColumn("block", F.floor(F.col("tag") / span)).groupBy("block").applyInArrow(packed, CELL)
    if hot is not None:
        code = places.select("tag_id", "code")
        edges = graph.out_edges(hot).join(code.withColumnsRenamed({"tag_id": "src", "code": "s"}), "src").join(code.withColumnsRenamed({"tag_id": "dst", "code": "t"}), "dst")

        def one(held: pa.Table) -> pa.Table:
            return _table(_cells(*(held[c].combine_chunks().to_numpy() for c in ("s", "t", "weight")), span, lanes), CELL)

        found = found.unionByName(edges.select("s", "t", "weight", F.pmod(F.floor(F.col("t") / span), F.lit(lanes)).alias("j")).groupBy("s", "j").applyInArrow(one, CELL))
    return by_lane(found, lanes)


def by_lane(cells: DataFrame, lanes: int) -> DataFrame:
    return cells.repartitionById(lanes, "j").sortWithinPartitions("j", "i")


@dataclass(frozen=True)
class BlockedGraph:
    """The graph of a `ListedGraph` as its `tag_places` and `edge_cells`."""

    places: DataFrame
    cells: DataFrame

    def inbound(self) -> DataFrame:
        """(tag_id, inbound): mass that reaches each tag if every tag sends 1."""
        every = self.places.select(F.lit(0).cast("bigint").alias("panel"), F.col("tag_id").alias("node"), F.lit(1.0).alias("y0"))
        with Walk(self, 1) as walk:
            reached = walk.step(cut_lineage(walk.blocks(every), "walk-0"), new_stage_path(walk.spark, "walk-1"))
            return walk.spread(reached, {"inbound": F.lit(1.0)}).select("tag_id", "inbound")


class Walk:
    """Steps of `width` columns and `panels` panels at once."""

    def __init__(self, graph: BlockedGraph, width: int, panels: int = 1):
        self.graph, self.width = graph, width
        self.spark = graph.cells.sparkSession
        self.span, self.n_blocks, self.lanes = _sizes(graph.places)
        self.shared = panels * self.n_blocks * self.span * width * 8 <= SHARED_BYTES
        self.held, self.sent = graph.cells, None

    def __enter__(self) -> Walk:
        if not self.shared:
            laid = self.graph.cells.repartition(self.lanes, "j").sortWithinPartitions("j", "i")
            self.held = laid.persist(StorageLevel.DISK_ONLY)
        return self

    def __exit__(self, *_) -> None:
        if not self.shared:
            self.held.unpersist()

    def _share(self, y: DataFrame):
        """The blocks of masses by source block, on every executor."""
        sums = {}
        with configured(self.spark, **FEW_ROWS):
            rows = y.select("panel", "i", "y").toArrow().to_pylist()
        for r in rows:
            own, block = sums.setdefault(r["i"], {}), np.frombuffer(r["y"], dtype=np.float64).reshape(self.width, self.span)
            own[r["panel"]] = own[r["panel"]] + block if r["panel"] in own else block
        return self.spark.sparkContext.broadcast(sums)

    def blocks(self, panels: DataFrame) -> DataFrame:
        """Blocks of the masses (panel, node, y0..) of the graph's tags."""
        span, width = self.span, self.width
        cols = [f"y{k}" for k in range(width)]

        def dense(held: pa.Table) -> pa.Table:
            y = np.zeros((width, span))
            for k, c in enumerate(cols):
                y[k, held["slot"].to_numpy()] = held[c].to_numpy()
            return _table([(held["panel"][0].as_py(), held["block"][0].as_py(), y.tobytes())], BLOCK)

        placed = panels.join(self.graph.places.select(F.col("tag_id").alias("node"), "block", "slot"), "node")
        return placed.select("panel", "block", "slot", *cols).groupBy("panel", "block").applyInArrow(dense, BLOCK)

    def _step(self, y: DataFrame, shared=None) -> DataFrame:
        span, width, lanes, blocks = self.span, self.width, self.lanes, self.n_blocks

        def added(batches):
            lane, sums = None, {}

            def done():
                for panel, acc in sums.items():
                    for k, i in enumerate(range(lane, blocks, lanes)):
                        block = acc[:, k * span : (k + 1) * span]
                        if block.any():
                            yield _table([(panel, i, block.tobytes())], BLOCK).to_batches()[0]

            for batch in batches:
                for i, j, src, dst, w, *given in zip(*batch.columns):
                    if j.as_py() != lane:
                        yield from done()
                        lane, sums = j.as_py(), {}
                    if shared is None:
                        masses = {given[0].as_py(): np.frombuffer(given[1].as_buffer(), dtype=np.float64).reshape(width, span)}
                    elif not (masses := shared.value.get(i.as_py())):
                        continue
                    src, dst = (np.frombuffer(x.as_buffer(), dtype=np.int32).astype(np.intp) for x in (src, dst))
                    w = np.frombuffer(w.as_buffer(), dtype=np.float64)
                    low, high = dst[0], dst[-1] + 1
                    dst -= low
                    for panel, mass in masses.items():
                        if panel not in sums:
                            sums[panel] = np.zeros((width, math.ceil((blocks - lane) / lanes) * span))
                        for column, sent in zip(sums[panel], mass):
                            flow = sent.take(src)
                            flow *= w
                            column[low:high] += np.bincount(dst, flow, high - low)
            if lane is not None:
                yield from done()

        cells = self.held.select("i", "j", "src", "dst", "w")
        if shared is None:
            sent = y.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
            cells = cells.join(sent.hint("merge"), ["j", "i"]).select("i", "j", "src", "dst", "w", "panel", "y")
        return cells.mapInArrow(added, BLOCK)

    def step(self, y: DataFrame, path: str) -> DataFrame:
        """Blocks of the masses one step on, written to a folder."""
        if self.shared:
            shared = self._share(y)
            with configured(self.spark, spark_sql_files_maxPartitionBytes=READ_BYTES, **FEW_ROWS):
                write_once(self._step(y, shared), path)
            shared.destroy()
        else:
            # Cells keep their lanes in the join, a few rows of packed arrays are held at a time.
            with configured(self.spark, spark_sql_requireAllClusterKeysForCoPartition="false", **FEW_ROWS):
                write_once(self._step(y), path)
        return self.spark.read.schema(BLOCK).parquet(path)

    def spread(self, terms: DataFrame, factors: dict) -> DataFrame:
        """(panel, slot, tag_id, one column a factor): masses of blocks times each factor, summed; rows that hold any."""
        span, width, names = self.span, self.width, list(factors)
        per = terms.select("panel", "i", "y", *[f.cast("double").alias(n) for n, f in factors.items()])

        def summed(held: pa.Table) -> pa.Table:
            out = np.zeros((len(names), span * width))
            for k, y in enumerate(held["y"]):
                y = np.frombuffer(y.as_buffer(), dtype=np.float64)
                for at, n in enumerate(names):
                    out[at] += held[n][k].as_py() * y
            return _table([(held["panel"][0].as_py(), held["i"][0].as_py(), out.tobytes())], BLOCK)

        def rows(batches):
            for batch in batches:
                for panel, y, tags in zip(*(batch.column(k) for k in range(3))):
                    y = np.frombuffer(y.as_buffer(), dtype=np.float64).reshape(len(names), width, span)
                    tags = tags.values.to_numpy()
                    for lane in range(width):
                        mine = y[:, lane, : len(tags)]
                        at = np.flatnonzero((mine > 0).any(axis=0))
                        if len(at):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), panel.as_py())), pa.array(np.full(len(at), lane, dtype=np.int32)), pa.array(tags[at]), *(pa.array(m[at]) for m in mine)],
                                ["panel", "slot", "tag_id", *names],
                            )

        sums = per.groupBy("panel", "i").applyInArrow(summed, BLOCK)
        tags = self.graph.places.groupBy(F.col("block").alias("i")).agg(F.array_sort(F.collect_list(F.struct("slot", "tag_id")))["tag_id"].alias("tags"))
        kind = self.graph.places.schema["tag_id"].dataType.simpleString()
        return sums.join(tags, "i").select("panel", "y", "tags").mapInArrow(rows, f"panel bigint, slot int, tag_id {kind}, " + ", ".join(f"{n} double" for n in names))
