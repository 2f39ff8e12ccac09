"""Anchor gain of a tag: how much of its vector its strongest neighbours cannot explain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.graph import strongest_out_edges
from tagloom.session import BROADCAST_BYTES


def unexplained(own: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Share of each own vector's square outside the span of its near vectors; near (tag, rank, dim), rows of zeros span nothing."""
    units, rest = [], own.copy()
    for i in range(near.shape[1]):
        v = near[:, i].copy()
        for u in units:
            v -= np.einsum("ij,ij->i", v, u)[:, None] * u
        norm = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        u = np.where(norm > 1e-12, v / np.where(norm > 1e-12, norm, 1.0), 0.0)
        rest -= np.einsum("ij,ij->i", own, u)[:, None] * u
        units.append(u)
    total = np.einsum("ij,ij->i", own, own)
    return np.where(total > 0, np.einsum("ij,ij->i", rest, rest) / np.where(total > 0, total, 1.0), 0.0)


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag_id, residual_ratio) from rows (tag_id, rank, vector) in order; rank 0 is the tag itself, 1.0 without others. A batch keeps its last tag for the next one."""
    schema = pa.schema([("tag_id", pa.int64()), ("residual_ratio", pa.float64())])

    def solve(ids, ranks, m):
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
        place = np.zeros((len(starts), int(ranks.max()) + 1, m.shape[1]))
        place[group, ranks] = m
        known = ranks[starts] == 0
        alone = np.diff(np.r_[starts, len(ids)]) == 1
        found = np.where(alone[known], 1.0, unexplained(place[known, 0], place[known, 1:]))
        return pa.RecordBatch.from_arrays([pa.array(ids[starts][known]), pa.array(found)], schema=schema)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = (batch.column("tag_id").to_numpy(), batch.column("rank").to_numpy(), vectors.reshape(batch.num_rows, -1))
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield solve(*(x[:cut] for x in rows))
        held = tuple(x[cut:] for x in rows)
    if held is not None:
        yield solve(*held)


def anchor_gains(transport: DataFrame, tags: DataFrame, vectors: DataFrame, neighbours: int = 8) -> DataFrame:
    """(tag_id, residual_ratio, anchor_gain): squared remainder of a tag vector outside the span of its strongest
    out-neighbours, and 0.5 + 1.5 of it, within [0.5, 2]. Our own definition.

    Tags (tag_id, vec_id) name their vectors (vec_id, vector). Names are grouped by tag first; up to BROADCAST_BYTES of
    vectors are then shipped to them, more are joined to the names and shuffled with them.
    """
    named = tags.select(F.col("tag_id").cast("bigint").alias("tag_id"), "vec_id")
    near = strongest_out_edges(transport, neighbours).select(F.col("src").alias("tag_id"), F.col("dst").alias("near_id"), "rank")
    members = near.join(named.withColumnRenamed("tag_id", "near_id"), "near_id").select("tag_id", "rank", "vec_id")
    members = members.unionByName(named.withColumn("rank", F.lit(0)))
    known = vectors.filter(F.col("vector").isNotNull()).select("vec_id", "vector")
    size = known.agg(F.coalesce(F.sum(F.size("vector").cast("bigint") * 8), F.lit(0))).first()[0]
    met = members.repartition("tag_id").join(F.broadcast(known), "vec_id") if size <= BROADCAST_BYTES else members.join(known, "vec_id").repartition("tag_id")
    rows = met.select("tag_id", "rank", "vector").sortWithinPartitions("tag_id", "rank")
    full = rows.mapInArrow(_ratios, "tag_id bigint, residual_ratio double")
    return full.withColumn("anchor_gain", F.least(F.lit(2.0), F.greatest(F.lit(0.5), 0.5 + 1.5 * F.col("residual_ratio"))))
