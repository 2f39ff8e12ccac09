"""Exact nearest rows by Euclidean distance between two tables of vectors of any length.

Few queries are shipped to the corpus, behind a size check. Otherwise every corpus row belongs to the cell of its nearest
pivot. The sizes and radii of the cells bound how far a query's k-th nearest row can be, and a query visits only the cells that
can hold something as near (triangle inequality), so nothing is missed. Large cells and many queries are cut into blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.neighbours import BLOCK_ROWS, OUT, PIVOTS, _best, _columns, _few_queries, slices
from tagloom.operators.running import top_n
from tagloom.session import BROADCAST_ROWS, cut_lineage

# Squared distances are compared rounded; a cell this much beyond the bound may still hold a tie.
SLACK = 1e-6
# Queries whose visits are laid out together.
VISITS = 128


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _lifted(pdf: pd.DataFrame, ident: str) -> dict:
    """A side whose product with the other one is the negative squared distance."""
    m = _matrix(pdf["vector"])
    square, one = (m * m).sum(axis=1, keepdims=True), np.ones((len(m), 1))
    m = np.hstack([2 * m, one, -square] if ident == "query_id" else [m, -square, one])
    return {"id": pdf[ident].to_numpy(), "m": m, "g": None, "t": None}


def _to_pivots(column, pivots: np.ndarray) -> np.ndarray:
    m = _matrix(column)
    square = (m * m).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * m @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def cells_to_visit(away: np.ndarray, radius: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which cells (columns) may hold one of the k nearest rows of each query (rows), from distances to the pivots."""
    far = away + radius[None, :]
    order = np.argsort(far, axis=1)
    enough = np.cumsum(sizes[order], axis=1) >= k
    rank = np.where(enough.any(axis=1), enough.argmax(axis=1), len(sizes) - 1)
    bound = far[np.arange(len(far)), order[np.arange(len(far)), rank]]
    near = np.maximum(away - radius[None, :], 0.0)
    return near**2 <= (bound**2 + SLACK * (1 + bound**2))[:, None]


def nearest_by_distance(queries: DataFrame, corpus: DataFrame, k: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, item_id, score, rank): the k nearest corpus rows per query, score the negative squared distance to nine
    decimals, ties to the lower id. Null vectors are left out."""
    q, c = _columns(queries, "query_id", None, False), _columns(corpus, "item_id", None, False)
    few = _few_queries(q, broadcast_rows)
    if few is None:
        partial = _by_cells(q, c, k)
    else:
        shared = c.sparkSession.sparkContext.broadcast(_lifted(pd.DataFrame([r.asDict() for r in few]), "query_id"))

        def scan(batches):
            for pdf in batches:
                if len(pdf):
                    yield _best(shared.value, _lifted(pdf, "item_id"), k, None, False, False)

        partial = c.mapInPandas(scan, OUT)
    return top_n(partial, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def _by_cells(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    spark = c.sparkSession
    picked = c.orderBy(F.xxhash64("item_id")).limit(PIVOTS).select("vector").collect()
    if not picked:
        return spark.createDataFrame([], OUT)
    pivots = spark.sparkContext.broadcast(_matrix(r["vector"] for r in picked))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                away = _to_pivots(pdf["vector"], pivots.value)
                yield pdf.assign(cell=away.argmin(axis=1).astype("int32"), away=away.min(axis=1))

    celled = T.StructType([*c.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    items = cut_lineage(c.mapInPandas(assign, celled), "distance-cells")
    # At most PIVOTS rows.
    cells = {r["cell"]: r for r in items.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    known = np.array(sorted(cells))
    radius, sizes = (np.array([cells[i][name] for i in known.tolist()]) for name in ("radius", "n"))
    blocks = -(-sizes // BLOCK_ROWS)

    def visit(batches):
        for pdf in batches:
            # A query may visit every cell, so few are laid out at a time.
            for some in slices(pdf, VISITS):
                row, at = np.nonzero(cells_to_visit(_to_pivots(some["vector"], pivots.value)[:, known], radius, sizes, k))
                yield some.iloc[row].assign(cell=known[at].astype("int32"), blocks=blocks[at].astype("int32"))

    visiting = T.StructType([*q.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("blocks", T.IntegerType())])
    query_blocks = max(1, -(-q.count() // BLOCK_ROWS))
    left = q.mapInPandas(visit, visiting).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
    left = left.withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    counts = spark.createDataFrame(list(zip(known.tolist(), blocks.tolist())), "cell int, blocks int")
    right = items.drop("away").join(F.broadcast(counts), "cell").withColumn("cb", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int")).drop("blocks")
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))))
    none = pd.DataFrame({"query_id": [], "item_id": [], "score": []})

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best(_lifted(a, "query_id"), _lifted(b, "item_id"), k, None, False, False) if len(a) and len(b) else none

    keys = ["cell", "cb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, OUT)
