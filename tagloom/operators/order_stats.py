"""Exact order statistics without sorting a whole group in one task.

An approximate sketch first brackets every wanted rank; only the distinct values inside the bracket are
then ranked, with their multiplicities, so a group holding a third of all rows ranks a sliver of itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKETCH_ACCURACY = 10_000
MARGIN = 0.01
SMALL = 1000


@dataclass(frozen=True)
class Rank:
    """A wanted element: 0-based `index` as a column over `n`, lying near the fraction `near`."""

    name: str
    near: float
    index: Column


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: list[Rank]) -> DataFrame:
    """One row per group: keys, n and the exact element at each wanted rank (null values are ignored)."""
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    aggs = [F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    for i, rank in enumerate(ranks):
        low, high = max(0.0, rank.near - MARGIN), min(1.0, rank.near + MARGIN)
        aggs.append(F.percentile_approx("_v", [low, high], SKETCH_ACCURACY).alias(f"_b{i}"))
    # in a small group one position is a large fraction, so its bracket is the whole group
    small = F.col("n") <= SMALL
    bounds = data.groupBy(*keys).agg(*aggs)
    picks = F.array(
        *[
            F.struct(
                F.lit(i).alias("which"),
                F.when(small, F.col("_min")).otherwise(F.col(f"_b{i}")[0]).alias("low"),
                F.when(small, F.col("_max")).otherwise(F.col(f"_b{i}")[1]).alias("high"),
                rank.index.cast("bigint").alias("at"),
            )
            for i, rank in enumerate(ranks)
        ]
    )
    wanted = bounds.select(*keys, "n", F.explode(picks).alias("w")).select(*keys, "n", "w.*")
    # one row per distinct value and group from here on
    counts = data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    joined = counts.join(wanted, keys) if keys else counts.join(F.broadcast(wanted), F.lit(True))
    below = joined.groupBy(*keys, "n", "which", "low", "high", "at").agg(
        F.coalesce(F.sum(F.when(F.col("_v") < F.col("low"), F.col("_c"))), F.lit(0)).alias("below")
    )
    inside = joined.filter(F.col("_v").between(F.col("low"), F.col("high"))).select(*keys, "which", "_v", "_c")
    running = Window.partitionBy(*keys, "which").orderBy("_v")
    placed = (
        inside.join(below.select(*keys, "which", "at", "below", "n"), [*keys, "which"])
        .withColumn("_end", F.col("below") + F.sum("_c").over(running))
        .filter((F.col("at") < F.col("_end")) & (F.col("at") >= F.col("_end") - F.col("_c")))
    )
    return placed.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("which") == i, F.col("_v"))).alias(rank.name) for i, rank in enumerate(ranks)],
    )


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """Single row `median`: element n div 2 of the ascending list, not interpolated."""
    return order_statistics(df, [], value, [Rank("median", 0.5, F.floor(F.col("n") / 2))]).select("median")
