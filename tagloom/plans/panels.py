"""Panels: a batch of queries laid out as columns, so that a join touches each shared row once per panel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagloom.session import cut_lineage

PANEL = 16


def assign_slots(query_ids: DataFrame) -> DataFrame:
    """(query_id, panel, slot): every query gets a column of some panel."""
    ids = query_ids.select("query_id").distinct()
    panels = max(1, math.ceil(ids.count() * 1.3 / PANEL))
    place = Window.partitionBy("panel").orderBy("query_id")
    slots = (
        ids.withColumn("panel", F.pmod(F.xxhash64("query_id"), F.lit(panels)))
        .withColumn("r", F.row_number().over(place) - 1)
        .select("query_id", (F.col("panel") + panels * F.floor(F.col("r") / PANEL)).cast("bigint").alias("panel"), (F.col("r") % PANEL).alias("slot"))
    )
    return cut_lineage(slots, "slots")


def to_panels(df: DataFrame, slots: DataFrame, key: str, value: str, prefix: str = "y") -> DataFrame:
    """(panel, key, y0..): values summed per query column."""
    cells = [F.coalesce(F.sum(F.when(F.col("slot") == i, F.col(value))), F.lit(0.0)).alias(f"{prefix}{i}") for i in range(PANEL)]
    return df.join(slots, "query_id").groupBy("panel", key).agg(*cells)


def from_panels(df: DataFrame, slots: DataFrame, key: str, out: str, prefix: str = "y") -> DataFrame:
    """(query_id, key, out) for the positive cells."""
    lanes = F.filter(
        F.array(*[F.struct(F.lit(i).alias("slot"), F.col(f"{prefix}{i}").alias(out)) for i in range(PANEL)]), lambda v: v[out] > 0
    )
    return df.select("panel", key, F.explode(lanes).alias("v")).select("panel", key, "v.*").join(slots, ["panel", "slot"]).select("query_id", key, out)
