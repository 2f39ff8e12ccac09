"""Connected components by shrinking labels, with every hot key on a side that can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import cut_lineage


def component_labels(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); the component is its smallest node.

    A round gives each node the smallest label around it, hands that label on to the node its old label names, and
    follows labels one step. Joins put the unique labels on one side and the edges on the other; minima combine before
    the shuffle."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both.filter("a <> b"), "edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        met = labels.join(heard, "node").withColumn("low", F.least("component", "heard"))
        offers = met.select("node", "low").unionByName(met.select(F.col("component").alias("node"), "low"))
        offers = cut_lineage(offers.groupBy("node").agg(F.min("low").alias("low")), "labels")
        jumped = offers.join(offers.select(F.col("node").alias("low"), F.col("low").alias("next")), "low")
        fresh = cut_lineage(
            jumped.join(labels, "node").select("node", F.least("low", "next").alias("component"), F.col("component").alias("before")), "labels"
        )
        changed = fresh.filter("component <> before").limit(1).count()
        labels = fresh.drop("before")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
