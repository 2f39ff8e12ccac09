"""One maintenance round over the tables; a scheduler outside decides when it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import graph as G
from tagloom.params import GraphParams
from tagloom.sinks.artifacts import graph_signature, newest_generations, publish_graph
from tagloom.sinks.notes import write_report


def guardian_round(spark: SparkSession, root: str, tables: dict[str, DataFrame], reports: dict[str, DataFrame], generations: DataFrame | None = None, p: GraphParams = GraphParams()) -> dict:
    """Refresh the graph if the tag edges changed, list generations to keep, write reports, flag buckets that lost notes."""
    edges = tables["file_tags"]
    signature = graph_signature(edges, repr(p))
    fact = G.fact_edges(edges, p)
    transport = G.transport_edges(fact, p)
    rebuilt = publish_graph(
        spark, root, signature,
        {"fact": fact, "edges": transport, "nodes": G.hub_specificity(G.inbound_mass(transport)), "provenance": G.edge_provenance(edges, p)},
    )
    for name, df in reports.items():
        write_report(df, f"{root}/reports/{name}")
    snapshot = tables["files"].groupBy("bucket").agg(F.count(F.lit(1)).alias("files"))
    lost = None
    if "last_snapshot" in tables:
        lost = tables["last_snapshot"].withColumnRenamed("files", "before").join(snapshot, "bucket", "left").filter(F.coalesce("files", F.lit(0)) < F.col("before"))
    keep = newest_generations(generations) if generations is not None else None
    return {"signature": signature, "rebuilt": rebuilt, "snapshot": snapshot, "lost": lost, "keep": keep}
