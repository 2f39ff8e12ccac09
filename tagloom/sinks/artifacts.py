"""Graph artifacts stored by content signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.graph import order_free_digest
from tagloom.operators.running import top_n


def newest_generations(generations: DataFrame, keep: int = 3) -> DataFrame:
    """Newest `keep` generations of each schema version."""
    return top_n(generations, ["schema_version"], [F.desc("updated_at"), F.asc("artifact")], keep)


def graph_signature(file_tags: DataFrame, config: str) -> str:
    """Signature of the tag edges and the parameters a graph is built from."""
    row = order_free_digest(file_tags, ["file_id", "tag_id", "position"]).select(
        F.sha2(F.concat_ws("|", F.lit(config), "digest"), 256).alias("sig")
    ).first()
    return row["sig"]


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def publish_graph(spark: SparkSession, root: str, signature: str, tables: dict[str, DataFrame]) -> bool:
    """Write the tables of one generation under graph_sig=...; a finished generation is left alone.

    Returns whether anything was written. The marker table goes last, so a lost job never looks finished.
    """
    done = f"{root}/published/graph_sig={signature}"
    if _exists(spark, f"{done}/_SUCCESS"):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/graph_sig={signature}")
    spark.range(1).select(F.current_timestamp().alias("published_at")).write.mode("overwrite").parquet(done)
    return True
