"""Several tables committed together, one generation at a time.

A commit writes the touched buckets of each table under its own generation and publishes a manifest last: one row per table
and bucket, naming the generation that holds it, in a single file, so it is there whole or not at all. Readers follow the
newest manifest; a job that is lost between two tables leaves the old generation readable, and its leftovers are overwritten
by the next commit. Untouched buckets keep their files. A bucket without rows leaves the manifest, so its old rows are gone.
Reads join the manifest with the partition columns, which prunes all other folders. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import broadcast_if_fits

MANIFEST = "table string, bucket string, held_by bigint, columns string, generation bigint"


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifests")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def newest(spark: SparkSession, root: str) -> int:
    """Number of the newest published generation, 0 if there is none."""
    return _manifests(spark, root).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], touched: DataFrame | None = None) -> int:
    """Publish tables (each with a string column `bucket`) and return the generation's number.

    `touched` (bucket) names the buckets to rewrite; without it all are. Of other buckets the given rows are ignored and the
    stored ones stay. Tables that are not given stay as they are."""
    last = newest(spark, root)
    generation = last + 1
    before = _manifests(spark, root).filter(F.col("generation") == last).drop("generation")
    only = None if touched is None else broadcast_if_fits(touched.select(F.col("bucket").alias("touched")).distinct())
    rows = before.filter(~F.col("table").isin(list(tables)))
    for name, df in tables.items():
        held = before.filter(F.col("table") == name)
        if only is not None:
            rows = rows.unionByName(held.join(only, F.col("bucket").eqNullSafe(F.col("touched")), "left_anti"))
            df = df.join(only, F.col("bucket").eqNullSafe(F.col("touched")), "left_semi")
        path = f"{root}/data/{name}/generation={generation}"
        df.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = spark.read.schema(df.schema).parquet(path).select(F.lit(name).alias("table"), "bucket").distinct()
        rows = rows.unionByName(written.withColumns({"held_by": F.lit(generation).cast("bigint"), "columns": F.lit(df.schema.json())}))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/generation={generation}")
    return generation


def current(spark: SparkSession, root: str, name: str, generation: int | None = None) -> DataFrame:
    """A table as of the newest generation, or of an older one that was not pruned."""
    wanted = newest(spark, root) if generation is None else generation
    manifest = _manifests(spark, root).filter((F.col("generation") == wanted) & (F.col("table") == name))
    head = manifest.first()
    if head is None:
        raise KeyError(f"{name} has no rows in generation {wanted}")
    schema = T.StructType.fromJson(json.loads(head["columns"]))
    stored = spark.read.schema(T.StructType(schema.fields + [T.StructField("generation", T.LongType())])).parquet(f"{root}/data/{name}")
    held = broadcast_if_fits(manifest.select(F.col("held_by"), F.col("bucket").alias("held_bucket")))
    rows = stored.join(held, (F.col("generation") == F.col("held_by")) & F.col("bucket").eqNullSafe(F.col("held_bucket")), "left_semi")
    return rows.select(*schema.names)


def prune(spark: SparkSession, root: str, keep: int = 3) -> int:
    """Remove bucket folders that none of the newest `keep` generations holds, and older manifests; returns how many folders went."""
    manifests = _manifests(spark, root)
    last = newest(spark, root)
    kept = manifests.filter(F.col("generation") > last - keep).select("table", "held_by", "bucket").distinct()
    removed = 0
    for name in [r["table"] for r in manifests.select("table").distinct().collect()]:
        stored = spark.read.schema("bucket string, generation bigint").parquet(f"{root}/data/{name}").filter(F.col("generation") <= last)
        folders = stored.select("generation", "bucket", F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
        mine = kept.filter(F.col("table") == name).select("held_by", F.col("bucket").alias("held_bucket"))
        old = folders.join(mine, (F.col("generation") == F.col("held_by")) & F.col("bucket").eqNullSafe(F.col("held_bucket")), "left_anti")
        for row in old.select("folder").toLocalIterator():
            removed += _remove(spark, row["folder"])
    for row in manifests.filter(F.col("generation") <= last - keep).select("generation").distinct().collect():
        _remove(spark, f"{root}/manifests/generation={row['generation']}")
    return removed


def _remove(spark: SparkSession, path: str) -> bool:
    """Spark has no call that deletes files; its own file system client does."""
    where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(path)) if ":" in path.split("/")[0] else spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
