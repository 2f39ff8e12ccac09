import pytest
from pyspark.sql import functions as F

from tagloom.session import new_stage_path
from tagloom.sinks import generations as G


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tables(spark, files):
    f = spark.createDataFrame(files, "file_id bigint, bucket string")
    return {"files": f, "tags": f.select("bucket", (F.col("file_id") * 10).alias("tag_id"))}


def test_buckets_are_replaced_emptied_and_kept(spark):
    root = new_stage_path(spark, "generations")
    with pytest.raises(KeyError):
        G.current(spark, root, "files")
    first = [(1, "a"), (2, "b=1/x"), (3, "b=1/x"), (4, "7"), (5, None)]
    assert G.commit(spark, root, tables(spark, first)) == 1
    assert rows(G.current(spark, root, "files")) == sorted(first, key=str)
    # a loses its only note, null is rewritten, 7 is given but not touched, c is new.
    second = [(6, None), (7, "c"), (8, "7")]
    touched = spark.createDataFrame([("a",), (None,), ("c",)], "bucket string")
    assert G.commit(spark, root, tables(spark, second), touched) == 2
    now = sorted([(2, "b=1/x"), (3, "b=1/x"), (4, "7"), (6, None), (7, "c")], key=str)
    assert rows(G.current(spark, root, "files")) == now
    assert rows(G.current(spark, root, "tags").select(F.col("tag_id") / 10, "bucket")) == sorted([(float(f), b) for f, b in now], key=str)
    assert rows(G.current(spark, root, "files", 1)) == sorted(first, key=str)
    # Of the first generation a and null are no longer held, in two tables.
    assert G.prune(spark, root, keep=1) == 4 and G.prune(spark, root, keep=1) == 0
    assert rows(G.current(spark, root, "files")) == now and G.newest(spark, root) == 2


def test_a_lost_commit_leaves_the_old_generation(spark):
    root = new_stage_path(spark, "generations")
    G.commit(spark, root, tables(spark, [(1, "a"), (2, "b")]))
    broken = tables(spark, [(3, "a"), (4, "b")])
    broken["tags"] = broken["tags"].withColumn("tag_id", F.when(F.col("tag_id") > 0, F.raise_error("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        G.commit(spark, root, broken)
    assert G.newest(spark, root) == 1
    assert rows(G.current(spark, root, "files")) == [(1, "a"), (2, "b")] and rows(G.current(spark, root, "tags")) == [("a", 10), ("b", 20)]
    only = spark.createDataFrame([("b",)], "bucket string")
    assert G.commit(spark, root, tables(spark, [(5, "b")]), only) == 2
    assert rows(G.current(spark, root, "files")) == [(1, "a"), (5, "b")]
    # One table alone: the other stays.
    G.commit(spark, root, {"tags": spark.createDataFrame([("a", 99)], "bucket string, tag_id bigint")})
    assert rows(G.current(spark, root, "tags")) == [("a", 99)] and rows(G.current(spark, root, "files")) == [(1, "a"), (5, "b")]
