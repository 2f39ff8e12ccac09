"""A table read as a stream may be one file or a folder of files."""

import pytest
from pyspark.sql import functions as F

from tagloom.catalog import QUERIES
from tagloom.streaming import windows as W

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 3])
def test_table_in_a_folder_of_files(spark, tmp_path, parts):
    stored = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    stored.repartition(parts, "conv_id", "turn").write.parquet(f"{tmp_path}/conversations.parquet")
    stored.limit(0).write.parquet(f"{tmp_path}/other.parquet")
    rows = lambda d: sorted(tuple(r) for r in QUERIES["stream_drafts"](spark, d).collect())
    assert rows(str(tmp_path)) == rows(FOLDER) != []


def test_table_in_one_file(spark):
    met, _ = W.drain(W.table_stream(spark, FOLDER, "events"), "events", "append")
    assert met.count() == spark.read.parquet(f"{FOLDER}/events.parquet").select(F.count(F.lit(1))).first()[0]
