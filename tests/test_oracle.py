"""Registered queries against their SQL text on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["transport_edges", "hub_specificity", "knn_topk", "usage_view", "latency_distribution", "interval_match", "shared_tag_notes", "admission_gate", "dual_field", "tag_components"]


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
