"""A walk in blocks of packed edges equals the walk over the transport table."""

import numpy as np
import pytest

from tagloom import session
from tagloom.operators import graph as G
from tagloom.operators import walks as K
from tagloom.plans.fields import dual_fields
from tagloom.plans.rank_topology import anchor_direct

COLUMNS = "file_id bigint, tag_id bigint, position int"


def files(n=60, tags=15):
    rng = np.random.default_rng(8)
    return [(f, int(t), i + 1) for f in range(n) for i, t in enumerate(rng.permutation(tags)[: rng.integers(1, 7)])]


@pytest.mark.parametrize("hot, shared, piece, numbered", [(2_000_000, 1 << 27, 32_768, True), (25, 1 << 27, 3, False), (2_000_000, 0, 4, False), (25, 0, 32_768, True)])
def test_walk_in_blocks(spark, monkeypatch, hot, shared, piece, numbered):
    monkeypatch.setattr(G, "HOT_PAIRS", hot)
    monkeypatch.setattr(K, "BLOCK_TAGS", 4)
    monkeypatch.setattr(K, "SHARED_BYTES", shared)
    monkeypatch.setattr(K, "PIECE", piece)
    rows = files() if numbered else files() + [(200, 3, 1), (200, 4, 2), (200, 3, 3), (201, 5, 0), (201, 6, 0), (202, None, 1), (202, 7, 2), (202, 8, 3)]
    df = spark.createDataFrame(rows, COLUMNS)
    lists = session.cut_lineage(G.tag_lists(df, numbered=numbered), "lists")
    listed = G.ListedGraph(lists, session.cut_lineage(G.damped_tags(G.inflows(lists)), "damping"))
    places = session.cut_lineage(K.tag_places(listed), "places")
    blocked = K.BlockedGraph(places, session.cut_lineage(K.edge_cells(listed, places), "cells"))
    table = session.cut_lineage(G.transport_edges(G.fact_edges(df)), "transport")
    # 999 has no edges; twenty queries fill more than one panel.
    source = spark.createDataFrame([(q, t, 0.25 + q) for q in range(20) for t in (q % 15, (3 * q + 1) % 15, 999)], "query_id bigint, tag_id bigint, source_mass double")
    want, got = ({(r["query_id"], r["tag_id"]): (r["local"], r["transfer"]) for r in dual_fields(source, g, steps=6).collect()} for g in (table, blocked))
    assert set(got) == set(want) and len(want) > 100
    for k, v in got.items():
        assert v == pytest.approx(want[k], rel=1e-12, abs=1e-15)
    inbound = {r["tag_id"]: r["inbound"] for r in G.inbound_mass(table).collect()}
    assert {r["tag_id"]: r["inbound"] for r in blocked.inbound().collect()} == pytest.approx(inbound)


@pytest.mark.parametrize("batch", ["1", "10000"])
def test_most_hits_of_notes_in_pieces(spark, batch):
    rng = np.random.default_rng(3)
    edges = [(f, int(t)) for f in range(80) for t in rng.permutation(12)[: rng.integers(1, 6)]]
    domain = {(q, int(t)) for q in range(18) for t in rng.permutation(12)[:5]}
    fields = spark.createDataFrame([(q, t, (q, t) in domain) for q in range(18) for t in range(12)], "query_id bigint, tag_id bigint, in_local boolean")
    chunks = spark.createDataFrame([(1000 - f, f) for f in range(80)] + [(5000 + f, f) for f in range(0, 80, 3)], "chunk_id bigint, file_id bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in anchor_direct(fields, spark.createDataFrame(edges, "file_id bigint, tag_id bigint"), chunks).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for q in range(18):
        hits = {f: sum((q, t) in domain for g, t in edges if g == f) for f in range(80)}
        rows = sorted((-hits[f], c) for c, f in [(1000 - f, f) for f in range(80)] + [(5000 + f, f) for f in range(0, 80, 3)] if hits[f])[:50]
        want |= {(q, i + 1): (c, h / rows[0][0]) for i, (h, c) in enumerate(rows)}
    assert got == want


def test_shuffle_files_go_when_a_table_is_written(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda self, path, **_: seen.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")))
    session.write_once(spark.range(3), "nowhere")
    assert seen == ["true"] and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
