"""Out-edges derived from lists of tags equal the transport table, which spikes need not build."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from tagloom import session
from tagloom.operators import graph as G
from tagloom.params import GraphParams, SpikeParams
from tagloom.plans import observe as O

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "file_id bigint, tag_id bigint, position int"


def files(n=60, tags=15):
    rng = np.random.default_rng(8)
    return [(f, int(t), i + 1) for f in range(n) for i, t in enumerate(rng.permutation(tags)[: rng.integers(1, 7)])]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_spikes_build_no_transport_table(spark, monkeypatch):
    monkeypatch.setattr(session, "_stages", {})
    assert entry.queries()["spike_nodes"](spark, FOLDER).count()
    assert "transport" not in {label for _, _, label in session._stages}


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_lists_hold_whole_files_in_order(spark, batch):
    rows = files() + [(100, t, 1) for t in range(101)] + [(101, t, 5) for t in range(100)] + [(102, 7, 2), (102, None, 1), (103, 3, 4), (103, 3, 6), (None, 1, 1), (None, 2, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, COLUMNS).repartition(3)
        got = {r["file_id"]: (r["tags"], r["positions"]) for r in G.tag_lists(df).collect()}
        plain = {r["file_id"]: r["tags"] for r in G.tag_lists(df, numbered=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for f, t, p in rows:
        want.setdefault(f, []).append((p, -1 if t is None else t))
    want = {f: sorted(x) for f, x in want.items() if 2 <= len(x) <= 100}
    assert got == {f: ([None if t < 0 else t for _, t in x], [p for p, _ in x]) for f, x in want.items()}
    assert plain == {f: tags for f, (tags, _) in got.items()}


@pytest.mark.parametrize("p", [GraphParams(), GraphParams(distance_decay=0.3, tension=0.6)])
@pytest.mark.parametrize("hot, task", [(2_000_000, 1_000_000), (25, 40)])
@pytest.mark.parametrize("numbered", [True, False])
def test_listed_graph_equals_transport(spark, monkeypatch, p, hot, task, numbered):
    monkeypatch.setattr(G, "HOT_PAIRS", hot)
    monkeypatch.setattr(G, "TASK_PAIRS", task)
    df = spark.createDataFrame(files() if numbered else files() + [(200, 3, 1), (200, 4, 2), (200, 3, 3), (201, 5, 0), (201, 6, 0)], COLUMNS)
    lists = session.cut_lineage(G.tag_lists(df, numbered=numbered), "lists")
    assert (G._hot_tags(lists)[1] is not None) == (hot == 25)
    listed = G.ListedGraph(lists, G.damped_tags(session.cut_lineage(G.inflows(lists, p), "inflow"), p), p)
    table = session.cut_lineage(G.transport_edges(G.fact_edges(df, p), p), "transport")
    want = {(r["src"], r["dst"]): (r["weight"], r["wormhole"]) for r in table.collect()}
    asked = [0, 3, 5, 14, 999]
    got = {(r["src"], r["dst"]): (r["weight"], r["wormhole"]) for r in listed.out_edges(spark.createDataFrame([(t,) for t in asked], "tag bigint")).collect()}
    assert set(got) == {e for e in want if e[0] in asked}
    for e, (weight, worm) in got.items():
        assert weight == pytest.approx(want[e][0]) and worm == want[e][1]
    if p == GraphParams():
        seeds = spark.createDataFrame([(1, 0, 1.0, True), (1, 3, 0.5, False), (2, 5, 0.7, False), (2, 999, 1.0, False)], "query_id bigint, tag_id bigint, energy double, is_core boolean")
        spike = SpikeParams(firing=1e-4, min_current=1e-5, neighbours=4, max_states=20)
        for x, y in zip(O.propagate(seeds, listed, spike), O.propagate(seeds, table, spike)):
            a, b = ({tuple(r[c] for c in ("query_id", *k)): r for r in z.collect()} for z in (x, y) for k in [["tag_id"] if "tag_id" in z.columns else ["src", "dst"]])
            assert set(a) == set(b) and a
            for k in a:
                assert all(v == (pytest.approx(b[k][c]) if isinstance(v, float) else b[k][c]) for c, v in a[k].asDict().items())


def test_graph_of_no_files(spark):
    lists = G.tag_lists(spark.createDataFrame([(1, 2, 1)], COLUMNS))
    assert G.inflows(lists).count() == 0
