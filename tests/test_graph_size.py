"""Graph and field steps that shuffle no more than they need."""

import numpy as np
import pytest

from tagloom.operators import distances as D
from tagloom.operators import graph as G
from tagloom.params import FieldParams
from tagloom.plans import fields as FD


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def edges(spark, n=12):
    rng = np.random.default_rng(2)
    w = np.where(rng.random((n, n)) < 0.4, rng.random((n, n)), 0.0)
    w = 0.95 * w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
    return w, spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j] > 0], "src bigint, dst bigint, weight double")


def test_both_directions_of_a_pair_are_summed_in_one_row(spark):
    tags = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 20, 1), (2, 10, 2), (2, 30, 3)], "file_id bigint, tag_id bigint, position int")
    f = G.fact_edges(tags)
    text = plan(f)
    assert text.index("Generate explode(array(struct(src") < text.index("Aggregate [tag_a")
    got = {(r["src"], r["dst"]): r["weight"] for r in f.collect()}

    def forward(i, j, n):
        return (0.9 - 0.4 * (i - 1) / (n - 1)) * (0.9 - 0.4 * (j - 1) / (n - 1))

    assert got[10, 20] == pytest.approx(forward(1, 2, 2) + 0.42 * forward(1, 2, 3))
    assert got[20, 10] == pytest.approx(0.42 * forward(1, 2, 2) + forward(1, 2, 3))
    assert set(got) == {(10, 20), (20, 10), (20, 30), (30, 20), (10, 30), (30, 10)}


def test_transport_reads_its_inflow_once(spark):
    _, e = edges(spark)
    t = G.transport_edges(e.select("src", "dst", "weight"))
    text = plan(t)
    assert "Aggregate [dst" not in text and "Aggregate [src" not in text and "percentile_approx" in text
    sums = {}
    for r in t.collect():
        sums[r["src"]] = sums.get(r["src"], 0) + r["weight"]
    assert all(s == pytest.approx(0.95) or s == pytest.approx(0.9) for s in sums.values())


@pytest.mark.parametrize("part", [3, 4_000_000])
def test_fields_over_edge_lists(spark, monkeypatch, part):
    monkeypatch.setattr(FD, "PART_EDGES", part)
    w, e = edges(spark)
    source = spark.createDataFrame([(1, 0, 0.5), (1, 3, 0.5), (2, 5, 1.0)], "query_id bigint, tag_id bigint, source_mass double")
    steps, p = 6, FieldParams()
    got = {(r["query_id"], r["tag_id"]): (r["local"], r["transfer"]) for r in FD.dual_fields(source, e, p, steps).collect()}
    for q, start in ((1, {0: 0.5, 3: 0.5}), (2, {5: 1.0})):
        y = np.array([start.get(i, 0.0) for i in range(len(w))])
        sums = np.zeros((2, len(w)))
        for k in range(steps + 1):
            for row, a in enumerate((p.alpha_local, p.alpha_transfer)):
                sums[row] += y * ((1 - a) * a**k if k < steps else a**steps)
            y = y @ w
        for i in range(len(w)):
            assert got.get((q, i), (0, 0)) == pytest.approx(tuple(sums[:, i]))


def test_visits_are_laid_out_a_few_queries_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(D, "VISITS", 4)
    m = np.random.default_rng(6).normal(size=(40, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "item_id bigint, vector array<double>").coalesce(1)
    got = D.nearest_by_distance(rows.withColumnRenamed("item_id", "query_id"), rows, 2, broadcast_rows=0).collect()
    away = np.round(-((m[:, None] - m[None]) ** 2).sum(axis=2), 9)
    want = {(i, j) for i in range(len(m)) for j in sorted(range(len(m)), key=lambda j: (-away[i, j], j))[:2]}
    assert {(r["query_id"], r["item_id"]) for r in got} == want


def test_provenance_sums_only_files_with_repeated_tags(spark):
    rows = [(1, 10, 1), (1, 20, 2), (1, 30, 3), (2, 10, 1), (2, 20, 2), (2, 10, 3)]
    tags = spark.createDataFrame(rows, "file_id bigint, tag_id bigint, position int")
    want = {}
    for f in (1, 2):
        own = [(t, p) for g, t, p in rows if g == f]
        for i, (a, pa) in enumerate(own):
            for b, pb in own[i + 1 :]:
                if a != b:
                    fade = np.exp(-0.08 * (pb - pa - 1))
                    want[a, b, f] = want.get((a, b, f), 0) + fade
                    want[b, a, f] = want.get((b, a, f), 0) + 0.35 * fade
    found = G.edge_provenance(tags)
    got = [((r["src"], r["dst"], r["file_id"]), r["mass"]) for r in found.collect()]
    assert len(got) == len(want) and {k: pytest.approx(v) for k, v in got} == want
    assert "Union" in plan(found)
    shares = G.independent_fraction(found)
    assert "Join" not in plan(shares)
    for r in shares.collect():
        total = sum(v for (a, b, _), v in want.items() if (a, b) == (r["src"], r["dst"]))
        assert r["independent"] == pytest.approx(max(0.15, 1 - want[r["src"], r["dst"], r["file_id"]] / total))
