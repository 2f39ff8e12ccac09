"""Anchor gains against the projection of one tag at a time, and the transport step below them."""

import numpy as np
import pytest

from tagloom.operators import graph as G
from tagloom.plans import residuals as R
from tagloom.plans.observe import project_level


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("limit", "rows"), [(R.BROADCAST_BYTES, 10_000), (0, 3)])
def test_gains_equal_single_projections(spark, monkeypatch, limit, rows):
    monkeypatch.setattr(R, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(7, 5)).astype(np.float32)
    m[6] = 0
    # Tags share vectors, tag 20 has no edge, tag 21 no vector and tag 22 no row of its own.
    tags = {t: t % 7 for t in range(21)} | {21: 99}
    edges = [(s, d, float(rng.random())) for s in range(20) for d in rng.choice(23, 6, replace=False) if s != d] + [(22, 1, 0.5), (21, 1, 0.5)]
    transport = spark.createDataFrame([(int(s), int(d), w, False) for s, d, w in edges], "src bigint, dst bigint, weight double, wormhole boolean")
    names = spark.createDataFrame(list(tags.items()), "tag_id bigint, vec_id bigint")
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, vector array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = R.anchor_gains(transport, names, vectors, 3)
        got = {r["tag_id"]: (r["residual_ratio"], r["anchor_gain"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(range(21))
    for t in range(21):
        best = sorted((-w, d) for s, d, w in edges if s == t)[:3]
        near = [m[tags[d]] for _, d in best if tags.get(d, 99) < 7]
        own, want = m[t % 7].astype(float), 1.0
        total = own @ own
        if near:
            rest = project_level(own, np.stack(near).astype(float))["residual"]
            want = rest @ rest / total if total > 0 else 0.0
        assert got[t] == (pytest.approx(want, abs=1e-12), pytest.approx(min(2.0, max(0.5, 0.5 + 1.5 * want)), abs=1e-12))


def test_gains_call_no_function_per_tag(spark):
    transport = spark.createDataFrame([(0, 1, 0.5, False)], "src bigint, dst bigint, weight double, wormhole boolean")
    names = spark.createDataFrame([(0, 0), (1, 1)], "tag_id bigint, vec_id bigint")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, vector array<float>")
    assert "FlatMapGroupsInPandas" not in plan(R.anchor_gains(transport, names, vectors))


def test_transport_joins_no_edges(spark):
    fact = spark.createDataFrame([(1, 2, 1.0), (2, 1, 3.0), (2, 3, 0.5), (3, 1, 4.0)], "src bigint, dst bigint, weight double")
    t = G.transport_edges(fact)
    assert "Join" not in t._jdf.queryExecution().optimizedPlan().toString().split("scalar-subquery")[0]
    ev = {(s, d): np.log1p(w) for s, d, w in [(1, 2, 1.0), (2, 1, 3.0), (2, 3, 0.5), (3, 1, 4.0)]}
    cond = {e: x * 1.35 if x >= 1 else x for e, x in ev.items()}
    into = {d: sum(x for (_, e), x in cond.items() if e == d) for d in (1, 2, 3)}
    median = sorted(into.values())[1]
    v = {e: x * min(1.8, max(0.55, (into[e[1]] / (1.1 * median)) ** -0.3)) for e, x in cond.items()}
    for r in t.collect():
        e, total = (r["src"], r["dst"]), sum(x for (s, _), x in v.items() if s == r["src"])
        worm = sum(x for (s, d), x in v.items() if s == r["src"] and ev[s, d] >= 1)
        want = (0.95 - (0.05 if worm else 0)) * v[e] / total + (0.05 * v[e] / worm if ev[e] >= 1 else 0)
        assert r["weight"] == pytest.approx(want) and r["wormhole"] == (ev[e] >= 1)
