import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.params import FieldParams, PyramidParams, SelectionParams, SpikeParams
from tagloom.plans import fields as FD
from tagloom.plans import observe as O
from tagloom.plans import select as S


def test_projection_of_one_level():
    rng = np.random.default_rng(0)
    q, tags = rng.normal(size=12), rng.normal(size=(4, 12))
    tags = np.vstack([tags, tags[0]])
    out = O.project_level(q, tags)
    basis, _ = np.linalg.qr(tags[:4].T)
    assert np.allclose(out["residual"], q - basis @ (basis.T @ q))
    assert out["coefficients"][4] == 0 or out["coefficients"][4] < 1e-9
    assert np.allclose(sorted(out["coefficients"][:4] ** 2), sorted((basis.T @ q) ** 2))
    assert 0 <= out["noise"] <= 1


def test_pyramid_explains_and_stops(spark):
    tags = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "tag_id bigint, vector array<double>")
    q = spark.createDataFrame([(1, [0.6, 0.8, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 0.0])], "query_id bigint, vector array<double>")
    levels, features = O.residual_pyramid(q, tags, PyramidParams(levels=2, top_k=2))
    f = {r["query_id"]: r for r in features.collect()}
    assert f[1]["coverage"] == pytest.approx(1.0) and f[1]["depth"] == 1
    assert f[2]["coverage"] == pytest.approx(0.0) and f[2]["depth"] == 2
    assert f[3]["depth"] == 0 and f[3]["novelty"] == 1.0


def test_axes(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(40, 5)) * np.array([4, 2, 1, 0.5, 0.2])
    tags = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "tag_id bigint, vector array<double>")
    basis = O.axis_basis(tags, 4).orderBy("axis").collect()
    values, vectors = np.linalg.eigh(np.cov(m.T, bias=True))
    order = np.argsort(-values)[:4]
    assert np.allclose([r["energy"] for r in basis], values[order])
    for r, i in zip(basis, order):
        assert abs(abs(np.dot(r["basis"], vectors[:, i])) - 1) < 1e-9
        assert r["label"] == np.abs((m - m.mean(axis=0)) @ vectors[:, i]).argmax()
    q = spark.createDataFrame([(1, m[0].tolist()), (2, m.mean(axis=0).tolist())], "query_id bigint, vector array<double>")
    got = {r["query_id"]: r for r in O.axis_analysis(q, O.axis_basis(tags, 4)).collect()}
    x = ((m[0] - m.mean(axis=0)) @ vectors[:, order]) ** 2
    share = x / x.sum()
    assert got[1]["entropy"] == pytest.approx(-(share * np.log2(share)).sum() / 2)
    assert got[1]["axes"] == (share > 0.05).sum()
    assert (got[2]["logic_depth"], got[2]["entropy"], got[2]["world"]) == (0.0, 1.0, None)


def brute_spike(seeds, edges, p):
    w = p.hop_weights()
    out = {}
    for s, d, x in edges:
        out.setdefault(s, []).append((d, x))
    for s in out:
        out[s] = sorted(out[s], key=lambda e: (-e[1], e[0]))[: p.neighbours]
    states = {(None, n): [e, p.momentum] for n, e in seeds.items()}
    energy = {n: e * w[0] for n, e in seeds.items()}
    flow = {}
    for hop in range(p.hops):
        nxt = {}
        for (prev, node), (e, m) in states.items():
            if e < p.firing or m < 0:
                continue
            for d, x in out.get(node, []):
                inj = e * x * (p.wormhole_decay if x >= p.tension else p.decay) * (p.return_factor if prev == d else 1.0)
                if inj < p.min_current:
                    continue
                flow[(node, d)] = flow.get((node, d), 0) + inj
                nm = m - (0 if x >= p.tension else 1)
                if nm < 0 and x < p.tension:
                    continue
                old = nxt.setdefault((node, d), [0.0, nm])
                old[0] += inj
                old[1] = max(old[1], nm)
        keep = sorted(nxt.items(), key=lambda kv: (-kv[1][0], kv[0]))[: p.max_states]
        states = dict(keep)
        for (_, d), (e, _) in states.items():
            energy[d] = energy.get(d, 0) + e * w[hop + 1]
    return energy, flow


def test_spike_matches_brute_force(spark):
    rng = random.Random(5)
    edges = [(s, d, rng.uniform(0.05, 1.2)) for s in range(12) for d in rng.sample(range(12), 5) if s != d]
    p = SpikeParams(firing=0.001, min_current=0.0001, neighbours=3, max_states=12)
    seeds = {0: 1.0, 3: 0.5}
    t = spark.createDataFrame([(s, d, w, False) for s, d, w in edges], "src bigint, dst bigint, weight double, wormhole boolean")
    sd = spark.createDataFrame([(1, n, e, False) for n, e in seeds.items()], "query_id bigint, tag_id bigint, energy double, is_core boolean")
    nodes, flows = O.propagate(sd, t, p)
    energy, flow = brute_spike(seeds, edges, p)
    assert {r["tag_id"]: pytest.approx(r["energy"]) for r in nodes.collect()} == energy
    assert {(r["src"], r["dst"]): pytest.approx(r["flow"]) for r in flows.collect()} == flow
    none, _ = O.propagate(sd.filter("energy > 5"), t, p)
    assert none.count() == 0


def test_fields_match_the_closed_form(spark):
    rng = np.random.default_rng(4)
    t = rng.random((6, 6)) * 0.95
    t = t / t.sum(axis=1, keepdims=True) * 0.95
    edges = spark.createDataFrame([(i, j, float(t[i, j])) for i in range(6) for j in range(6)], "src bigint, dst bigint, weight double")
    source = spark.createDataFrame([(q, i, 0.5) for q in range(20) for i in (q % 6, (q + 1) % 6)], "query_id bigint, tag_id bigint, source_mass double")
    got = FD.dual_fields(source, edges).collect()
    for q in (0, 7, 19):
        s = np.zeros(6)
        s[[q % 6, (q + 1) % 6]] = 0.5
        for kind, a in (("local", FieldParams().alpha_local), ("transfer", FieldParams().alpha_transfer)):
            want = (1 - a) * s @ np.linalg.inv(np.eye(6) - a * t)
            have = np.zeros(6)
            for r in got:
                if r["query_id"] == q:
                    have[r["tag_id"]] = r[kind]
            assert np.allclose(have, want, atol=1e-8)


def test_fusion_merges_twins(spark):
    tv = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "tag_id bigint, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<double>")
    nodes = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0), (1, 3, 0.5)], "query_id bigint, tag_id bigint, energy double")
    seeds = spark.createDataFrame([(1, 1, 1.5, False)], "query_id bigint, tag_id bigint, energy double, is_core boolean")
    boosts = spark.createDataFrame([(1, 0.5, 1.3)], "query_id bigint, alpha double, core_boost double")
    fused, selected = FD.fuse(q, nodes, seeds, boosts, tv)
    assert {r["tag_id"]: pytest.approx(r["weight"]) for r in selected.collect()} == {1: 2.2, 3: 0.5}
    c = np.array([2.2, 0.5])
    want = 0.5 * np.array([1, 0]) + 0.5 * c / np.linalg.norm(c)
    assert np.allclose(fused.first()["vector"], want / np.linalg.norm(want))


def row(i, score, tokens=100, short=50, tags=(), stamp=None):
    return {"id": i, "file_id": i, "score": score, "effective": score, "tokens": tokens, "short_tokens": short, "tags": list(tags), "stamp": stamp}


def seated(rows, seats, now=0.0, **kw):
    out = S.choose_seats(rows, seats, now, SelectionParams(**kw))
    return [r["id"] for r in out if r["seat"]], {r["id"]: r["outcome"] for r in out}


def test_seats():
    rows = [row(i, 1 - i / 10) for i in range(4)]
    assert seated(rows, 2)[0] == [0, 1]
    taken, how = seated([row(0, 0.9, 550), row(1, 0.8, 500, 40), row(2, 0.7, 400, 300), row(3, 0.6, 10, 10)], 3)
    assert taken == [0, 1, 3] and how[1] == "shortened" and how[2] == "token-budget"
    tagged = [row(0, 0.90, tags="ab"), row(1, 0.89, tags="ab"), row(2, 0.88, tags="xy"), row(3, 0.1), row(4, 0.05)]
    assert seated(tagged, 2)[0] == [0, 2]
    hour = 3_600_000_000
    fresh = [row(0, 0.9), row(1, 0.8), row(2, 0.1, stamp=90 * hour)]
    assert seated(fresh, 2, now=100 * hour)[0] == [0, 2]
    assert seated(fresh, 1, now=100 * hour)[0] == [0]
    assert seated(fresh, 2, now=1000 * hour)[0] == [0, 1]
    heavy = [row(0, 0.9, 300), row(1, 0.8, 100), row(2, 0.1, 900, 800, stamp=90 * hour)]
    assert seated(heavy, 2, now=100 * hour)[0] == [0, 1]


def test_gate(spark):
    cases = [(0.6, 0.5, 0.9, "current", True), (0.5, 0.63, 0.1, "assistant", True), (0.5, 0.6, 0.9, "assistant", False), (None, None, 0.56, "window", True), (None, None, 0.5, "window", False), (0.5, None, 0.9, "current", False), (0.7, 0.65, 0.0, "current", True)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, user double, assistant double, window double")
    assert {r["i"]: (r["gate_vector"], r["passed"]) for r in S.gate(df).collect()} == {i: c[3:] for i, c in enumerate(cases)}


def test_repeats(spark):
    keys = "aaaaaaaaaabba"
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(keys)], "session_id bigint, turn bigint, key string")
    assert [r["turn"] for r in S.suppress_repeats(df).orderBy("turn").collect() if r["shown"]] == [0, 8, 10, 12]
    gapped = spark.createDataFrame([(1, t, "a") for t in (1, 10, 12, 20)] + [(2, 3, "a")], "session_id bigint, turn bigint, key string")
    assert sorted((r["session_id"], r["turn"]) for r in S.suppress_repeats(gapped).collect() if r["shown"]) == [(1, 1), (1, 10), (1, 20), (2, 3)]


def test_usage_bonus_needs_company_and_forgives_clocks(spark):
    hour = 3_600_000_000
    rows = [(1, 1, 1, 0.9, 0.9, 0), (2, 1, 1, 0.9, 0.9, 0), (2, 2, 2, 0.8, 0.8, 0)]
    ranked = spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, file_id bigint, knn double, raw_score double, stamp bigint")
    ledger = spark.createDataFrame([(1, 0, 50, None, 200 * hour)], "file_id bigint, passive bigint, active bigint, last_passive_at bigint, last_active_at bigint")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in S.adjusted_scores(ranked, ledger, F.lit(100 * hour)).collect()}
    assert got[1, 1] == 0.9 and got[2, 2] == 0.8 and abs(got[2, 1] - 0.95) < 1e-6


def test_parameter_bounds():
    assert SpikeParams(gamma=2.0).clamped().gamma == 0.95
    with pytest.raises(ValueError):
        SelectionParams(k=0).check()
    assert sum(SpikeParams().hop_weights()) == pytest.approx(1.0)
    assert F is not None


def test_queries_without_a_field_stay(spark):
    from tagloom.plans import rank_topology as R

    cands = spark.createDataFrame([(1, 10), (2, 10)], "query_id bigint, chunk_id bigint")
    chunks = spark.createDataFrame([(10, 5, [1.0, 0.0])], "chunk_id bigint, file_id bigint, vector array<double>")
    full = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id bigint, vector array<double>")
    local = full.filter("query_id = 1")
    got = {r["query_id"]: (r["query_score"], r["local_score"]) for r in R.candidate_cosines(cands, {"query_knn": full, "local_knn": local}, chunks).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0)}
    roles = spark.createDataFrame([(q, 10, 1, 0.5, 0.4, "direct_answer") for q in (1, 2)], "query_id bigint, chunk_id bigint, union_rank int, union_score double, pure_score double, role string")
    bonus = spark.createDataFrame([(1, 10, 0.1), (2, 10, 0.1)], "query_id bigint, chunk_id bigint, innovation_bonus double")
    anchors = spark.createDataFrame([(1, 10, 0.0, 0), (2, 10, 0.0, 0)], "query_id bigint, chunk_id bigint, strength double, contacted int")
    omega = spark.createDataFrame([(1, 0.5, "rich")], "query_id bigint, omega double, regime string")
    ranked = {r["query_id"]: r for r in R.final_rank(roles, bonus, anchors, omega).collect()}
    assert set(ranked) == {1, 2} and abs(ranked[2]["topology_bonus"] - 0.001) < 1e-12 and ranked[2]["regime"]
