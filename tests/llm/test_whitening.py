import math

import numpy as np
import pytest

from tagloom.llm import whitening as W


def model_of(spark, vectors, ids=None, components=8):
    rows = [(i, v, 1.5) for i, v in zip(ids or range(len(vectors)), vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n double")
    return W.fit_whitening(df, keep=["vec_id", "n"], components=components)


def lattice(vectors):
    good = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in good], dtype=np.int64)


@pytest.mark.parametrize(
    "values",
    [[3.0], [3, 2, 1], 1 / np.arange(1, 120), np.ones(40), np.r_[np.full(12, 5.0), np.ones(60)], np.r_[4, 3, 2, np.zeros(50)], np.exp(-np.arange(300) / 60)],
)
def test_jacobi_davidson_agrees_with_a_dense_solver(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    v = (q * np.array(values)) @ q.T
    v = (v + v.T) / 2
    got, vectors = W.jacobi_davidson(lambda x: v @ x, d, 8)
    expected = np.linalg.eigvalsh(v)[::-1][:8]
    assert np.allclose(got, expected, rtol=0, atol=1e-13 * expected[0])
    assert np.abs(v @ vectors - vectors * got).max() < 1e-13 * expected[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13


def test_minres_solves_each_column():
    r = np.random.default_rng(1)
    a = r.standard_normal((20, 20))
    a, b = a + a.T, r.standard_normal((20, 3))
    b[:, 2] = 0
    assert np.allclose(a @ W.minres(lambda x: a @ x, b, 60, 1e-13), b, atol=1e-9)


def test_whitening_agrees_with_brute_force(spark):
    r = np.random.default_rng(2)
    m = r.standard_normal((400, 12)) * np.linspace(3, 0.2, 12) / 10
    vectors = [list(map(float, np.float32(v))) for v in m] + [list(map(float, np.float32(m[0])))] * 3
    vectors += [None, [float("nan")] + [0.0] * 11, [None] + [0.0] * 11, [float("inf")] + [0.0] * 11, [], [1.0, 2.0]]
    model = model_of(spark, vectors)
    x = lattice(vectors[:403])
    n, s = len(x), x.sum(axis=0)
    c = x - x.mean(axis=0)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    rows = W.whitened(model).select("row.vec_id", "row.n", "component", W.F.col("n").alias("fit"), "deviation", "whitened", "explained", "identity_error").collect()
    assert len(rows) == n * 8 and {r["fit"] for r in rows} == {n} and {r["n"] for r in rows} == {1.5}
    z = np.zeros((n, 8))
    for row in rows:
        z[row["vec_id"], row["component"] - 1] = row["whitened"]
        assert row["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[row["vec_id"]], s))
        assert row["explained"] == pytest.approx(e[row["component"] - 1] / np.trace(v), rel=1e-9)
        assert row["identity_error"] < 1e-10
    expected = c @ u / np.sqrt(e)
    assert np.allclose(z * np.sign((z * expected).sum(axis=0)), expected, atol=1e-9)


@pytest.mark.parametrize(
    "vectors, components",
    [([], 0), ([None, []], 0), ([[0.5, 0.25]], 0), ([[0.5, 0.25]] * 5, 0), ([[0.0, 1.0], [1.0, 0.0]], 1), ([[0.1, 0.2, 0.3], [0.4, 0.1, 0.9], [0.3, 0.8, 0.2], [0.5, 0.5, 0.0]], 3)],
)
def test_few_vectors(spark, vectors, components):
    model = model_of(spark, vectors)
    rows = W.whitened(model).collect()
    assert len(rows) == components * len(lattice(vectors)) and len(model.values) == components
    assert all(abs(r["whitened"]) < 10 for r in rows)


def test_deviations_beyond_64_bits_are_null():
    x = np.array([[1 << 40, 0], [3, 4]], dtype=np.int64)
    assert W._deviations(x, 1 << 20, [0, 0]).to_pylist() == [None, 25 << 40]
    assert W._deviations(x, 1, [0, 1]).to_pylist() == [None, 18]
    assert W._deviations(x[1:], 1, [0, 1]).to_pylist() == [18]
