import numpy as np
import pytest

from tagloom.operators import distances as D
from tagloom.params import PyramidParams
from tagloom.plans import observe as O


def frame(spark, m, ident):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{ident} bigint, vector array<double>").repartition(3)


def brute(q, c, k):
    out = []
    for i, v in enumerate(q):
        d = np.round(((c - v) ** 2).sum(axis=1), 9)
        out += [(i, int(j), rank + 1) for rank, j in enumerate(np.lexsort((np.arange(len(c)), d))[:k])]
    return out


def corpus():
    """Unequal norms, ties, copies beyond one block of a hot cell, and far clusters."""
    rng = np.random.default_rng(4)
    m = np.vstack([rng.normal(size=(80, 6)) * rng.lognormal(1, 1, (80, 1)), rng.normal(size=(40, 6)) + 50])
    return np.vstack([m, np.repeat(m[5:6], 60, axis=0), -m[:20], np.zeros((2, 6))])


@pytest.mark.parametrize("k", [1, 7, 500])
@pytest.mark.parametrize("few", [0, 1000])
def test_nearest_equals_brute_force(spark, monkeypatch, k, few):
    monkeypatch.setattr(D, "PIVOTS", 9)
    monkeypatch.setattr(D, "BLOCK_ROWS", 16)
    c = corpus()
    q = np.vstack([c[::9], c[:5] * 1.1, np.full((1, 6), 1e3)])
    got = D.nearest_by_distance(frame(spark, q, "query_id"), frame(spark, c, "item_id"), k, broadcast_rows=few)
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in got.collect()) == sorted(brute(q, c, k))


def test_cells_are_left_out():
    away, radius, sizes = np.array([[1.0, 5.0, 90.0]]), np.array([2.0, 1.0, 3.0]), np.array([4, 4, 4])
    assert D.cells_to_visit(away, radius, sizes, 3).tolist() == [[True, False, False]]
    assert D.cells_to_visit(away, radius, sizes, 5).tolist() == [[True, True, False]]
    assert D.cells_to_visit(away, radius, sizes, 50).tolist() == [[True, True, True]]


def test_empty_sides(spark):
    some, none = frame(spark, np.eye(2), "query_id"), spark.createDataFrame([], "item_id bigint, vector array<double>")
    assert D.nearest_by_distance(some, none, 3).count() == D.nearest_by_distance(some, none, 3, broadcast_rows=0).count() == 0
    nobody = spark.createDataFrame([], "query_id bigint, vector array<double>")
    assert D.nearest_by_distance(nobody, some.withColumnRenamed("query_id", "item_id"), 3).count() == 0


def test_pyramid_takes_the_nearest_not_the_best_aligned(spark):
    tags = spark.createDataFrame([(1, [1.0, 0.0]), (2, [10.0, 2.0])], "tag_id bigint, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.2])], "query_id bigint, vector array<double>")
    levels, _ = O.residual_pyramid(q, tags, PyramidParams(levels=1, top_k=1))
    assert [r["tag_id"] for r in levels.collect()] == [1]
