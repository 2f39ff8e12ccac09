import random

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import minhash as mh
from tagloom.llm.components import component_labels
from tests_llm_brute import brute_components


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in mh.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_chains_copies_and_edges(spark):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [draw.choice(vocabulary) for _ in range(200)]
    for i in range(120):  # copies of one text that differ from each other more than from the base
        words = list(base)
        for _ in range(draw.randint(0, 5)):
            words[draw.randrange(len(words))] = draw.choice(["alpha", "beta", "gamma"])
        rows.append((1000 - i, " ".join(words)))
    chain = [draw.choice(vocabulary) for _ in range(150)]
    for i in range(12):  # each a near copy of the one before only
        chain = chain[5:] + [draw.choice(vocabulary) for _ in range(5)]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(1, "A b C"), (2, "a B\tc"), (3, ""), (4, None), (5, " \n "), (6, "a b c d"), (7, "É b c"), (8, "é b c")]
    check(spark, rows)


def test_repeated_ids_null_ids_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (9, text), (None, "")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in mh.near_duplicates(docs).collect()), key=str)
    assert got == [(7, 7, True), (7, 7, True), (9, 7, False), (None, None, True), (None, None, True)]
    assert mh.near_duplicates(docs.filter(F.lit(False))).count() == 0


def test_signature_agreement_follows_jaccard():
    draw = np.random.default_rng(1)
    hits = []
    for _ in range(30):
        common = draw.integers(0, 2**63, 850, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, draw.integers(0, 2**63, 75, dtype=np.uint64)])) for _ in range(2))
        hits.append((mh.band_codes(mh._scramble(a)) == mh.band_codes(mh._scramble(b))).mean())
    assert abs(np.mean(hits) - 0.85**5) < 0.06 and min(hits) > 0
    assert len(mh.band_codes(draw.integers(0, 2**63, 300_000, dtype=np.uint64))) == mh.BANDS


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r["node"]: r["component"] for r in component_labels(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 199: 199, 200: 199}
