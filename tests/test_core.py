"""Running values, order statistics, joins and graph rules against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.operators import graph as G
from tagloom.operators import joins as J
from tagloom.operators.components import connected_components, tag_components
from tagloom.operators.ledger import cumulative_domain
from tagloom.operators.order_stats import Rank, order_statistics
from tagloom.operators.running import running


def test_running_matches_a_plain_walk(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    out = running(df, ["k"], ["i"], F.floor(F.col("i") / 7), {"l": ("last", F.col("v")), "p": ("prev", F.col("v")), "s": ("sum", F.col("v")), "n": ("count_before", F.col("v"))}).collect()
    want, state = {}, defaultdict(lambda: [None, 0, 0])
    for k, i, v in rows:
        last, total, n = state[k]
        now = last if v is None else v
        want[i] = (now, last, total + (v or 0), n)
        state[k] = [now, total + (v or 0), n + (v is not None)]
    assert {r["i"]: (r["l"], r["p"], r["s"], r["n"]) for r in out} == want
    down = running(df, ["k"], ["i"], F.floor(F.col("i") / 7), {"l": ("last", F.col("v"))}, descending=True).collect()
    last, want = {}, {}
    for k, i, v in reversed(rows):
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert {r["i"]: r["l"] for r in down} == want


@pytest.mark.parametrize("n", [1, 2, 4, 5, 19, 1500])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    values = [rng.choice([5, 5, 5, rng.randint(0, 10_000)]) for _ in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v bigint")
    top = F.greatest(F.lit(0), F.floor(F.lit(0.95) * F.col("n")).cast("bigint") - 1)
    r = order_statistics(df, ["g"], "v", [Rank("m", 0.5, F.floor(F.col("n") / 2)), Rank("q", 0.95, top)]).first()
    s = sorted(values)
    assert (r["n"], r["m"], r["q"]) == (n, s[n // 2], s[max(0, int(0.95 * n) - 1)])


def test_shared_tags_counts_every_note_once(spark):
    rng = random.Random(3)
    rows = {(f, t) for f in range(40) for t in rng.sample(range(15), rng.randint(1, 5))} | {(99, t) for t in range(15)} | {(f, 0) for f in range(0, 40, 2)}
    got = {r["file_id"]: r["shared"] for r in J.notes_sharing_a_tag(spark.createDataFrame(sorted(rows), "file_id bigint, tag_id bigint"), direct_above=8).collect()}
    tags = defaultdict(set)
    for f, t in rows:
        tags[f].add(t)
    assert got == {f: sum(bool(ts & us) for g, us in tags.items() if g != f) for f, ts in tags.items()}


def test_substring_lookup(spark):
    needles = spark.createDataFrame([("ab",), ("abcd",), ("zz",), ("b",)], "needle string")
    titles = spark.createDataFrame([("xabc",), ("abcd",), ("q",)], "title string")
    got = {r["needle"]: (r["matches"], r["status"]) for r in J.find_by_substring(needles, titles).collect()}
    assert got == {"ab": (2, "ambiguous"), "abcd": (1, "unique"), "zz": (0, "missing"), "b": (2, "ambiguous")}


def test_matching_rounds_use_every_call_once(spark):
    def frame(ids):
        rows = [(1, i, t, "x") for i, t in ids]
        return spark.createDataFrame(rows, "u bigint, id bigint, s bigint, label string").withColumn("t", F.expr("timestampadd(SECOND, s, TIMESTAMP_NTZ '2024-01-01 00:00:00')"))

    got = J.interval_match_rounds(frame([(1, 0), (2, 10)]), frame([(11, 12), (12, 13), (13, 400)]), ["u"], 300, 10).collect()
    assert {(r["event_id"], r["call_id"]) for r in got} == {(11, 2), (12, 1)}
    ordered = J.interval_match_in_order(frame([(1, 0), (2, 10), (3, 401), (4, 700)]), frame([(12, 13), (11, 12), (13, 400), (14, 401)]), ["u"], 300, 10).collect()
    assert {(r["event_id"], r["call_id"]) for r in ordered} == {(11, 2), (12, 1), (13, 3)}


def test_cumulative_domain(spark):
    df = spark.createDataFrame([(1, i, m) for i, m in enumerate([5.0, 3.0, 1.0, 1.0, 0.0])], "q bigint, id bigint, m double")
    kept = {r["id"] for r in cumulative_domain(df, ["q"], "m", "id", 0.8).collect()}
    assert kept == {0, 1}
    assert {r["id"] for r in cumulative_domain(df, ["q"], "m", "id", 0.1, floor=3).collect()} == {0, 1, 2}
    assert {r["id"] for r in cumulative_domain(df, ["q"], "m", "id", 1.0, cap=2).collect()} == {0, 1}


EDGES = [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 11, 1), (2, 12, 2), (3, 13, 1), (4, 12, 1), (4, 10, 2)]


def graph(spark, rows, **kw):
    return G.fact_edges(spark.createDataFrame(rows, "file_id bigint, tag_id bigint, position int"), **kw)


def test_fact_edges_by_hand(spark):
    got = {(r["src"], r["dst"]): r["weight"] for r in graph(spark, EDGES).collect()}
    phi = lambda p, n: 0.9 - 0.4 * (p - 1) / max(n - 1, 1)
    assert got[(11, 12)] == pytest.approx(phi(2, 3) * phi(3, 3) + phi(1, 2) * phi(2, 2))
    assert got[(10, 12)] == pytest.approx(phi(1, 3) * phi(3, 3) + 0.42 * phi(1, 2) * phi(2, 2))
    assert (13, 10) not in got


def test_files_outside_the_size_rule_add_nothing(spark):
    big = [(1, t, t + 1) for t in range(101)] + [(2, 1, 1)]
    assert graph(spark, big).count() == 0
    assert graph(spark, []).count() == 0
    assert graph(spark, [(1, t, t + 1) for t in range(100)]).count() == 9900


def test_rows_of_the_transport_sum_to_the_row_mass(spark):
    rows = G.transport_edges(graph(spark, EDGES)).groupBy("src").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(0.95) for r in rows)


def test_partitioning_does_not_change_the_graph(spark):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return {(r["src"], r["dst"]): round(r["weight"], 9) for r in G.transport_edges(graph(spark, EDGES * 1)).collect()}

    try:
        assert run(1) == run(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), spark.createDataFrame([(7,), (999,)], "node bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and got[201] == 200 and got[999] == 999
    islands = tag_components(spark.createDataFrame([(f, t) for f in range(3) for t in (f * 10, f * 10 + 1)], "file_id bigint, tag_id bigint"))
    assert islands.select("component").distinct().count() == 3
