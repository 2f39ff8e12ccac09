from pyspark.sql import functions as F

from tagloom.llm import decontaminate as dc
from tagloom.llm.registry import table
from tests_llm_brute import brute_leaks

ITEM = "If Alice has 3 apples weighing 5 kg each and Bob takes 2 of them away how many apples does Alice have left at the end"
FILL = "some other words that have nothing to do with the question are placed around it for good measure "


def leaks(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, hash int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["same_values"]) for r in dc.contaminated(d, b).collect()}


def test_copies_parameters_and_swaps(spark):
    other = ITEM.replace("Alice", "Carol").replace("3", "17").replace("5 kg", "9 lb").replace("Bob", "Dave").replace("2", "11")
    mixed = ITEM.replace("does Alice", "does Carol")
    docs = [(1, FILL + ITEM + ". " + FILL), (2, FILL + other), (3, mixed), (4, FILL), (5, None), (6, ""), (7, " ".join(ITEM.split()[:14])), (8, ITEM), (8, ITEM), (None, ITEM)]
    got = leaks(spark, docs, [(1, ITEM), (2, ITEM), (3, "too short"), (4, None)])
    assert {d for d, _ in got} == {1, 2, 8, None} and {i for _, i in got} == {1, 2}
    assert got[1, 1][2] and not got[2, 1][2]


def test_removal(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, FILL), (None, ITEM), (None, FILL), (None, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    left = dc.without(docs, dc.contaminated(docs, bench)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in left), key=str) == sorted([(1, FILL), (None, FILL), (None, None)], key=str)
    assert dc.contaminated(docs, bench.filter(F.lit(False))).count() == 0
    assert dc.contaminated(docs.filter(F.lit(False)), bench).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs = [(i, FILL + ITEM + " " + str(i)) for i in range(5)]
    whole = leaks(spark, docs, [(1, ITEM), (2, FILL)])
    monkeypatch.setattr(dc, "BLOCK_WINDOWS", 7)
    assert leaks(spark, docs, [(1, ITEM), (2, FILL)]) == whole and len(whole) == 10


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute_leaks(table(spark, sf, "documents").collect(), table(spark, sf, "benchmark").collect())
    got = {(r["doc_id"], r["item_id"]) for r in dc.templates(spark, sf).collect()}
    assert got == want and want
