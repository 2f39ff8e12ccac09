from pyspark.sql import functions as F

from tagloom.llm import toxicity as tox
from tagloom.llm.registry import table

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id bigint, text string, fold int, toxicity_features string, label string"


def test_words_and_disguises():
    known = tox._Words(frozenset(["scum", "lowei*"]))
    f = dict(zip(tox.FEATURES, tox.features_of("You are 5cum, s.c.u.m! loweivor but NOT scummy", known), strict=True))
    assert f["hit_rate"] == 3 / 8 and f["disguised_rate"] == 2 / 8 and f["person_rate"] == 1 / 8
    assert f["near_rate"] == 3 / 8 and f["bang_rate"] == 1 / 8
    assert tox.features_of(None, known) == tox.features_of(" \n", known) == [0.0] * len(tox.FEATURES)
    assert len(tox.features_of("x" * 3_000_000, known)) == len(tox.FEATURES)


def test_very_long_words_count_whole():
    known = tox._Words(frozenset())
    f = dict(zip(tox.FEATURES, tox.features_of("A" * 200_000 + "b" * 1_800_000 + "!" * 100_000 + " c?", known), strict=True))
    assert f["upper_rate"] == 200_000 / 2_100_002 and f["bang_rate"] == 100_001 / 2


def test_lexicon_needs_support(spark):
    rows = [("bad word", 1.0)] * 6 + [("good word", 0.0)] * 20 + [("rare", 1.0)] * 2
    assert tox.learn_lexicon(spark.createDataFrame(rows, "text string, label double")) == ["bad"]


def test_held_out_accuracy(spark):
    rows = tox.toxicity(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_every_row_scored(spark):
    docs = spark.createDataFrame([(1, None, 0, "", ""), (2, "", 0, "", ""), (2, "", 0, "", ""), (None, "a b", 0, "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in tox.score_toxicity(docs, none, ["doc_id"]).collect()] == [0.5] * 4
    assert tox.score_toxicity(docs.filter(F.lit(False)), none, ["doc_id"]).count() == 0
