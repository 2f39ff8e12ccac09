import math
import zlib

from pyspark.sql import functions as F

from tagloom.llm import rule_ensemble as re_
from tagloom.llm.registry import table

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, label string, features string, score string"


def test_paths_become_rules():
    text = "Model\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     If (feature 1 <= -2.0E-3)\n      Predict: 0.0\n     Else (feature 1 > -2.0E-3)\n      Predict: 1.0\n    Else (feature 0 > 1.5)\n     Predict: 1.0\n"
    assert set(re_.tree_rules(text, ["a", "b"])) == {
        (("a", "<=", 1.5),), (("a", ">", 1.5),), (("a", "<=", 1.5), ("b", "<=", -0.002)), (("a", "<=", 1.5), ("b", ">", -0.002)),
    }


def test_held_out_accuracy(spark):
    rows = re_.rule_ensemble(spark, SF).join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95


def test_every_row_scored(spark):
    docs = spark.createDataFrame([(1, None, "", "", ""), (2, "", "", "", ""), (2, "", "", "", ""), (None, "a b " * 50, "", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    scores = [r["score"] for r in re_.score_quality(docs, none, ["doc_id"]).collect()]
    assert scores == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (1, 1), (3, None)], "doc_id bigint, quality int")
    scores = [r["score"] for r in re_.score_quality(docs, one, ["doc_id"]).collect()]
    assert all(0.5 <= s < 1 for s in scores) and len(scores) == 4
    assert re_.score_quality(docs.filter(F.lit(False)), none, ["doc_id"]).count() == 0


def test_model_expression(spark):
    model = re_.RuleModel(-1.0, {(("a", "<=", 2.0), ("b", ">", 0.0)): 3.0})
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0)], "a double, b double").select(model.score().alias("s")).collect()
    assert [round(r["s"], 9) for r in rows] == [round(1 / (1 + math.exp(-2)), 9), round(1 / (1 + math.exp(1)), 9)]
