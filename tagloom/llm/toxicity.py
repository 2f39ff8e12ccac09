"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings whose documents are nearly all marked toxic, at most LEXICON_SIZE
entries. Features are the density of lexicon words, plain and disguised, their nearness to second-person words, capitals,
exclamation marks and disguised spellings. Lexicon, trees and calibration learn from different parts of the labelled
rows, so that none is fitted on what another has seen; held-out rows are in no part.

Null and empty texts have all features zero. Without labels of both kinds the score is the smoothed share of label 1.
Repeated rows are scored each; repeated labels count as their majority. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.labels import fold, training_labels
from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage

THRESHOLD = 0.5
LEXICON_FOLDS = (2, 3, 4)
LEXICON_SIZE = 2000
MIN_DOCS, MIN_SHARE = 5, 0.8
STEMS = (4, 5, 6)
NEAR = 5
TREES, DEPTH, SEED = 20, 3, 7
# A calibrated step function ties many scores; this share of the tree score keeps their order.
TREE_SHARE = 0.02
CACHE_ENTRIES = 100_000
# Second-person words of the four languages, and letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
DISGUISES = str.maketrans("013457@$!", "oieastasi")
EDGES = ".,;:!?\"'()[]{}<>«»„“”…|"
FEATURES = ["log_words", "hit_rate", "log_hits", "disguised_rate", "person_rate", "near_rate", "upper_rate", "bang_rate", "odd_rate"]


def token(word: str) -> str:
    return word.strip(EDGES).lower()


def plain(tok: str) -> str:
    """A token with disguises undone: look-alikes replaced, everything but letters dropped."""
    return "".join(c for c in tok.translate(DISGUISES) if c.isalpha())


def entries_of(tok: str) -> list[str]:
    """The word itself and its beginnings, marked by a star."""
    return [tok, *(f"{tok[:n]}*" for n in STEMS if len(tok) > n)]


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> list[str]:
    """Rows hold `text` and `label`. Counts are summed per batch before the shuffle; at most `size` entries come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_label = {0.0: Counter(), 1.0: Counter()}
            for text, label in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                tokens = {token(w) for w in (text or "").split()}
                by_label[label].update({e for t in tokens if t for e in entries_of(t)})
            known = list(by_label[0.0].keys() | by_label[1.0].keys())
            yield pa.RecordBatch.from_pydict({
                "entry": pa.array(known, pa.string()),
                "toxic": pa.array([by_label[1.0][e] for e in known], pa.int64()),
                "clean": pa.array([by_label[0.0][e] for e in known], pa.int64()),
            })

    counts = rows.select("text", "label").mapInArrow(count, "entry string, toxic bigint, clean bigint")
    summed = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    telling = summed.filter((F.col("toxic") >= MIN_DOCS) & ((F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1) >= MIN_SHARE))
    return [r["entry"] for r in telling.orderBy(F.desc("toxic"), "entry").limit(size).collect()]


HIT, DISGUISED, PERSON, ODD = 1, 2, 4, 8


class _Words(dict):
    """What is known of a word, packed: marks in 8 bits, then the number of capitals."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def listed(self, tok: str) -> bool:
        return bool(tok) and any(e in self.lexicon for e in entries_of(tok))

    def __missing__(self, word: str) -> int:
        tok = token(word)
        marks = HIT if self.listed(tok) else 0
        odd = not tok.isalpha() and any(c.isalpha() for c in tok)
        if odd:
            marks |= ODD | (DISGUISED if not marks and self.listed(plain(tok)) else 0)
        if tok in SECOND_PERSON:
            marks |= PERSON
        packed = marks | sum(map(str.isupper, word)) << 8
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(word) < 40:
            self[word] = packed
        return packed


def features_of(text: str | None, known: _Words) -> list[float]:
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)
    hits = np.flatnonzero(codes & (HIT | DISGUISED))
    people = np.flatnonzero(codes & PERSON)
    near = 0
    if len(hits) and len(people):
        after = np.searchsorted(people, hits)
        gap = np.minimum(
            np.abs(people[np.minimum(after, len(people) - 1)] - hits), np.abs(hits - people[np.maximum(after - 1, 0)])
        )
        near = int((gap <= NEAR).sum())
    return [
        math.log1p(n), len(hits) / n, math.log1p(len(hits)), np.count_nonzero(codes & DISGUISED) / n, len(people) / n, near / n,
        int((codes >> 8).sum()) / sum(map(len, words)), (text.count("!") + text.count("?")) / n, np.count_nonzero(codes & ODD) / n,
    ]


def toxicity_features(text, lexicon: list[str]):
    """Array of the features in the order of FEATURES."""
    entries = frozenset(lexicon)

    @F.arrow_udf("array<double>")
    def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Words(entries)
        for batch in texts:
            yield pa.array((features_of(t.as_py(), known) for t in batch), pa.list_(pa.float64()))

    return features(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns of each document and `score`; `doc_id` names the documents of `labels`."""
    train = training_labels(labels, "toxic")
    texts = docs.select("doc_id", "text").join(train.filter(F.col("fold").isin(*LEXICON_FOLDS)), "doc_id")
    lexicon = learn_lexicon(texts)
    columns = list(dict.fromkeys(["doc_id", *keep]))
    rows = cut_lineage(docs.select(*columns, toxicity_features("text", lexicon).alias("toxicity_features")), "toxicity")
    vectors = rows.withColumn("toxicity_vector", array_to_vector("toxicity_features"))
    fitted = cut_lineage(rows.select("doc_id", "toxicity_features").join(train, "doc_id"), "toxicity-training")
    fitted = fitted.withColumn("toxicity_vector", array_to_vector("toxicity_features"))

    def share(part: DataFrame) -> tuple[int, float]:
        return part.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()

    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    unseen = fitted.filter(~F.col("fold").isin(*LEXICON_FOLDS))
    grown = unseen.filter(half == 0)
    n, positive = share(grown)
    if not 0 < positive < n:
        return rows.select(*keep, F.lit((positive + 1) / (n + 2)).alias("score"))
    boosted = GBTClassifier(featuresCol="toxicity_vector", labelCol="label", predictionCol="toxicity_tree", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED)
    model = boosted.setProbabilityCol("toxicity_p").setRawPredictionCol("toxicity_raw").fit(grown)
    trees = lambda part: model.transform(part).withColumn("tree_score", vector_to_array("toxicity_p")[1])
    scored = trees(vectors)
    held = unseen.filter(half == 1)
    n, positive = share(held)
    if not 0 < positive < n:
        return scored.select(*keep, F.col("tree_score").alias("score"))
    # Rows of one tree score would meet in one task of the fit; their weighted mean stands for them.
    levels = trees(held).groupBy("tree_score").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    steps = IsotonicRegression(featuresCol="tree_score", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(levels)
    mixed = (1 - TREE_SHARE) * F.col("calibrated") + TREE_SHARE * F.col("tree_score")
    return steps.transform(scored).select(*keep, mixed.alias("score"))


@query("op6_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
