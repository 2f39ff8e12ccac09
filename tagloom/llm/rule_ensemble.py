"""Quality classifier: a sparse rule ensemble over text statistics.

Trees grown on the labelled rows are cut into paths, each path is a conjunctive rule over statistics, a lasso logistic
fit keeps few rules, and the kept rules become one column expression, so scoring is a projection.

Null and empty texts have all statistics zero and get a score like any other. Without labels of both kinds the score is
the smoothed label share. Repeated rows are scored each; repeated labels of a document count as their majority. Labels,
lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.columns import words_of
from tagloom.llm.host_rules import text_counts
from tagloom.llm.labels import fold, training_labels
from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage

THRESHOLD = 0.3
TREES, DEPTH, LASSO, SEED = 24, 3, 0.002, 7

# Statistics by name, over the counts of a text.
STATISTICS = {
    "log_words": "ln(1 + n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "bang_rate": "n_bangs / greatest(n_words, 1)",
    "bar_rate": "n_bars / greatest(n_words, 1)",
    "stop_rate": "n_stops / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
# Characters counted besides the base counts.
CHARACTERS = {"n_upper": r"[^\p{Lu}]+", "n_digits": "[^0-9]+", "n_bangs": "[^!?]+", "n_bars": r"[^|]+", "n_stops": "[^.]+"}


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns and one double per statistic of the whole text."""
    full = F.coalesce(F.col(text), F.lit(""))
    counts = docs.select(
        *(keep or []),
        text_counts(full).alias("c"),
        F.size(F.array_distinct(words_of(full))).alias("n_distinct"),
        *(F.length(F.regexp_replace(full, others, "")).alias(name) for name, others in CHARACTERS.items()),
    )
    flat = counts.select(*(keep or []), "c.*", "n_distinct", *CHARACTERS)
    return flat.select(*(keep or []), *(F.expr(e).cast("double").alias(name) for name, e in STATISTICS.items()))


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """Every path of the trees in a model's description, as conditions (statistic, comparison, threshold)."""
    rules, path = {}, []
    for line in description.splitlines():
        branch = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if "Tree" in line:
            path = []
        if branch:
            depth = len(branch[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(branch[3])], branch[4], float(branch[5])))]
            rules[tuple(sorted(condition for _, condition in path))] = None
    return list(rules)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, comparison, limit in rule:
        out = out & (F.col(name) <= limit if comparison == "<=" else F.col(name) > limit)
    return out


def fit_rules(rows: DataFrame, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Rows hold the statistics and `label`."""
    rows = cut_lineage(rows.select("label", *names), "rule-training")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < positive < n:
        share = (positive + 1) / (n + 2)
        return RuleModel(float(math.log(share / (1 - share))), {})
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", seed=SEED).fit(vectors)
    rules = tree_rules(forest.toDebugString, names)
    if not rules:
        share = (positive + 1) / (n + 2)
        return RuleModel(float(math.log(share / (1 - share))), {})
    flags = [f"r{i}" for i in range(len(rules))]
    indicators = rows.select("label", *(holds(r).cast("double").alias(f) for r, f in zip(rules, flags, strict=True)))
    indicators = VectorAssembler(inputCols=flags, outputCol="features").transform(indicators).select("label", "features")
    fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(indicators)
    weights = {rule: float(w) for rule, w in zip(rules, fit.coefficients, strict=True) if abs(w) > 1e-9}
    return RuleModel(float(fit.intercept), weights)


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns of each document and `score`; `doc_id` names the documents of `labels`."""
    names = list(STATISTICS)
    rows = cut_lineage(statistics(docs, keep=list(dict.fromkeys(["doc_id", *keep]))), "statistics")
    model = fit_rules(rows.join(training_labels(labels, "quality"), "doc_id"), names)
    return rows.select(*keep, model.score().alias("score"))


@query("op2_rule_ensemble")
def rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
