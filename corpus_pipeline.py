"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as Parquet and read again as the next one's docs.
All stages but the last return the columns of the documents as they came, extra ones included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, decontaminate, minhash, rule_ensemble, secrets
from tagloom.llm.registry import table
from tagloom.session import broadcast_if_fits, cut_lineage


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row in one column, so that no other column can clash with what a stage adds."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold stay. Labels come from the table; empty texts are scored like others."""
    scored = rule_ensemble.score_quality(_packed(docs), table(spark, sf_dir, "labels"), ["row"])
    return scored.filter(F.col("score") >= rule_ensemble.THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; rows without an id and documents without words stay."""
    verdicts = minhash.near_duplicates(docs.select("doc_id", "text"))
    dropped = cut_lineage(verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    return docs.join(broadcast_if_fits(dropped), F.col("doc_id") == F.col("dropped_id"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in its words or with other values, go."""
    leaks = cut_lineage(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), "leaks")
    return decontaminate.without(docs, leaks)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and access identifiers are masked, and n_chars follows the text; nulls stay null."""
    found = secrets.find_secrets(_packed(docs), keep=["row"])
    clean = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(secrets.redact(F.col("row.text"), F.col("spans")))
    masked = found.select(F.col("row").withField("text", clean).alias("row"), F.size("spans").alias("n"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n") == 0, F.col("row.n_chars")).otherwise(F.length("row.text").cast(docs.schema["n_chars"].dataType))
        masked = masked.select(F.col("row").withField("n_chars", n_chars).alias("row"))
    return masked.select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding the ids gives the text back; a null text has no ids."""
    path = public_tokenizers.path(bpe.DEFAULT_RANKS)
    coded = bpe.decode_documents(bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), path), path)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", byte_bpe),
]

# Trained scores and merges are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
