"""Labelled rows for training, with the fold that is kept from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import broadcast_if_fits, cut_lineage

FOLDS = 5
# Labelled rows a classifier is fitted on at most, give or take chance: beyond it, rows are drawn by a hash of their id.
MAX_LABELS = 40_000


def fold(doc_id: Column | str = "doc_id") -> Column:
    """Fold 0 is held out; a null id is in none."""
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS if isinstance(doc_id, str) else F.crc32(doc_id.cast("string")) % FOLDS


def training_labels(labels: DataFrame, column: str, max_rows: int = MAX_LABELS) -> DataFrame:
    """doc_id, label (double), fold: rows of the other folds, one per document (the majority of repeated labels)."""
    known = labels.filter(F.col(column).isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.avg(column).alias("share"))
    known = cut_lineage(known.select("doc_id", (F.col("share") >= 0.5).cast("double").alias("label"), fold().alias("fold")), "labels")
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return broadcast_if_fits(known)
