"""Batch and streaming jobs over tagged-note corpora, written as PySpark DataFrame plans."""
