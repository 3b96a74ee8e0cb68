"""Bounded samples of labelled documents to train on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.stats import FEATURES, counts
from plumbline.llm.text import WordHashes, map_texts


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def _features(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of chosen documents (``_id, _label``), a bounded number of rows.

    Of several rows with one id the smallest features count, so the order of rows does not.
    """
    hashes = WordHashes()

    def run(batch) -> dict:
        found = [counts(t, hashes)[1] for t in batch.column("_text").to_pylist()]
        return {"id": batch.column("id"), "label": batch.column("label"), "features": found}

    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.select(F.col("_id").cast("string").alias("id"), F.col("_label").cast("int").alias("label"), "_text")
    rows = map_texts(rows, "_text", run, "id string, label int, features array<double>")
    rows = rows.groupBy("id", "label").agg(F.min("features").alias("features"))
    found = sorted((tuple(r["features"]), r["label"]) for r in rows.collect())
    x = np.array([f for f, _ in found], np.float64).reshape(len(found), len(FEATURES))
    return x, np.array([y for _, y in found], np.int64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, allowed: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled documents, those with the smallest hash of their id.

    Of several labels of one document the largest counts; null labels and ids do not.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("_label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("_id"), "_label")
    return _features(docs, rows)
