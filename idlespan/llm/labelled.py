"""Labelled rows for training, held-out rows, and small numpy helpers of the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan.llm.frames import picked


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text divides by 5.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled(labels: DataFrame, doc_id: str, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` rows for training, by hash of the id alone, so classes keep their shares.

    Rows without an id or with a label other than 0 and 1 are left out; of several
    labels for one id the largest counts.  Names of other columns may clash.  The bound
    makes it safe to broadcast.
    """
    usable = picked(labels, doc_id=doc_id, label=label).withColumn("label", F.col("label").cast("int")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    single = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    return F.broadcast(single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def log_loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, logits) - labels * logits))
