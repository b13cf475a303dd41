"""A corpus from raw documents to packed sequences: every stage is one operator of ``idlespan.llm``.

Stages filter whole rows and keep their columns; the last packs what is left.
Each stage's result is written and read again before the next begins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idlespan.llm import exact_dedup, packing, quality_model, simhash, toxicity
from idlespan.llm.frames import picked
from idlespan.session import written

#: A document whose quality score is lower goes; one whose toxicity score is as high goes.
QUALITY, TOXIC = 0.3, 0.5


def _kept(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns that an operator numbered, under their own names again."""
    return found.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled documents among these, does not reject."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(quality_model.scored(docs, model).where(F.col("score") >= QUALITY), docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(quality_model.scored(docs, model).where(F.col("score") < TOXIC), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return _kept(exact_dedup.exact_duplicates(docs).where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near-duplicates."""
    return _kept(simhash.near_duplicates(docs).where("kept"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, piece_ids, doc_tokens, sequence_id, offset."""
    rows = picked(docs, doc_id="doc_id", text="text")
    pieces = packing.pack_texts(rows, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("c0").alias("doc_id"), "start", "length", "piece_ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("toxicity", non_toxic), ("exact dedup", exact),
          ("SimHash near-dedup", near), ("packing", packed)]

#: SQL can express neither the classifiers nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
