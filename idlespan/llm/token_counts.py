"""Token counts kept by deltas: signed changes update additive totals, each batch once.

A batch is a table of changes: documents that came (values after), went (values
before) or were counted anew (both).  Its signed sums by source, language and
tokenizer version are stored under the batch's name, and a commit record is
written last.  Totals are the sums of all committed batches, so a batch that is
replayed, whole or after a crash, counts once.  A snapshot adds up what was
committed so far, so that totals read it and the batches after it only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan.llm import bpe
from idlespan.llm.frames import mapped, picked
from idlespan.llm.packing import WordEncoder

KEYS = ("source", "lang", "tokenizer")
_DELTA = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("documents", T.LongType()),
                       T.StructField("tokens", T.LongType()), T.StructField("part", T.StringType())])
_COMMIT = T.StructType([T.StructField("batch", T.StringType()), T.StructField("part", T.StringType())])


def inserted(counts: DataFrame) -> DataFrame:
    """Changes of documents that came: (source, lang, tokenizer, n_tokens) counted in."""
    return _signed(counts, 1)


def deleted(counts: DataFrame) -> DataFrame:
    """Changes of documents that went, with the values they were counted with."""
    return _signed(counts, -1)


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of documents that were counted anew, maybe under other keys: the old values out, the new ones in."""
    return deleted(before).unionByName(inserted(after))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    rows = picked(counts, source="source", lang="lang", tokenizer="tokenizer", n_tokens="n_tokens")
    return rows.withColumn("sign", F.lit(sign))


class Rollup:
    """Totals below one shared folder, which all writers and readers reach.

    One writer at a time commits to a rollup; batches may be replayed at will.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _marked(self, name: str) -> list[str]:
        """Folders below ``name`` that were written to the end: those with a success mark, which is written last."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(status.getPath().getParent().getName() for status in found or [])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch's signed changes (``inserted``, ``deleted``, ``revised``, or unions of them).

        Returns False, and does nothing, if a batch of that name is committed.  What
        an unfinished attempt left is overwritten.  Null keys are keys of their own, a
        null count is zero.  Sums are taken before rows are shuffled, so a hot source
        does no harm.
        """
        part = hashlib.sha256(batch.encode()).hexdigest()[:32]
        if part in self._marked("commits"):
            return False
        sums = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("documents"),
            F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("tokens"))
        sums.withColumn("part", F.lit(part)).write.mode("overwrite").parquet(f"{self.folder}/deltas/{part}")
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(part).alias("part")).write.mode("overwrite").parquet(
            f"{self.folder}/commits/{part}")
        return True

    def _read(self, name: str, parts: list[str], schema: T.StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}/{part}" for part in parts])

    def batches(self) -> DataFrame:
        """Names of the committed batches."""
        return self._read("commits", self._marked("commits"), _COMMIT).select("batch")

    def _since(self) -> tuple[DataFrame, list[str]]:
        """Sums of the newest whole snapshot, and the committed batches that it does not hold."""
        held = self._marked("snapshot_parts")[-1:]
        inside = {r.part for r in self._read("snapshot_parts", held, _COMMIT).select("part").collect()}
        return self._read("snapshots", held, _DELTA), [p for p in self._marked("commits") if p not in inside]

    def _sums(self) -> DataFrame:
        snapshot, later = self._since()
        return snapshot.unionByName(self._read("deltas", later, _DELTA)).groupBy(*KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def compact(self) -> None:
        """Add up all that is committed, so that totals read one table and later batches.

        The list of batches in a snapshot is written last; one that was not finished
        counts for nothing, and the next attempt writes over it.  Old deltas and
        snapshots stay where they are.
        """
        parts = self._marked("commits")
        number = f"{len(self._marked('snapshot_parts')) + 1:08d}"
        self._sums().withColumn("part", F.lit(number)).write.mode("overwrite").parquet(f"{self.folder}/snapshots/{number}")
        self._read("commits", parts, _COMMIT).write.mode("overwrite").parquet(f"{self.folder}/snapshot_parts/{number}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) over all committed batches; keys whose sums are both zero are left out."""
        return self._sums().where("documents <> 0 OR tokens <> 0")


_COUNT = [T.StructField("n_tokens", T.LongType())]


def byte_bpe_counts(df: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """``df`` by position (c0, c1, ...) with ``n_tokens``: ids of the byte-level vocabulary in that file, null text has none."""
    tables = bpe.vocabulary(vocabulary)
    return bpe.encode(df, tables, text=text).withColumn("n_tokens", F.size("ids").cast("long")).drop("ids")


def word_bpe_counts(df: DataFrame, vocabulary: str, *, text: str = "text") -> DataFrame:
    """``df`` by position (c0, c1, ...) with ``n_tokens``: ids of the word-level vocabulary in that file, null text has none."""
    with open(vocabulary, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def work():
        encoder = WordEncoder(sent.value)
        # The end of a text is not one of its tokens.
        return lambda column: [pa.array((encoder(column, 1)[1] - 1).astype(np.int64))]

    return mapped(df, text, _COUNT, work)
