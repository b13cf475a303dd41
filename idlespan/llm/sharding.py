"""A uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, as a
uniform permutation of all rows would have it.  Partitions then deal their rows
out in a random order, rows are exchanged, and a second random order is taken
where they arrive, in as many blocks a shard as its size asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan.llm.frames import numbered, ship
from idlespan.session import written

#: Rows that one block of a shard holds on average at most; each block is ordered by one task.
BLOCK_ROWS = 1 << 16
#: Rows dealt out together, and populations from which numpy draws itself.
_DEALT, _NUMPY_LIMIT = 1 << 14, 10 ** 9

_PLACE = [T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()),
          T.StructField("draw", T.LongType()), T.StructField("nth", T.LongType())]


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard: at most one apart, the first shards the larger."""
    return (rows // shards + (np.arange(shards) < rows % shards)).astype(np.int64)


def hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` items drawn without replacement are good; exact for populations of any size.

    Beyond numpy's limit every item is taken with about the wanted chance, which two
    binomial draws count.  Taken items are a uniform set of their number; the few
    that are too many are taken out, or the few missing added, by the same rule.
    """
    if good + bad < _NUMPY_LIMIT:
        return int(draw.hypergeometric(good, bad, sample))
    if sample <= 64:
        found = 0
        for i in range(sample):
            found += int(draw.integers(good + bad - i)) < good - found
        return found
    chance = sample / (good + bad)
    taken, others = int(draw.binomial(good, chance)), int(draw.binomial(bad, chance))
    extra = taken + others - sample
    if extra > 0:
        return taken - hypergeometric(draw, taken, others, extra)
    return taken + hypergeometric(draw, good - taken, bad - others, -extra)


def split(draw: np.random.Generator, colours: np.ndarray, sample: int) -> np.ndarray:
    """How many of each colour are among ``sample`` items drawn without replacement."""
    out, rest = np.zeros(len(colours), dtype=np.int64), int(colours.sum())
    for i, n in enumerate(colours.tolist()):
        rest -= n
        out[i] = hypergeometric(draw, n, rest, sample)
        sample -= int(out[i])
    return out


@dataclass(frozen=True)
class Matrix:
    """The communication matrix; each task draws its own row.

    ``before[p]`` is how many rows stand before partition p (and at the end all),
    ``sizes`` the shards' rows.  Partitions are the leaves of a binary tree.  At each
    node the shards' shares of the node's rows are split between its halves by a
    multivariate hypergeometric draw that the node alone seeds, so that a task walks
    from the root to its partition and all tasks agree.
    """

    before: np.ndarray
    sizes: np.ndarray
    parts: int
    seed: int

    def row(self, partition: int) -> np.ndarray:
        """How many rows of ``partition`` go to each shard."""
        begin, end, share = 0, len(self.before) - 1, self.sizes
        if partition >= end:
            return np.zeros(len(self.sizes), dtype=np.int64)
        while end - begin > 1:
            middle = (begin + end) // 2
            left = split(np.random.default_rng([self.seed, 1, begin, end]), share,
                         int(self.before[middle] - self.before[begin]))
            begin, end, share = (begin, middle, left) if partition < middle else (middle, end, share - left)
        return share

    def deals(self, partition: int):
        """(shard, block, draw) arrays for the partition's rows in their order, some thousand rows at a time."""
        left = self.row(partition)
        draw = np.random.default_rng([self.seed, 2, partition])
        while n := int(min(_DEALT, left.sum())):
            take = split(draw, left, n)
            left = left - take
            shard = draw.permutation(np.repeat(np.arange(len(take)), take))
            yield shard, shard * self.parts + draw.integers(self.parts, size=n), draw.integers(1 << 63, size=n)


def _dealt(matrix):
    """Task: each row gets the next place that its partition deals out."""
    def run(batches):
        deals, held, nth = matrix.value.deals(TaskContext.get().partitionId()), None, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if held is None or not len(held[0]):
                    held = next(deals, None)
                    if held is None:
                        raise RuntimeError("a partition has more rows than were counted: store the rows before sharding")
                n = min(len(held[0]), batch.num_rows - at)
                some, (shard, block, draw) = batch.slice(at, n), [h[:n] for h in held]
                held = [h[n:] for h in held]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(draw, pa.int64()),
                     pa.array(np.arange(nth, nth + n), pa.int64())],
                    [*some.schema.names, *[f.name for f in _PLACE]])
                at, nth = at + n, nth + n
        if (held is not None and len(held[0])) or next(deals, None) is not None:
            raise RuntimeError("a partition has fewer rows than were counted: store the rows before sharding")

    return run


def _block_counts(matrix):
    """Task: rows that each partition deals to each block, drawn again without reading a row."""
    def run(batches):
        for batch in batches:
            for partition in batch.column(0).to_pylist():
                for _, block, _ in matrix.value.deals(partition):
                    blocks, n = np.unique(block, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(n, pa.int64())], ["block", "n"])

    return run


def sharded(df: DataFrame, shards: int, *, seed: int = 17, block_rows: int = BLOCK_ROWS, store: bool = True) -> DataFrame:
    """``df``'s rows by position (c0, c1, ...) with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Every way of dealing the rows into shards of these sizes, and every order in a
    shard, is equally likely, whatever the rows hold: nulls, empty and very long
    texts, ties and repeated rows are rows like others.  Sizes are at most one
    apart; with fewer rows than shards some shards stay empty.  An empty table gives
    an empty table.  Names of ``df`` may clash with anything.

    Runs jobs.  Rows are counted per partition (one number each comes to the driver),
    read again, moved once, and sorted by a random number in blocks of some
    ``block_rows``.  Tasks that run again must see the same rows in the same order:
    ``store`` writes them to the shared folder first; leave it off for a table that
    is read from files anyway.  A task whose rows are not as counted fails.
    """
    if shards < 1 or block_rows < 1:
        raise ValueError("shards and block_rows are at least 1")
    spark = df.sparkSession
    ship(spark)
    rows = written(numbered(df)) if store else numbered(df)
    counted = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    per_part = np.zeros(1 + max((r.part for r in counted), default=0), dtype=np.int64)
    for r in counted:
        per_part[r.part] = r.n
    sizes = shard_sizes(int(per_part.sum()), shards)
    parts = max(1, -(-int(sizes.max()) // block_rows))
    matrix = spark.sparkContext.broadcast(Matrix(np.concatenate([[0], np.cumsum(per_part)]), sizes, parts, seed))

    counts = spark.range(len(per_part)).mapInArrow(_block_counts(matrix), "block long, n long").groupBy("block").agg(
        F.sum("n").alias("n"))
    in_shard = W.partitionBy(F.expr(f"block div {parts}")).orderBy("block")
    first = written(counts.select("block", (F.sum("n").over(in_shard) - F.col("n")).alias("first")))

    dealt = rows.withColumn("part", F.spark_partition_id()).mapInArrow(
        _dealt(matrix), T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), *_PLACE]))
    place = F.row_number().over(W.partitionBy("block").orderBy("draw", "part", "nth")).cast("long") - 1
    return dealt.withColumn("place", place).join(first, "block").select(
        *rows.columns, "shard", (F.col("first") + F.col("place")).alias("slot"))
