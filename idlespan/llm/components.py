"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlespan.session import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    least = _least(edges)
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.withColumnRenamed("least", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that some edge (a, b) touches; root is its component's least node.

    Runs jobs: each round stores its edges in the shared folder and reads them back,
    so lineage stays short and lost executors cost a re-read.  Minima are taken
    before rows are shuffled, so a node with very many edges does no harm.  The
    number of rounds grows with the logarithm of a component's length.  Nulls and
    loops are left out.
    """
    kept = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = written(kept)
    mark = None
    while True:
        found = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
        kept = written(_small_star(_large_star(kept)))
    return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        kept.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
