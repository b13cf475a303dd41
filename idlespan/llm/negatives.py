"""Hard negatives by exact scores: matrix products modulo small primes, put together by Chinese remaindering.

Vectors are whole numbers after scaling.  Residues modulo primes below 1024 are
small enough for a float32 matrix product over 64 components to be exact; the
products modulo several primes give back the exact signed score.  Anchors and
rows meet block by block, so each task holds two bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idlespan.llm.frames import picked, ship
from idlespan.session import written

#: Rows and anchors of one block at most, on average: what a task holds.
BLOCK_ROWS, BLOCK_ANCHORS = 1 << 17, 1 << 14
#: Cells of a score matrix that are looked at together.
_CELLS = 1 << 21
#: Components of one float32 product; 64 * 512 ** 2 = 2 ** 24 is the last number up to which float32 counts whole.
_DEPTH, _PRIMES = 64, (1021, 1019, 1013, 1009, 997, 991)
_NONE = np.iinfo(np.int64).min


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as scores from -``bound`` to ``bound`` need to differ modulo their product."""
    product, chosen = 1, []
    for p in _PRIMES:
        chosen.append(p)
        product *= p
        if product > 2 * bound + 1:
            return tuple(chosen)
    raise ValueError(f"scores up to {bound} are too large: their bound is {(product - 1) // 2}")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo ``p`` around zero, as float32."""
    return ((x + p // 2) % p - p // 2).astype(np.float32)


def residues_product(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact ``a @ b.T`` as int64, from both sides' residues modulo each prime."""
    value, product = None, 1
    for p, left, right in zip(primes, a, b):
        found = np.zeros((len(left), len(right)), dtype=np.float32)
        for k in range(0, left.shape[1], _DEPTH):
            part = left[:, k:k + _DEPTH] @ right[:, k:k + _DEPTH].T
            # Whole numbers below 2 ** 24: taking out a multiple of p is exact.
            found += part - np.float32(p) * np.rint(part * np.float32(1 / p))
            found -= np.float32(p) * np.rint(found * np.float32(1 / p))
        residue = found.astype(np.int64)
        if value is None:
            value = residue % p
        else:
            # Mixed radix: the next digit makes the value right modulo p as well.
            value += product * (((residue - value) % p) * pow(product, -1, p) % p)
        product *= p
    return np.where(value > product // 2, value - product, value)


def _matrix(column: pa.ChunkedArray, dims: int, primes: tuple[int, ...]) -> list[np.ndarray]:
    """Stored vectors (int32 bytes, shorter ones filled with zeros) as residues modulo each prime."""
    sizes = pc.binary_length(column).to_numpy().astype(np.int64) // 4
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype="<i4")
    whole = np.zeros((len(sizes), dims), dtype=np.int64)
    whole[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return [centred(whole, p) for p in primes]


def _whole(scale: float):
    """Task: vectors with whole components as packed int32, and their squared length; others are left out."""
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            # A null component becomes NaN, and goes with those that are not finite.
            flat = pc.cast(pc.list_flatten(lists), pa.float64()).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(owner, weights=~np.isfinite(flat), minlength=len(sizes)) == 0
            with np.errstate(all="ignore"):
                whole = np.floor(scale * flat)
                norm = np.bincount(owner, weights=np.where(good[owner], whole * whole, 0.0), minlength=len(sizes))
            if len(norm) and norm.max() >= 2.0 ** 53:
                raise ValueError("components are too large for exact scores")
            safe = np.where(good[owner], whole, 0).astype("<i4")
            ends = np.cumsum(sizes)
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)),
                 pa.array([safe[ends[i] - sizes[i]:ends[i]].tobytes() for i in keep], pa.binary()),
                 pa.array(norm[keep], pa.float64()), pa.array(sizes[keep], pa.int32())],
                ["vec_id", "label", "vector", "norm", "dims"])

    return run


def whole_vectors(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                  scale: float = 256.0, relabel: tuple[int, int] | None = None) -> DataFrame:
    """(vec_id, label, vector, norm, dims) of the rows that take part: ``floor(scale * x)`` of every component.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part.  ``relabel=(m, n)``: where m divides the id, the label
    becomes (label + 1) % n.
    """
    ship(df.sparkSession)
    rows = picked(df, vec_id=vec_id, label=label, vector=vector).where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    said: Column = F.col("label").cast("long")
    if relabel:
        said = F.when(F.col("vec_id") % relabel[0] == 0, (said + 1) % relabel[1]).otherwise(said)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), said.alias("label"), "vector").mapInArrow(
        _whole(scale), "vec_id long, label long, vector binary, norm double, dims int")


def first_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of every row, equal ones by column; cells that hold the least int64 are no cells.

    Changes ``scores``.
    """
    rows, columns, every = [], [], np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        best = scores.argmax(axis=1)
        real = scores[every, best] != _NONE
        if not real.any():
            break
        rows.append(every[real])
        columns.append(best[real])
        scores[every, best] = _NONE
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (none, none)


def _tiles(rows: pa.Table, anchors: pa.Table, dims: int, primes: tuple[int, ...]):
    """Exact scores of a block of anchors with a block of rows, tile by tile: (anchor places, row places, scores)."""
    right, left = _matrix(rows["vector"], dims, primes), _matrix(anchors["vector"], dims, primes)
    wide = max(1, min(len(rows), 1 << 14))
    high = max(1, _CELLS // wide)
    for a in range(0, len(anchors), high):
        for r in range(0, len(rows), wide):
            yield slice(a, a + high), slice(r, r + wide), residues_product(
                [x[a:a + high] for x in left], [x[r:r + wide] for x in right], primes)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


_POSITIVE = "anchor_id bigint, positive_id bigint, positive_score bigint"
_NEGATIVE = _POSITIVE + ", negative_id bigint, negative_score bigint"


def _made(schema: str, parts: list[list[np.ndarray]]) -> pa.Table:
    names = [field.split()[0] for field in schema.split(", ")]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _positives(dims: int, primes: tuple[int, ...], most: int):
    """Block pair: the first ``most`` rows of each anchor's label that are not the anchor."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, parts = rows.sort_by("vec_id"), []
        ids, labels = _columns(rows, "vec_id", "label")
        anchor, own = _columns(anchors, "vec_id", "label")
        for a, r, scores in _tiles(rows, anchors, dims, primes):
            like = (labels[r] == own[a, None]) & (ids[r] != anchor[a, None])
            i, j = first_of(np.where(like, scores, _NONE), most)
            parts.append([anchor[a][i], ids[r][j], scores[i, j]])
        return _made(_POSITIVE, parts)

    return run


def _negatives(dims: int, primes: tuple[int, ...], most: int, low: int, high: int):
    """Block pair: for each anchor and positive the first ``most`` rows of other labels in the window."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, parts = rows.sort_by("vec_id"), []
        ids, labels = _columns(rows, "vec_id", "label")
        anchor, own = _columns(anchors, "vec_id", "label")
        held = anchors["positives"].combine_chunks()
        counts = pc.list_value_length(held).to_numpy()
        positive, score = (x.to_numpy() for x in pc.list_flatten(held).flatten())
        begins = np.cumsum(counts) - counts
        for a, r, scores in _tiles(rows, anchors, dims, primes):
            other = labels[r] != own[a, None]
            for nth in range(int(counts[a].max(initial=0))):
                some = np.flatnonzero(counts[a] > nth)
                at = begins[a][some] + nth
                seen, wanted = scores[some], score[at][:, None]
                inside = other[some] & (low * wanted <= 100 * seen) & (100 * seen <= high * wanted)
                i, j = first_of(np.where(inside, seen, _NONE), most)
                parts.append([anchor[a][some][i], positive[at][i], score[at][i], ids[r][j], seen[i, j]])
        return _made(_NEGATIVE, parts)

    return run


def hard_negatives(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vectors`` of ``whole_vectors``.

    ``anchors`` says which ids ask.  An anchor's positives are its first
    ``positives`` other rows of the same label, by score, ties by smaller id.  For
    each of them the first ``negatives`` rows of other labels are returned for which
    ``low`` * positive score <= 100 * score <= ``high`` * positive score.  Scores are
    whole inner products, exact; shorter vectors count as filled up with zeros.

    Of rows with one id the one with the least label, then vector, counts.  Without
    anchors, other rows or positives the result is empty.  Vectors whose squared
    length reaches 2 ** 53 are an error.

    Runs jobs.  Every pair of an anchor block and a row block is one group, dealt by
    hash of the ids, which are unique, so that a task holds two bounded blocks
    whatever labels or vectors are frequent.  A group gives on a few rows per anchor.
    """
    spark = vectors.sparkSession
    rows = written(vectors.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "norm", "dims")).alias("row")).select(
        "vec_id", "row.*"))
    n_rows, n_anchors, norm, dims = rows.agg(
        F.count(F.lit(1)), F.count_if(anchors), F.max("norm"), F.max("dims")).first()
    # Cauchy and Schwarz: no score is larger than the largest squared length.
    primes = primes_for(int(norm or 0))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(1, -(-n_rows // block_rows), min(width, n_rows // 2048))
    anchor_blocks = max(1, -(-n_anchors // block_anchors))

    def dealt(blocks: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    gridded = rows.select("vec_id", "label", "vector", dealt(row_blocks).alias("row_block"),
                          every(anchor_blocks).alias("anchor_block")).groupBy("row_block", "anchor_block")

    def against(asking: DataFrame, work, schema: str) -> DataFrame:
        copies = asking.select("*", dealt(anchor_blocks).alias("anchor_block"), every(row_blocks).alias("row_block"))
        return gridded.cogroup(copies.groupBy("row_block", "anchor_block")).applyInArrow(work, schema)

    def best(found: DataFrame, by: list[str], score: str, row: str, most: int) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), row))
        return found.withColumn("rank", nth).where(F.col("rank") <= most)

    asking = rows.where(anchors).select("vec_id", "label", "vector")
    found = best(against(asking, _positives(dims or 0, primes, positives), _POSITIVE),
                 ["anchor_id"], "positive_score", "positive_id", positives)
    listed = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))
    # Stored, as the second search begins anew from it.
    armed = written(asking.join(listed, "vec_id"))
    return best(against(armed, _negatives(dims or 0, primes, negatives, low, high), _NEGATIVE),
                ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
