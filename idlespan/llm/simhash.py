"""SimHash near-duplicates by meeting in the middle.

Two fingerprints that differ in at most 2r bits have a common variant within r
bits of both.  Every different fingerprint emits its variants, equal variants
meet in one shuffle, and colliding pairs are verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan.llm.components import components
from idlespan.llm.frames import mapped, place
from idlespan.session import written

#: Shingles whose bits are counted together.
_SHINGLES = 1 << 18


def _joined_words(column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with one blank between words, where each word begins and ends there, and the words before each text."""
    edges = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[edges[0]:edges[-1]].copy()
    edges = edges - edges[0]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    data[space] = 32
    data[(data >= 65) & (data <= 90)] |= 32
    full = edges[:-1] < edges[1:]
    after_space, before_space = np.roll(space, 1), np.roll(space, -1)
    after_space[edges[:-1][full]] = True
    before_space[edges[1:][full] - 1] = True
    begins = ~space & after_space
    keep = ~space | ~after_space
    place = np.cumsum(keep) - 1
    words = np.concatenate([[0], np.cumsum(begins)])
    return data[keep].tobytes(), place[begins], place[~space & before_space] + 1, words[edges]


def fingerprints_of(column: pa.Array, words: int, seed: int) -> np.ndarray:
    """64-bit SimHash of each text, as signed numbers.

    ASCII letters count as lower case, shingles are ``words`` words joined by a
    blank, all of a shorter text; a bit is set if it is in over half of the hashes.
    """
    joined, starts, ends, offsets = _joined_words(column)
    counts = np.diff(offsets)
    per_text = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    out = np.zeros(len(column), dtype=np.uint64)
    full = np.flatnonzero(per_text)
    digest, begin = xxhash.xxh64_intdigest, 0
    sums = np.concatenate([[0], np.cumsum(per_text[full])])
    while begin < len(full):
        end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + _SHINGLES, "right")) - 1)
        ones = np.zeros((end - begin, 64), dtype=np.int64)
        # One very long text alone is counted piece by piece.
        total = int(sums[end] - sums[begin])
        owner = np.repeat(np.arange(end - begin), per_text[full[begin:end]])
        first = np.arange(total) - np.repeat(sums[begin:end] - sums[begin], per_text[full[begin:end]])
        first += np.repeat(offsets[full[begin:end]], per_text[full[begin:end]])
        last = np.minimum(first + words, np.repeat(offsets[full[begin:end] + 1], per_text[full[begin:end]])) - 1
        for piece in range(0, total, _SHINGLES):
            part = slice(piece, piece + _SHINGLES)
            hashes = np.array([digest(joined[a:b], seed) for a, b in zip(
                starts[first[part]].tolist(), ends[last[part]].tolist())], dtype=">u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
            own = owner[part]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            ones[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        set_bits = 2 * ones > per_text[full[begin:end], None]
        out[full[begin:end]] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
        begin = end
    return out.view(np.int64)


def with_fingerprint(df: DataFrame, *, text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``df`` by position (c0, c1, ...) with ``fingerprint`` (bigint); a text without words has 0."""
    def work():
        return lambda column: [pa.array(fingerprints_of(column, words, seed), pa.int64())]

    return mapped(df, text, [T.StructField("fingerprint", T.LongType())], work)


def near_pairs(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Verified pairs (a, b), a > b, that link all fingerprints within ``bits`` bits of each other.

    ``distinct`` holds each ``fingerprint`` once.  With an even ``bits`` all that
    share a variant are within reach of each other, so it is enough to pair each
    with the least of them: every close pair is linked directly or over that one.
    A variant has at most as many owners as one fingerprint has variants.
    """
    if bits < 0 or bits % 2:
        raise ValueError("bits is even")
    flips = [0]
    for n in range(1, bits // 2 + 1):
        flips += [sum(1 << b for b in chosen) for chosen in combinations(range(64), n)]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    variants = distinct.select("fingerprint", F.explode(F.transform(
        F.array(*map(F.lit, signed)), lambda flip: F.col("fingerprint").bitwiseXOR(flip))).alias("variant"))
    least = F.min("fingerprint").over(W.partitionBy("variant"))
    pairs = variants.select(F.col("fingerprint").alias("a"), least.alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3,
                    bits: int = 2, keep_text: bool = True) -> DataFrame:
    """``df``'s rows by position (c0, ...; the text only if ``keep_text``), with
    ``row_id, fingerprint, component_id, kept``.

    Fingerprints within ``bits`` differing bits are linked; ``component_id`` is the
    least doc_id that links reach, itself included, and ``kept`` marks the one row
    of each component that has it (the first by ``row_id`` if rows repeat).  Null
    ids come after all others and give a null component if there is nothing else.
    Null, empty and blank texts have fingerprint zero, linked like any other.  An
    empty table gives an empty table.

    Runs jobs.  Rows go to the shared folder once, with their fingerprints; from
    then on only (fingerprint, least id) is shuffled, each fingerprint once, so
    copies cost nothing.
    """
    at = f"c{place(df, doc_id)}"
    marked = with_fingerprint(df, text=text, words=words).withColumn("row_id", F.monotonically_increasing_id())
    rows = written(marked if keep_text else marked.drop(f"c{place(df, text)}"))
    first = F.min(F.struct(F.col(at).isNull().alias("last"), F.col(at).alias("doc_id"), "row_id"))
    heads = written(rows.groupBy("fingerprint").agg(first.alias("head")))
    roots = components(near_pairs(heads.select("fingerprint"), bits)).withColumnRenamed("node", "fingerprint")
    rooted = heads.join(roots, "fingerprint", "left").select(
        "fingerprint", "head", F.coalesce("root", "fingerprint").alias("root"))
    best = rooted.groupBy("root").agg(F.min("head").alias("best"))
    owners = written(rooted.join(best, "root").select("fingerprint", "best"))
    return rows.join(owners, "fingerprint").select(
        *[c for c in rows.columns if c not in ("fingerprint", "row_id")], "row_id", "fingerprint",
        F.col("best.doc_id").alias("component_id"), (F.col("row_id") == F.col("best.row_id")).alias("kept"))
