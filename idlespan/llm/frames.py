"""Columns by role, rows numbered and stored, and work on text in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan.session import ship

#: Ids that are sent to every executor at most; some 100 MB there.
BROADCAST_IDS = 4_000_000
#: Bytes of text that a Python worker looks at together.
SLICE_BYTES = 6 << 20


def place(df: DataFrame, name: str) -> int:
    """Where column ``name`` stands: the exact name first, then any letter case; an error if there is none."""
    same = [i for i, c in enumerate(df.columns) if c == name] or [
        i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns named c0, c1, ...: names cannot clash with what is added."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def picked(df: DataFrame, **roles: str) -> DataFrame:
    """Only the columns of the given roles, named by role; every other column goes.

    ``picked(df, doc_id="id")`` takes column ``id`` as ``doc_id``.  Clashing names
    elsewhere in ``df`` do no harm.
    """
    plain = numbered(df)
    return plain.select(*[F.col(f"c{place(df, name)}").alias(role) for role, name in roles.items()])


def small(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for broadcast if it is counted to hold at most ``BROADCAST_IDS``; else as it is.

    Beyond that a join with it shuffles both sides.
    """
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``most`` bytes of text, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        blocks = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(begin, end - begin)


def texts(batch: pa.RecordBatch, column: str | int) -> pa.Array:
    """The column as strings, null as the empty string."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def ascii_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: offsets of each row's words, and all words."""
    parts = pc.ascii_split_whitespace(column)
    offsets, values = parts.offsets.to_numpy().astype(np.int64), parts.values
    values, offsets = values[offsets[0]:offsets[-1]], offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return before[offsets], values.filter(full)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def mapped(df: DataFrame, text: str, fields: list[T.StructField],
           work: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``df`` by position (c0, c1, ...) with the columns that ``work`` makes of its text.

    ``work()`` runs once in a task and returns the function from a slice of texts
    (null as empty) to the new columns.
    """
    ship(df.sparkSession)
    at, plain = place(df, text), numbered(df)
    schema = T.StructType([*plain.schema.fields, *fields])

    def run(batches):
        function = work()
        for batch in slices(batches, at):
            made = function(texts(batch, at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *[f.name for f in fields]])

    return plain.mapInArrow(run, schema)
