"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word stands for two units, itself and its ending, each hashed to a bucket.
A unit's vector is the sum of sparse random index vectors of the endings next to
it, over the whole corpus, turned by one place for what comes before.  Documents
pool their words' vectors; a small numpy network scores them, its probabilities
calibrated by a temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan.llm.frames import ascii_words, mapped, numbered, picked, place, ship, slices, texts
from idlespan.llm.labelled import log_loss, sampled, sigmoid

#: Size of a vector; buckets of words and of endings.
DIMENSIONS, WORDS, ENDINGS = 32, 1 << 13, 1 << 12
UNITS = WORDS + ENDINGS
#: Labelled rows that the network is trained on at most, by hash of their ids.
SAMPLE = 20_000
#: Words that are pooled together.
_BLOCK = 1 << 17


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each text's words; each word's bucket; its ending's bucket (from ``WORDS`` on)."""
    offsets, words = ascii_words(column)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    digest = xxhash.xxh32_intdigest
    word = np.array([digest(w) % WORDS for w in coded.dictionary.to_pylist()], dtype=np.int32)
    tails = pc.utf8_slice_codeunits(coded.dictionary, -3, None).dictionary_encode()
    ending = np.array([digest(w) % ENDINGS + WORDS for w in tails.dictionary.to_pylist()], dtype=np.int32)
    return offsets, word[codes], ending[tails.indices.to_numpy(zero_copy_only=False)][codes]


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs for each unit, by a fixed rule."""
    draw = np.random.default_rng(20240607)
    return draw.integers(0, DIMENSIONS, (UNITS, 2)), draw.choice([-1, 1], (UNITS, 2))


def word_vectors(df: DataFrame, *, text: str = "text") -> DataFrame:
    """(unit, v0, v1, ...): sums of index vectors of all neighbours of each unit, over every word of every text.

    Each task adds up its own texts and gives at most ``UNITS`` rows, so what is
    shuffled does not grow with the length of texts.  Null counts as empty.
    """
    ship(df.sparkSession)
    at, plain = place(df, text), numbered(df)
    names = [f"v{i}" for i in range(DIMENSIONS)]
    schema = T.StructType([T.StructField("unit", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches):
        places, signs = _index_vectors()
        total = np.zeros(UNITS * DIMENSIONS)
        for batch in slices(batches, at):
            offsets, word, ending = _units(texts(batch, at))
            inside = np.ones(max(len(word) - 1, 0), bool)
            inside[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(word))] - 1] = False
            left = np.flatnonzero(inside)
            for own, context, turn in ((left + 1, left, 1), (left, left + 1, 0)):
                near = ending[context]
                for k in range(2):
                    dimension, sign = (places[near, k] + turn) % DIMENSIONS, signs[near, k]
                    for unit in (word[own], ending[own]):
                        total += np.bincount(unit * DIMENSIONS + dimension, weights=sign, minlength=len(total))
        table = total.reshape(UNITS, DIMENSIONS).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *[pa.array(table[used, i]) for i in range(DIMENSIONS)]], schema.names)

    return plain.mapInArrow(run, schema).groupBy("unit").agg(*[F.sum(n).alias(n) for n in names])


def vector_table(vectors: DataFrame) -> np.ndarray:
    """The vectors as one array of fixed size (1.5 MB), each of length one; zeros for units never seen."""
    found = vectors.toArrow()
    table = np.zeros((UNITS, DIMENSIONS), dtype=np.float32)
    if found.num_rows:
        sums = np.stack([found.column(i + 1).to_numpy() for i in range(DIMENSIONS)], axis=1).astype(np.float64)
        table[found.column(0).to_numpy()] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return table


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its words' vectors, how far neighbours differ, and the log of its words."""
    offsets, word, ending = _units(column)
    counts = np.diff(offsets)
    out = np.zeros((len(column), 3 * DIMENSIONS + 2), dtype=np.float32)
    out[:, -2] = np.log1p(counts) / 10
    before = np.ones(len(word), bool)
    before[offsets[:-1][counts > 0]] = False
    same = before.copy()
    same[1:] &= word[1:] == word[:-1]
    owner = np.repeat(np.arange(len(column)), counts)
    sums = np.zeros((3, len(column), DIMENSIONS), dtype=np.float64)
    for begin in range(0, len(word), _BLOCK):
        # One word more on the left, for the difference at the border.
        low = max(begin - 1, 0)
        vectors = table[word[low:begin + _BLOCK]] + table[ending[low:begin + _BLOCK]]
        own = owner[begin:begin + _BLOCK]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        here = vectors[begin - low:]
        sums[0, own[heads]] += np.add.reduceat(here, heads, axis=0)
        sums[1, own[heads]] += np.add.reduceat(here * here, heads, axis=0)
        steps = np.zeros_like(here)
        steps[low == begin:] = np.abs(np.diff(vectors, axis=0))
        steps *= before[begin:begin + _BLOCK, None]
        sums[2, own[heads]] += np.add.reduceat(steps, heads, axis=0)
    sums /= np.maximum(counts, 1)[None, :, None]
    mean = sums[0]
    out[:, :DIMENSIONS] = mean
    out[:, DIMENSIONS:2 * DIMENSIONS] = np.sqrt(np.maximum(sums[1] - mean ** 2, 0))
    out[:, 2 * DIMENSIONS:3 * DIMENSIONS] = sums[2]
    out[:, -1] = np.bincount(owner[same], minlength=len(column)) / np.maximum(counts, 1)
    return out


@dataclass
class Network:
    """Two layers; ``temperature`` divides the logit."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 7) -> Network:
    """Fit by Adam on four fifths, then the temperature on the last fifth (the rows' order must carry nothing).

    Without rows of both classes the score is their share (one half without rows).
    """
    width = x.shape[1]
    draw = np.random.default_rng(seed)
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        net.b2 = float(np.log(share / (1 - share)))
        return net
    order = draw.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    net.shift, net.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - net.shift) / net.scale
    cut = max(1, len(y) * 4 // 5)
    parameters = [draw.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden),
                  draw.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(epochs):
        rows = draw.permutation(cut)
        for begin in range(0, cut, 128):
            own = rows[begin:begin + 128]
            inner = z[own] @ parameters[0] + parameters[1]
            active = np.maximum(inner, 0)
            error = (sigmoid(active @ parameters[2] + parameters[3]) - y[own]) / len(own)
            back = np.outer(error, parameters[2]) * (inner > 0)
            gradients = [z[own].T @ back + 1e-4 * parameters[0], back.sum(axis=0),
                         active.T @ error + 1e-4 * parameters[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(parameters, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parameters[0], parameters[1], parameters[2], float(parameters[3][0])
    late = net.logits(x[cut:])
    if len(late):
        choices = np.geomspace(0.25, 8, 61)
        net.temperature = float(choices[np.argmin([log_loss(late / t, y[cut:]) for t in choices])])
    return net


@dataclass
class QualityModel:
    table: np.ndarray
    network: Network

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.network.scores(pooled(column, self.table))


def fit(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Vectors from all of ``documents``, the network from at most ``sample`` labelled rows that are not held out.

    Runs two jobs over ``documents``.  The driver gets the vectors (fixed size) and
    one pooled vector per row of the sample.
    """
    rows = picked(documents, doc_id=doc_id, text=text)
    table = vector_table(word_vectors(rows))
    sent = documents.sparkSession.sparkContext.broadcast(table)
    chosen = rows.join(sampled(labels, doc_id, label, sample), "doc_id").select("doc_id", "label", "text")

    def work():
        def run(column):
            found = pooled(column, sent.value)
            return [pa.FixedSizeListArray.from_arrays(found.ravel(), found.shape[1]).cast(pa.list_(pa.float32()))]

        return run

    found = mapped(chosen, "text", [T.StructField("x", T.ArrayType(T.FloatType()))], work).select(
        "c0", "c1", "x").toArrow().sort_by("c0")
    x = found["x"].combine_chunks()
    x = x.flatten().to_numpy().reshape(len(found), -1) if len(found) else np.zeros((0, 3 * DIMENSIONS + 2))
    return QualityModel(table, train(x, found["c1"].to_numpy()))


def scored(df: DataFrame, model, *, text: str = "text") -> DataFrame:
    """``df`` by position (c0, ...) with ``score``, from 0 to 1, of each whole text; nothing is shuffled.

    Null and empty texts get the score of a text without words.  ``model`` is
    anything with ``scores(texts)``.
    """
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    return mapped(df, text, [T.StructField("score", T.DoubleType())],
                  lambda: lambda column: [pa.array(sent.value.scores(column).astype(np.float64))])
