"""Parts of the classifiers against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from idlespan.llm import quality_model, toxicity
from tests.llm.conftest import ROWS


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def units_of(word):
    digest = xxhash.xxh32_intdigest
    return digest(word) % quality_model.WORDS, digest(word[-3:]) % quality_model.ENDINGS + quality_model.WORDS


def test_word_vectors_are_sums_over_neighbours(spark, odd):
    places, signs = quality_model._index_vectors()
    plain = np.zeros((quality_model.UNITS, quality_model.DIMENSIONS), dtype=np.int64)
    for _, text in ROWS:
        words = words_of(text)
        for left, right in zip(words, words[1:]):
            for own, context, turn in ((right, left, 1), (left, right, 0)):
                near = units_of(context)[1]
                for unit in units_of(own):
                    for k in range(2):
                        plain[unit, (places[near, k] + turn) % quality_model.DIMENSIONS] += signs[near, k]
    found = np.zeros_like(plain)
    for r in quality_model.word_vectors(odd).collect():
        found[r.unit] = r[1:]
    assert (found == plain).all() and plain.any()


def test_pooled_features_by_definition():
    draw = np.random.default_rng(4)
    table = draw.normal(size=(quality_model.UNITS, quality_model.DIMENSIONS)).astype(np.float32)
    texts = [t or "" for _, t in ROWS] + ["same same same other other", "one"]
    made = quality_model.pooled(pa.array(texts, pa.large_string()), table)
    for row, text in zip(made, texts):
        words = words_of(text)
        n = max(len(words), 1)
        vectors = np.array([table[a].astype(np.float64) + table[b] for a, b in map(units_of, words)]).reshape(len(words), quality_model.DIMENSIONS)
        mean = vectors.sum(axis=0) / n
        spread = np.sqrt(np.maximum((vectors ** 2).sum(axis=0) / n - mean ** 2, 0))
        steps = np.abs(np.diff(vectors, axis=0)).sum(axis=0) / n
        again = sum(a == b for a, b in zip(words, words[1:])) / n
        assert np.allclose(row, [*mean, *spread, *steps, np.log1p(len(words)) / 10, again], atol=2e-3)


def test_network_separates_and_is_calibrated():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(3000, 5))
    chance = 1 / (1 + np.exp(-3 * (x[:, 0] * x[:, 1] + 0.5 * x[:, 2])))
    y = (draw.random(3000) < chance).astype(int)
    net = quality_model.train(x, y, epochs=60)
    hidden = np.maximum((x - net.shift) / net.scale @ net.w1 + net.b1, 0)
    scores = 1 / (1 + np.exp(-(hidden @ net.w2 + net.b2) / net.temperature))
    assert np.allclose(scores, net.scores(x))
    assert ((scores >= 0.5) == (chance >= 0.5)).mean() > 0.9
    for low in np.arange(0, 1, 0.25):
        some = (scores >= low) & (scores < low + 0.25)
        assert abs(scores[some].mean() - y[some].mean()) < 0.08


@pytest.fixture(scope="module")
def words():
    draw = random.Random(2)
    return ["".join(draw.choices("abcdeßé", k=draw.randint(1, 12))) for _ in range(120)]


def kernel(a, b):
    """Common subsequences by their buckets, each with both weights."""
    found = []
    for w in (a, b):
        _, bucket, weight = toxicity.subsequences([w])
        sums = {}
        for k, x in zip(bucket.tolist(), weight.tolist()):
            sums[k] = sums.get(k, 0.0) + x
        found.append(sums)
    return sum(x * found[1].get(k, 0.0) for k, x in found[0].items())


def test_landmark_features_are_the_kernel(words):
    marks, others = words[:25], words[25:60]
    landmarks = toxicity._Landmarks(marks)
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values.max()
    cross = np.array([[kernel(a, b) for b in marks] for a in others])
    plain = cross @ (vectors[:, good] / np.sqrt(values[good]))
    made = landmarks.features(others)
    # Features are alike up to a rotation: their products are the Nyström kernel.
    assert np.allclose(made @ made.T, plain @ plain.T, atol=1e-3)
    weights = np.random.default_rng(1).normal(size=made.shape[1])
    assert np.allclose(toxicity._worth(others, landmarks.table(weights), 0.5), made @ weights + 0.5, atol=1e-2)


def test_machine_is_at_its_optimum():
    draw = np.random.default_rng(3)
    x, cost = draw.normal(size=(200, 6)), draw.uniform(0.1, 2, 200)
    y = (x[:, 0] + 0.3 * draw.normal(size=200) > 0).astype(int)
    w, bias = toxicity._machine(x, y, cost, rounds=400)
    sign, full = np.where(y > 0, 1.0, -1.0), np.append(w, bias)
    wide = np.hstack([x, np.ones((200, 1))])
    slack = np.maximum(1 - sign * (wide @ full), 0)
    gradient = full - 2 * (cost * slack * sign) @ wide
    assert np.abs(gradient).max() < 1e-3 * np.abs(full).max()
    assert ((x @ w + bias > 0) == (y > 0)).mean() > 0.85


def test_odds_are_at_their_optimum():
    draw = np.random.default_rng(8)
    values = draw.normal(size=500)
    y = (draw.random(500) < 1 / (1 + np.exp(-(2 * values - 1)))).astype(float)
    slope, base = toxicity._odds(values, y)
    p = 1 / (1 + np.exp(-(slope * values + base)))
    assert abs((p - y).sum()) < 1e-2 and abs(((p - y) * values).sum() + 1e-2 * slope) < 1e-2


def test_near_copies_speak_once():
    docs = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"], ["x", "y"], ["a", "b", "c", "d", "e"], ["x", "y"]]
    kept, labels = toxicity._unlike(docs, np.array([1, 1, 1, 0, 0]))
    assert kept == [docs[0], docs[2], docs[3], docs[4]] and labels.tolist() == [1, 1, 0, 0]
