"""Toxicity: a subsequence string kernel, Nyström landmarks, and a linear support vector machine.

The kernel of two words counts the characters they have in common in the same
order, each common subsequence weighted down by the gaps in it, so that letters
put in between or left out cost little.  Sentences bear their document's label;
a toxic sentence is one that holds an insult, so the machine learns with the
worst word of each sentence as its witness.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idlespan.llm.frames import ascii_words, mapped, picked
from idlespan.llm.labelled import log_loss, sampled, sigmoid
from idlespan.session import written

#: Labelled documents that are trained on at most, by hash of their ids.
SAMPLE = 3000
#: Words that the machine is trained on at most, of either class, and landmarks.
TRAINING_WORDS, LANDMARKS = 8_000, 300
#: Words of a toxic document that bear witness at most.
WITNESSES = 5
#: Length of subsequences, the longest stretch one may cover, the weight of one more place covered.
LENGTH, SPAN, DECAY = 4, 6, 0.6
#: Buckets that subsequences are hashed to, of fixed size.
BUCKETS = 1 << 20
#: Characters of a word that are looked at together; longer words are looked at in overlapping stretches.
LONG_WORD = 48
#: Words whose subsequences are held in memory together.
_TOGETHER = 1 << 13
_STEPS = [(0, *more) for more in combinations(range(1, SPAN), LENGTH - 1)]
_MIX = np.uint32(2654435761)


def units_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Units of each text, in small letters: the words, and runs of three or more single characters put together.

    Returns offsets of each text's units, the different units, and the code of each.
    Only letters and digits of a word count; marks around and inside it go.
    """
    offsets, words = ascii_words(pc.utf8_lower(column))
    coded = words.dictionary_encode()
    bare = pc.replace_substring_regex(coded.dictionary, r"[^\pL\pN]+", "").dictionary_encode()
    codes = bare.indices.to_numpy(zero_copy_only=False).astype(np.int64)[
        coded.indices.to_numpy(zero_copy_only=False)]
    units = bare.dictionary
    lengths = pc.utf8_length(units).to_numpy(zero_copy_only=False)
    single = np.flatnonzero(lengths[codes] == 1)
    if len(single) < 3:
        return offsets, units, codes
    row = np.searchsorted(offsets, single, "right")
    runs = np.split(single, np.flatnonzero((np.diff(single) != 1) | (np.diff(row) != 0)) + 1)
    runs = [r for r in runs if len(r) >= 3]
    if not runs:
        return offsets, units, codes
    letters = units.to_pylist()
    joined = ["".join(letters[codes[i]] for i in r) for r in runs]
    # A joined run stands after its last character.
    at = np.array([r[-1] + 1 for r in runs])
    codes = np.insert(codes, at, len(units) + np.arange(len(runs)))
    offsets = offsets + np.searchsorted(at, offsets, "right")
    return offsets, pa.concat_arrays([units, pa.array(joined, units.type)]), codes


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, weight) of every subsequence of every word, marks at both ends of the word counted in.

    Weights are divided by the root of their squares' sum, which depends on the
    word's length alone, so long and short words compare.
    """
    marked = [f"^{w}$" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(w) for w in marked], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))
    mixed = (chars + np.uint32(1)) * _MIX
    mixed ^= mixed >> np.uint32(15)
    out = []
    for step in _STEPS:
        start = np.flatnonzero(left > step[-1])
        key = np.zeros(len(start), dtype=np.uint32)
        for place in step:
            key = (key * np.uint32(31) + mixed[start + place]) * np.uint32(0x85EBCA6B)
            key ^= key >> np.uint32(13)
        out.append((owner[start], (key % np.uint32(BUCKETS)).astype(np.int32),
                    np.full(len(start), DECAY ** (step[-1] + 1 - LENGTH), dtype=np.float32)))
    word, bucket, weight = (np.concatenate(x) for x in zip(*out))
    norm = np.sqrt(np.bincount(word, weights=weight.astype(np.float64) ** 2, minlength=len(words)))
    return word, bucket, weight / np.maximum(norm, 1e-9)[word].astype(np.float32)


def _worth(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value of each word: a sum over its subsequences."""
    if not words:
        return np.zeros(0)
    cut, owner = [], []
    for i, w in enumerate(words):
        # Stretches overlap by half, so whatever a subsequence covers lies in one of them.
        for begin in range(0, max(1, len(w) - LONG_WORD // 2), LONG_WORD // 2):
            cut.append(w[begin:begin + LONG_WORD])
            owner.append(i)
    sums = np.empty(len(cut))
    for begin in range(0, len(cut), _TOGETHER):
        some = cut[begin:begin + _TOGETHER]
        word, bucket, weight = subsequences(some)
        sums[begin:begin + len(some)] = np.bincount(word, weights=table[bucket] * weight, minlength=len(some)) + bias
    best = np.full(len(words), -np.inf)
    np.maximum.at(best, np.array(owner), sums)
    return best


@dataclass
class ToxicityModel:
    """``table`` holds the machine's weight of each subsequence bucket; ``slope`` and ``base`` turn values into odds."""

    table: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    base: float = -2.0

    def values(self, column: pa.Array) -> np.ndarray:
        """Per text the mean of its two worst words (the worst alone counts half if there is no other)."""
        offsets, units, codes = units_of(column)
        worth = _worth(units.to_pylist(), self.table, self.bias)[codes] if len(codes) else np.zeros(0)
        worth = np.clip(worth, -2.0, 2.0)
        counts = np.diff(offsets)
        owner = np.repeat(np.arange(len(column)), counts)
        best = np.full((len(column), 2), -2.0)
        np.maximum.at(best[:, 0], owner, worth)
        # The second worst: the first place of the worst is left out.
        top = np.flatnonzero(worth == best[owner, 0])
        first = top[np.flatnonzero(np.diff(owner[top], prepend=-1))]
        rest = np.ones(len(worth), bool)
        rest[first] = False
        np.maximum.at(best[:, 1], owner[rest], worth[rest])
        return best.mean(axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.values(column) + self.base)


class _Landmarks:
    """Nyström features: kernels with the landmarks, times the inverse root of the landmarks' own kernel."""

    def __init__(self, words: list[str]):
        word, bucket, weight = subsequences(words)
        self.buckets, at = np.unique(bucket, return_inverse=True)
        self.own = np.zeros((len(self.buckets), len(words)), dtype=np.float32)
        np.add.at(self.own, (at, word), weight)
        values, vectors = np.linalg.eigh(self.own.T.astype(np.float64) @ self.own)
        good = values > 1e-6 * values.max()
        self.root = vectors[:, good] / np.sqrt(values[good])

    def features(self, words: list[str]) -> np.ndarray:
        kernel = np.zeros((len(words), self.own.shape[1]))
        for begin in range(0, len(words), 1000):
            word, bucket, weight = subsequences(words[begin:begin + 1000])
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            known = self.buckets[at] == bucket
            order = np.argsort(word[known], kind="stable")
            own, rows = word[known][order], self.own[at[known][order]] * weight[known][order, None]
            if len(own):
                heads = np.flatnonzero(np.diff(own, prepend=-1))
                kernel[begin + own[heads]] = np.add.reduceat(rows, heads, axis=0)
        return kernel @ self.root

    def table(self, weights: np.ndarray) -> np.ndarray:
        """A linear machine on the features as weights of subsequences: the same values, looked up."""
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[self.buckets] = self.own @ (self.root @ weights)
        return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge) by dual coordinate ascent; ``cost`` weighs the rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    diagonal = (x * x).sum(axis=1) + 1 / (2 * cost)
    draw = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in draw.permutation(len(y)):
            gradient = sign[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def _unlike(docs: list[list[str]], labels: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """The documents without toxic ones that share four fifths of their units with an earlier one.

    Copies of one document would speak for its words as often as they occur.
    """
    kept, held = [], []
    for i, units in enumerate(docs):
        if labels[i]:
            own = set(units)
            if any(len(own & other) >= 0.8 * len(own | other) for other in held if 0.8 * len(own) <= len(other) <= 1.25 * len(own)):
                continue
            held.append(own)
        kept.append(i)
    return [docs[i] for i in kept], labels[kept]


def _learned(docs: list[list[str]], labels: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights of subsequences from documents' different units and labels."""
    docs, labels = _unlike(docs, labels)
    bad, good = {}, {}
    for units, label in zip(docs, labels):
        into = bad if label else good
        for u in units:
            into[u] = into.get(u, 0) + 1
    draw = np.random.default_rng(seed)
    clean = sorted(good, key=lambda u: (-good[u], u))
    clean = clean[:TRAINING_WORDS // 4] + [clean[i] for i in sorted(draw.permutation(np.arange(
        TRAINING_WORDS // 4, max(TRAINING_WORDS // 4, len(clean))))[:TRAINING_WORDS * 3 // 4])]
    suspects = sorted((u for u in bad if u not in good), key=lambda u: (-bad[u], u))
    witnesses, said = suspects[:TRAINING_WORDS], bad
    toxic = [[u for u in units if u not in good] for units, label in zip(docs, labels) if label]
    landmarks = _Landmarks([*witnesses[:LANDMARKS * 3 // 4], *clean[:LANDMARKS // 4]])
    table, bias = np.zeros(BUCKETS, dtype=np.float32), 0.0
    for turn in range(4):
        # Witnesses also with one letter put in or left out, so that the machine has seen such words.
        bent = [w[:k] + draw.choice(["x", "a", "n", ""]) + w[k + draw.integers(2):]
                for w in witnesses[:TRAINING_WORDS // 4] if len(w) > 4 for k in draw.integers(1, len(w), 2)]
        words = [*witnesses, *bent, *clean]
        y = np.array([1] * (len(witnesses) + len(bent)) + [0] * len(clean))
        # A witness counts as often as it was one, and both classes count alike: a word that stands for one
        # document, whose label may be wrong, says little beside those that return.
        seen = np.array([said[u] for u in witnesses] + [0.25] * len(bent) + [1] * len(clean), dtype=np.float64)
        share = np.where(y, seen[y == 1].sum(), seen[y == 0].sum())
        weights, bias = _machine(landmarks.features(words), y, np.maximum(4 * seen / share * len(y) / 2, 1e-3), 12)
        table = landmarks.table(weights)
        if turn == 3:
            break
        # The next witnesses of a toxic document are the worst of its words that return elsewhere, or else its worst.
        value = dict(zip(suspects, _worth(suspects, table, bias)))
        chosen: dict[str, int] = {}
        for units in toxic:
            worst = sorted(units, key=lambda u: -value[u])[:WITNESSES]
            for u in [u for u in worst if bad[u] > 1 and value[u] > 0] or worst[:1]:
                chosen[u] = chosen.get(u, 0) + 1
        witnesses, said = sorted(chosen, key=lambda u: (-chosen[u], u))[:TRAINING_WORDS], chosen
        picked_marks = sorted(witnesses, key=lambda u: -value[u])
        step = max(1, len(picked_marks) * 4 // (3 * LANDMARKS))
        landmarks = _Landmarks([*picked_marks[::step][:LANDMARKS * 3 // 4], *clean[:LANDMARKS // 4]])
    return table, bias


def _odds(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve through values of either class, classes counted as they come."""
    slope, base = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * values + base)
        w = p * (1 - p) + 1e-6
        gradient = np.array([((p - labels) * values).sum() + 1e-2 * slope, (p - labels).sum()])
        hessian = np.array([[(w * values * values).sum() + 1e-2, (w * values).sum()],
                            [(w * values).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        scale = 1.0
        while scale > 1e-3 and log_loss((slope - scale * step[0]) * values + base - scale * step[1], labels) > log_loss(
                slope * values + base, labels):
            scale /= 2
        slope, base = slope - scale * step[0], base - scale * step[1]
    return float(slope), float(base)


def fit(documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """A model of at most ``sample`` labelled documents that are not held out, taken by hash of the id alone.

    Sentences of a clean document are clean; a sentence of a toxic one is toxic if
    it holds one of the document's worst words, which are found anew in each of four
    rounds: those that other toxic documents hold too, or else the worst alone.  Near
    copies among the toxic documents count once.  The first two thirds teach the
    words, the last the odds, so scores follow the share of toxic rows.  Without rows
    of both classes every text gets that share.

    Null and empty texts are documents without words; a very long one counts with
    its different words; an id that occurs twice is two rows; empty tables give the
    constant model; names of other columns may clash.
    """
    rows = picked(documents, doc_id=doc_id, text=text)
    # Stored, as it is read twice.
    chosen = written(rows.join(sampled(labels, doc_id, label, sample), "doc_id").select("doc_id", "label", "text"))

    def work():
        def run(column):
            # Sentences end at marks or lines; a unit is never cut by that, so units stand for them here.
            offsets, units, codes = units_of(column)
            names = np.array(units.to_pylist() + [""], dtype=object)
            return [pa.array([names[np.unique(codes[a:b])].tolist() for a, b in zip(offsets, offsets[1:])],
                             pa.list_(pa.string()))]

        return run

    found = mapped(chosen, "text", [T.StructField("units", T.ArrayType(T.StringType()))], work).select(
        "c0", "c1", "units").orderBy(F.xxhash64("c0"), "c0").toArrow()
    y = found["c1"].to_numpy().astype(int) if found.num_rows else np.zeros(0, int)
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        return ToxicityModel(np.zeros(BUCKETS, dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    cut = max(1, len(y) * 2 // 3)
    if len(set(y[:cut].tolist())) < 2:
        cut = len(y)
    docs = [[u for u in units if len(u) > 1] for units in found["units"].to_pylist()]
    model = ToxicityModel(*_learned(docs[:cut], y[:cut]))
    late = slice(cut, None) if len(set(y[cut:].tolist())) == 2 else slice(None)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    values = mapped(chosen, "text", [T.StructField("value", T.DoubleType())],
                    lambda: lambda column: [pa.array(sent.value.values(column))]).select("c0", "value").orderBy(
        F.xxhash64("c0"), "c0").toArrow()["value"].to_numpy()[late]
    model.slope, model.base = _odds(values, y[late].astype(np.float64))
    return model
