"""Vector bin packing of token sequences for instruction data.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens.
Among the examples at hand the one goes into the open sequence whose demand has
the largest dot product with what the sequence still has of each, both weighted
by how scarce each is; what does not fit is cut.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from idlespan.llm.bpe import LONG_WORD, Merges
from idlespan.llm.frames import ascii_words, numbered, place, ragged, ship, slices, texts

#: Examples and tokens that are packed together; each such block keeps its last open sequence for the next.
BLOCK_ROWS, BLOCK_TOKENS = 1024, 8 << 20

PIECES = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("loss_tokens", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("piece_ids", T.BinaryType())])


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1 or self.tokens & (self.tokens - 1):
            raise ValueError("limits are at least 1, and that on tokens a power of two")


class _Packer:
    """Fills sequences one after the other; keeps one open."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.open: list[tuple] = []
        self.left = self._full()

    def _full(self) -> np.ndarray:
        return np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], dtype=np.int64)

    def _place(self, key, start: int, length: int, loss: int) -> None:
        self.open.append((key, start, length, loss))
        self.left -= (length, 1, loss)

    def _close(self) -> Iterator[tuple]:
        offset = 0
        for key, start, length, loss in self.open:
            yield key, start, length, loss, self.next_id, offset
            offset += length
        self.next_id += bool(self.open)
        self.open, self.left = [], self._full()

    def add(self, lengths: np.ndarray, losses: list[np.ndarray | None]) -> Iterator[tuple]:
        """Pack items of these lengths; ``losses``: running count of loss-bearing tokens (from 0), None if all are.

        Yields (item, start, length, loss, sequence, offset); what the open sequence
        holds comes later, with the item as it was given.
        """
        at = np.zeros(len(lengths), dtype=np.int64)
        loss_of = lambda i, a, b: int(b - a if losses[i] is None else losses[i][b] - losses[i][a])
        most = self._full()
        todo = np.arange(len(lengths))
        need = np.stack([lengths, np.ones_like(lengths), [loss_of(i, 0, n) for i, n in enumerate(lengths)]], axis=1)
        while len(todo):
            # Scarcity: mean demand of what is left, as a share of the limit.
            weight = need[todo].mean(axis=0) / most ** 2
            while len(todo):
                fits = (need[todo] <= self.left).all(axis=1)
                if not fits.any():
                    break
                score = np.where(fits, need[todo] @ (weight * self.left), -1.0)
                i = todo[best := int(score.argmax())]
                self._place(i, int(at[i]), int(need[i][0]), int(need[i][2]))
                todo = np.delete(todo, best)
                if not self.left.all():
                    yield from self._close()
            if len(todo):
                # Nothing fits whole: the longest is cut at what is left of tokens and of loss-bearing tokens.
                i = todo[int(need[todo, 0].argmax())]
                begin, end = int(at[i]), int(at[i] + min(need[i][0], self.left[0]))
                if losses[i] is None:
                    end = min(end, begin + int(self.left[2]))
                else:
                    end = min(end, int(np.searchsorted(losses[i], losses[i][begin] + self.left[2], "right")) - 1)
                if self.left.all() and end > begin:
                    self._place(i, begin, end - begin, loss_of(i, begin, end))
                    at[i] = end
                    need[i] = (lengths[i] - end, 1, loss_of(i, end, lengths[i]))
                    todo = todo[need[todo, 0] > 0]
                yield from self._close()

    def finish(self) -> Iterator[tuple]:
        """Close what is open, cut into lengths that are powers of two, which need no padding."""
        held, self.open = self.open, []
        rest = sum(x[2] for x in held)
        while held:
            take = 1 << (rest.bit_length() - 1)
            rest -= take
            while take:
                key, start, length, loss = held.pop(0)
                part = min(take, length)
                lost = loss if part == length else key[3](start, start + part)
                self.open.append((key, start, part, lost))
                if part < length:
                    held.insert(0, (key, start + part, length - part, loss - lost))
                take -= part
            yield from self._close()
        self.left = self._full()


def pack(df: DataFrame, limits: Limits = Limits(), *, ids: str = "ids", loss: str | None = None) -> DataFrame:
    """Examples with token ids (array of int), and maybe loss flags (array of boolean), packed into sequences.

    One row per piece: the example's columns but those two by position (c0, c1, ...),
    then ``start, length, loss_tokens, doc_tokens, sequence_id, offset`` and
    ``piece_ids`` (little-endian unsigned 32-bit ids).  Every token lies in exactly
    one piece.  Without ``loss`` every token bears loss.

    A sequence is filled to ``limits.tokens`` unless another limit stops it; the last
    one of a task is cut into powers of two.  Each task packs its own rows in
    blocks, so nothing is shuffled and a task that runs again gives the same.
    Null or empty ids give no piece; null flags count as no loss, missing ones too.
    Repeated rows are examples of their own; an empty table gives none.
    """
    plain = numbered(df)
    columns = [place(df, ids), *([place(df, loss)] if loss else [])]
    kept = [i for i in range(len(df.columns)) if i not in columns]
    chosen = plain.select(*[f"c{i}" for i in kept], *[f"c{i}" for i in columns])

    def examples(batches):
        for batch in batches:
            lists = batch.column(len(kept))
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            flags = batch.column(len(kept) + 1).to_pylist() if loss else [None] * len(counts)
            yield batch.select(range(len(kept))), flat, counts.astype(np.int64), flags if loss else None

    return _packed(chosen, len(kept), examples, limits)


def pack_texts(df: DataFrame, tokenizer: str, limits: Limits = Limits(), *, text: str = "text",
               end_id: int = 1) -> DataFrame:
    """``pack`` of whole texts: their ids by the tokenizers library, then ``end_id``; every token bears loss.

    ``tokenizer`` is a path read on the driver.  A null text counts as empty: its
    end is its only id.
    """
    plain, at = numbered(df), place(df, text)
    kept = [i for i in range(len(df.columns)) if i != at]
    chosen = plain.select(*[f"c{i}" for i in kept], f"c{at}")
    with open(tokenizer, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    def examples(batches):
        encoder = WordEncoder(sent.value)
        for batch in slices(batches, len(kept)):
            flat, counts = encoder(texts(batch, len(kept)), end_id)
            yield batch.select(range(len(kept))), flat, counts, None

    return _packed(chosen, len(kept), examples, limits)


def _packed(chosen: DataFrame, n_kept: int, examples, limits: Limits) -> DataFrame:
    ship(chosen.sparkSession)
    schema = T.StructType([*chosen.schema.fields[:n_kept], *PIECES.fields])

    def run(batches):
        packer = _Packer(limits, (TaskContext.get().partitionId() << 36) + 1)
        names = [f.name for f in schema.fields]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            """Pieces of examples: key = (kept columns, row, ids, count of loss, tokens of the example)."""
            blocks: dict[int, tuple] = {}
            for at, (key, *_) in enumerate(rows):
                blocks.setdefault(id(key[0]), (key[0], [], []))
                blocks[id(key[0])][1].append(key[1])
                blocks[id(key[0])][2].append(at)
            order = np.argsort(np.concatenate([b[2] for b in blocks.values()]), kind="stable")
            kept = [pa.concat_arrays([b[0].column(c).take(pa.array(b[1], pa.int64())) for b in blocks.values()])
                    .take(pa.array(order)) for c in range(n_kept)]
            numbers = np.array([(start, length, loss, key[4], sequence, offset)
                                for key, start, length, loss, sequence, offset in rows], dtype=np.int64)
            spans = [key[2][start:start + length].tobytes() for key, start, length, *_ in rows]
            return pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(numbers[:, i]) for i in range(6)], pa.array(spans, pa.binary())], names)

        for kept, flat, counts, flags in examples(batches):
            ends = np.cumsum(counts)
            begin = 0
            while begin < len(counts):
                limit = (ends[begin - 1] if begin else 0) + BLOCK_TOKENS
                end = min(begin + BLOCK_ROWS, max(begin + 1, int(np.searchsorted(ends, limit, "right"))))
                rows = [i for i in range(begin, end) if counts[i]]
                keys, losses = [], []
                for i in rows:
                    own = flat[ends[i] - counts[i]:ends[i]].copy()
                    running = None
                    if flags is not None:
                        mask = np.zeros(len(own), dtype=np.int64)
                        given = np.array([bool(x) for x in (flags[i] or [])[:len(own)]], dtype=np.int64)
                        mask[:len(given)] = given
                        running = np.concatenate([[0], np.cumsum(mask)])
                    losses.append(running)
                    count = (lambda a, b: b - a) if running is None else (lambda a, b, r=running: int(r[b] - r[a]))
                    keys.append((kept, i, own, count, len(own)))
                named = lambda made: [(keys[k] if not isinstance(k, tuple) else k, *x) for k, *x in made]
                if made := named(packer.add(counts[rows], losses)):
                    yield table(made)
                packer.open = named(packer.open)
                begin = end
        if made := list(packer.finish()):
            yield table(made)

    return chosen.mapInArrow(run, schema)


class WordEncoder:
    """Ids of texts as the tokenizers library gives them, for files whose pre-tokenizer never crosses ASCII white space.

    Every different word of a slice is encoded once, and a gather puts the texts
    together.  A run of Latin letters, and ASCII marks after it, are one piece each
    to the file's normalizer and pre-tokenizer, which only make them lower case, so
    the merges of such letters are done here for all words together; marks and all
    other words go to the library.
    """

    #: Letters with one lower-case form that are composed already.
    LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
    #: ASCII marks but the apostrophe, which may begin a piece of its own.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, file: str):
        # One thread in a task, which has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merges = Merges(file)

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        simple = words.cast(pa.large_binary())
        lengths = pc.binary_length(simple).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.frombuffer(b"".join(simple.to_pylist()), dtype=np.uint8).astype(np.int64)
        if self.merges.mark:
            parts[np.cumsum(lengths) - 1] += 256
        ranks, owner = self.merges.merged_together(parts, np.repeat(np.arange(len(lengths)), lengths))
        return self.merges.ids[ranks], np.bincount(owner, minlength=len(lengths))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        marks = "".join(f"\\{c}" for c in self.MARKS)
        plain = pc.match_substring_regex(
            words, f"^[{self.LETTERS}]{{1,{LONG_WORD}}}[{marks}]{{0,{LONG_WORD}}}$").to_numpy(zero_copy_only=False)
        known = words.filter(pa.array(plain))
        # Different cases of a word are one word here.
        heads = pc.utf8_lower(pc.utf8_rtrim(known, characters=self.MARKS)).dictionary_encode()
        tails = pc.replace_substring_regex(known, f"^[{self.LETTERS}]+", "").dictionary_encode()
        flat, counts = self._letters(heads.dictionary)
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(
            tails.dictionary.to_pylist() + words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        flat = np.concatenate([flat, np.array([i for ids in encoded for i in ids], dtype=np.int32)])
        n_heads, n_tails = len(counts), len(tails.dictionary)
        counts = np.concatenate([counts, np.array([len(ids) for ids in encoded], dtype=np.int64)])
        starts = np.cumsum(counts) - counts
        # Each word as two parts, the second empty for those of the library: one past the last has no ids.
        starts, counts = np.append(starts, len(flat)), np.append(counts, 0)
        which = np.full((len(words), 2), len(counts) - 1, dtype=np.int64)
        which[plain, 0] = heads.indices.to_numpy(zero_copy_only=False)
        which[plain, 1] = n_heads + tails.indices.to_numpy(zero_copy_only=False)
        which[~plain, 0] = n_heads + n_tails + np.arange(int((~plain).sum()))
        return flat[ragged(starts[which.ravel()], counts[which.ravel()])], counts[which].sum(axis=1)

    def __call__(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by ``end_id``, and how many each text has."""
        offsets, words = ascii_words(column)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, lengths = self._words(coded.dictionary)
        # The end of each text is one more word.
        flat, lengths = np.append(flat, end_id).astype("<u4"), np.append(lengths, 1)
        starts = np.cumsum(lengths) - lengths
        where = offsets[1:] + np.arange(len(column))
        all_codes = np.full(len(codes) + len(column), len(lengths) - 1)
        inner = np.ones(len(all_codes), bool)
        inner[where] = False
        all_codes[inner] = codes
        counts = lengths[all_codes]
        sums = np.concatenate([[0], np.cumsum(counts)])
        totals = sums[where + 1] - sums[np.concatenate([[0], where[:-1] + 1])]
        return flat[ragged(starts[all_codes], counts)], totals
