"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify, failing words are merged.

A row of tokens is the BPE encoding of its bytes if each token is its own encoding
and every adjacent pair is compatible, that is, encoding the two tokens' bytes
gives these two tokens back.  Greedy longest match is right for most words, its
pairs are checked all together in numpy, and only words with a wrong pair are
merged step by step.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from idlespan.llm.frames import mapped, numbered, place, ragged, ship

#: White space of Unicode, as the pattern below means it.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the pattern that parts texts before merging, with white space spelt out.
_PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
            rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A blank that ends a text or stands before other white space (RE2); such texts are cut with care.
_ODD_BLANK = (r" ([\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)")
#: Bytes from which on a word is merged with a heap.
LONG_WORD = 200
_NEVER = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """Letter that the vocabulary file writes for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Table:
    """Whole numbers by key, looked up for many keys together (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NEVER, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, ``_NEVER`` for one that is not there."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = self.values[slot]
        late = np.flatnonzero((found != keys) & (found != -1))
        at = slot[late]
        out[late] = _NEVER
        while len(late):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            out[late] = np.where(found == keys[late], self.values[at], _NEVER)
            on = (found != keys[late]) & (found != -1)
            late, at = late[on], at[on]
        return out


class Merges:
    """Merge rules of a byte-level BPE vocabulary file; tokens count by merge order ("rank"), single bytes first.

    Where the file marks the end of words, a word's last byte is another token: the
    bytes are followed by the same with the mark.  The size is that of the
    vocabulary, so it can be sent to every task.
    """

    def __init__(self, file: str):
        model = json.loads(file)
        letters = _byte_letters()
        self.mark = model["model"].get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        single = {b: c for c, b in letters.items()}
        names = [single[b] for b in range(256)]
        names += [n + self.mark for n in names] if self.mark else []
        self.left, self.right, rank = [-1] * len(names), [-1] * len(names), {n: r for r, n in enumerate(names)}
        for a, b in merges:
            if a + b not in rank:
                rank[a + b] = len(names)
                names.append(a + b)
                self.left.append(rank[a])
                self.right.append(rank[b])
        self.merge = {(rank[a], rank[b]): rank[a + b] for a, b in reversed(merges)}
        self.left, self.right = np.array(self.left), np.array(self.right)
        vocabulary = model["model"]["vocab"]
        self.ids = np.array([vocabulary[n] for n in names], dtype=np.int32)
        self.bytes = [bytes(letters[c] for c in n.removesuffix(self.mark)) for n in names]
        self.pairs = _Table(np.array([a * len(names) + b for a, b in self.merge], dtype=np.int64),
                            np.array(list(self.merge.values()), dtype=np.int64))
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}

    def parts(self, word: bytes) -> list[int]:
        return [*word[:-1], word[-1] + 256] if self.mark else list(word)

    def merged(self, word: bytes) -> list[int]:
        """Exact: the pair of least rank merges first, the leftmost of equal ones."""
        if len(word) > LONG_WORD:
            return self.merged_by_heap(word)
        parts, get = self.parts(word), self.merge.get
        ranks = [get(p, _NEVER) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NEVER:
            at = ranks.index(least)
            parts[at:at + 2] = [least]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], least), _NEVER)
            if at < len(ranks):
                ranks[at] = get((least, parts[at + 1]), _NEVER)
        return parts

    def merged_by_heap(self, word: bytes) -> list[int]:
        """The same in time n log n, for words of any length."""
        parts, get, n = self.parts(word), self.merge.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (rank := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, a, b = heapq.heappop(heap)
            to = after[at]
            if parts[at] != a or to >= n or parts[to] != b:
                continue
            parts[at], parts[to], after[at] = rank, -1, after[to]
            if after[at] < n:
                before[after[at]] = at
            for left, right in ((before[at], at), (at, after[at])):
                if left >= 0 and right < n and (new := get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (new, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def merged_together(self, parts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merged`` of many words: in each round every word merges its first pair of least rank.

        ``word`` tells, in ascending order, which word each of the first ``parts`` is of.
        """
        n, done = len(self.ids), []
        parts = parts.astype(np.int64)
        rank = np.full(len(parts), _NEVER)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.pairs.get(parts[inside] * n + parts[inside + 1])
        while len(parts):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(parts))
            over = np.repeat(least == _NEVER, sizes)
            if over.any():
                done.append((word[over], parts[over]))
                least, sizes = least[least != _NEVER], sizes[least != _NEVER]
                parts, rank, word = parts[~over], rank[~over], word[~over]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.flatnonzero(np.diff(word[at], prepend=-1))]
            parts[at] = rank[at]
            keep = np.ones(len(parts), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            parts, rank, word = parts[keep], rank[keep], word[keep]
            for left in (at[(at > 0)] - 1, at):
                left = left[left + 1 < len(parts)]
                same = word[left] == word[left + 1]
                rank[left] = np.where(same, self.pairs.get(parts[left] * n + parts[left + 1]), _NEVER)
            if len(at) and at[-1] == len(parts) - 1:
                rank[-1] = _NEVER
        words, out = (np.concatenate(x) for x in zip(*done)) if done else (word, parts)
        order = np.argsort(words, kind="stable")
        return out[order], words[order]


class ByteBpe(Merges):
    """Merge rules without marks at word ends, and what greedy matching and its verification need."""

    def __init__(self, file: str):
        super().__init__(file)
        if self.mark:
            raise ValueError("a vocabulary that marks the ends of words")
        whole = {b: r for r, b in enumerate(self.bytes) if self.merged(b) == [r]}
        nodes = {b"": 0}
        steps = []
        for token in whole:
            for end in range(1, len(token) + 1):
                if token[:end] not in nodes:
                    nodes[token[:end]] = len(nodes)
                    steps.append((nodes[token[:end - 1]] * 256 + token[end - 1], nodes[token[:end]]))
        steps = np.array(steps, dtype=np.int64)
        self.steps = _Table(steps[:, 0], steps[:, 1])
        self.rank_of_node = np.array([whole.get(b, -1) for b in nodes], dtype=np.int64)
        self.spelling = {int(i): b for i, b in zip(self.ids, self.bytes)} | {
            i: s.encode() for s, i in self.special.items()}

    def proposed(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words (bytes one after the other): ranks, and how many each word has."""
        end = np.repeat(ends, ends - starts)
        size, rank = np.ones(len(flat), dtype=np.int64), flat.astype(np.int64)
        live, node, depth = np.arange(len(flat)), np.zeros(len(flat), dtype=np.int64), 0
        while len(live):
            node = self.steps.get(node * 256 + flat[live + depth])
            depth += 1
            on = node != _NEVER
            live, node = live[on], node[on]
            found = self.rank_of_node[node]
            token = found >= 0
            size[live[token]], rank[live[token]] = depth, found[token]
            inside = live + depth < end[live]
            live, node = live[inside], node[inside]
        begins = np.zeros(len(flat) + 1, dtype=np.int64)
        at, stop = starts[starts < ends], ends[starts < ends]
        while len(at):
            begins[at] = 1
            at = at + size[at]
            at, stop = at[at < stop], stop[at < stop]
        before = np.concatenate([[0], np.cumsum(begins[:-1])])
        return rank[begins[:-1] == 1], before[ends] - before[starts]

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair stays apart when its bytes are encoded.

        A merge across the border would join the tokens that stand at the border at
        some moment.  The merges that built both sides are undone from the latest
        on; if at any stage the border tokens have a merge of their own that comes
        before the one just undone, it would have happened instead.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        good, limit = np.ones(len(a), bool), np.full(len(a), _NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            joined = self.pairs.get(x * len(self.ids) + y)
            bad = joined < limit[live]
            good[live[bad]] = False
            # The later merge of the two is undone; of the same merge on both sides the right one happened later.
            undo_left = (x > y) & (self.right[x] >= 0)
            undo_right = ~undo_left & (self.left[y] >= 0)
            undo_left |= ~undo_right & (self.right[x] >= 0)
            limit[live] = np.where(undo_left, x, y + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_right, self.left[y], y)
            live = live[~bad & (undo_left | undo_right)]
        return good

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all words one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ranks, counts = self.proposed(flat, ends - lengths, ends)
        if len(ranks) < 2:
            return ranks, counts
        word = np.repeat(np.arange(len(words)), counts)
        inside = np.flatnonzero(word[:-1] == word[1:])
        keys, back = np.unique(ranks[inside] * len(self.ids) + ranks[inside + 1], return_inverse=True)
        good = self.compatible(keys // len(self.ids), keys % len(self.ids))[back]
        failing = np.unique(word[inside[~good]])
        if not len(failing):
            return ranks, counts
        long = lengths[failing] > LONG_WORD
        short = failing[~long]
        parts = flat[ragged(ends[short] - lengths[short], lengths[short])]
        mended = [self.merged_together(parts, np.repeat(short, lengths[short]))]
        for i in failing[long]:
            merged = np.array(self.merged_by_heap(words[i]), dtype=np.int64)
            mended.append((merged, np.full(len(merged), i)))
        fine = ~np.isin(word, failing, kind="table")
        word = np.concatenate([word[fine], *[w for _, w in mended]])
        order = np.argsort(word, kind="stable")
        ranks = np.concatenate([ranks[fine], *[r for r, _ in mended]])[order]
        return ranks, np.bincount(word, minlength=len(words))


class _Encoder:
    """Encodes slices of texts: every different unit of a slice once, then a gather."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.pattern = regex.compile(_PATTERN)
        self.cut = regex.compile(f"(?= [^{_SPACE}])")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, bpe.special)) + ")") if bpe.special else None
        spelling = [bpe.spelling.get(i, b"") for i in range(max(bpe.spelling) + 1)]
        self.spell_flat = np.frombuffer(b"".join(spelling), dtype=np.uint8)
        self.spell_len = np.array([len(s) for s in spelling])
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len

    def units(self, text: str) -> list[str]:
        """Units of any text: cut at special tokens, and before blanks that other text follows."""
        out = []
        for piece in self.specials.split(text) if self.specials else [text]:
            out += [piece] if piece in self.bpe.special else self.cut.split(piece)
        return out

    def unit_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after the other, and how many each has."""
        words: dict[str, int] = {}
        parts, counts = [], []
        special, findall = self.bpe.special, self.pattern.findall
        for unit in units:
            if unit in special:
                found = [(special[unit],)]
            elif unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
                found = [unit]
            else:
                found = findall(unit)
            counts.append(len(found))
            for w in found:
                parts.append(~w[0] if isinstance(w, tuple) else words.setdefault(w, len(words)))
        ranks, lengths = self.bpe.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        flat = self.bpe.ids[ranks]
        parts, counts = np.array(parts, dtype=np.int64), np.array(counts, dtype=np.int64)
        marked = parts < 0
        lengths = np.append(lengths, 1)
        starts = np.cumsum(lengths) - lengths
        which = np.where(marked, len(words), parts)
        ids = np.append(flat, np.int32(0))[ragged(starts[which], lengths[which])]
        per_part = lengths[which]
        ids[(np.cumsum(per_part) - per_part)[marked]] = ~parts[marked]
        sums = np.concatenate([[0], np.cumsum(per_part)])
        ends = np.cumsum(counts)
        return ids, sums[ends] - sums[ends - counts]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's count."""
        odd = pc.match_substring_regex(column, _ODD_BLANK).to_numpy(zero_copy_only=False)
        for token in self.bpe.special:
            odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", column), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values[offsets[0]:offsets[-1]].dictionary_encode()
        offsets -= offsets[0]
        units = [" " + w for w in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = {u: i for i, u in enumerate(units)}

        def code(unit: str) -> int:
            if (i := known.get(unit)) is None:
                i = known[unit] = len(units)
                units.append(unit)
            return i

        firsts = codes[offsets[:-1]]
        codes[offsets[:-1]] = [code(units[i][1:]) for i in firsts]
        careful = {int(i): np.array([code(u) for u in self.units(column[int(i)].as_py())], dtype=np.int64)
                   for i in np.flatnonzero(odd)}
        ids, per_unit = self.unit_ids(units)
        starts = np.cumsum(per_unit) - per_unit
        sizes = np.diff(offsets)
        if careful:
            rows = [careful.get(i, codes[offsets[i]:offsets[i + 1]]) for i in range(len(column))]
            codes, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
        lengths = per_unit[codes]
        sums, ends = np.concatenate([[0], np.cumsum(lengths)]), np.cumsum(sizes)
        return ids[ragged(starts[codes], lengths)], sums[ends] - sums[ends - sizes]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of the ids; bytes that are no UTF-8 become replacement characters."""
        lengths = self.spell_len[ids]
        flat = self.spell_flat[ragged(self.spell_at[ids], lengths)]
        sums, ends = np.concatenate([[0], np.cumsum(lengths)]), np.cumsum(counts)
        cuts = np.concatenate([[0], sums[ends]]).astype(np.int64)
        made = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
        try:
            return made.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in made.to_pylist()], pa.string())


def vocabulary(path: str) -> ByteBpe:
    """Read on the driver; tasks get the tables, so the file need not be on every machine."""
    with open(path, encoding="utf-8") as file:
        return ByteBpe(file.read())


def encode(df: DataFrame, bpe: ByteBpe, *, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` by position (c0, c1, ...), with ``ids`` (array of int), and ``decoded``: the text read back from them.

    Whole texts; null counts as empty, which has no ids.  Strings of special tokens
    inside a text become these tokens.  Repeated rows and an empty table are nothing
    special, and columns of any name pass through by position.  Nothing is shuffled.
    """
    sent = _sent(df.sparkSession, bpe)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField("decoded", T.StringType())] if decoded else []

    def work():
        encoder = _Encoder(sent.value)

        def run(column):
            ids, counts = encoder(column)
            cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids, pa.int32()))
            return [lists, encoder.decode(ids, counts)] if decoded else [lists]

        return run

    return mapped(df, text, fields, work)


def decode(df: DataFrame, bpe: ByteBpe, *, ids: str = "ids") -> DataFrame:
    """``df`` by position with ``decoded``: the text of the ids in column ``ids``; null ids count as none.

    An id that the vocabulary lacks adds nothing.
    """
    sent, at, plain = _sent(df.sparkSession, bpe), place(df, ids), numbered(df)

    def run(batches):
        encoder = _Encoder(sent.value)
        for batch in batches:
            lists = batch.column(at)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (flat >= 0) & (flat < len(encoder.spell_len))
            sums, ends = np.concatenate([[0], np.cumsum(known)]), np.cumsum(counts)
            texts = encoder.decode(flat[known], sums[ends] - sums[ends - counts])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("decoded", T.StringType())]))


def _sent(spark: SparkSession, bpe: ByteBpe):
    ship(spark)
    return spark.sparkContext.broadcast(bpe)
