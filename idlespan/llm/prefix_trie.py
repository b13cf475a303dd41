"""The prefix trie of conversations, by truncation peeling.

All nodes of the greatest depth are found first.  Then, depth by depth, the nodes
that are there lose their last turn and are grouped again, together with the
conversations that end at that depth; counts and sums over subtrees are added up
on the way, so that every node is found and finished in one go.

A node is known by a digest of its turns that grows turn by turn.  Below a depth
at which every subtree is small, a task peels whole subtrees by itself; above it,
each depth is one grouping of all nodes, whatever a single prefix holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlespan.llm.frames import picked, ship
from idlespan.session import written

#: Different sequences of a subtree at most that a task peels by itself; larger subtrees are peeled depth by depth in Spark.
SUBTREE_ENDS = 1 << 9
#: Turns of small subtrees that a task peels together.
_TOGETHER = 1 << 16
_ID = 16
_ROOT = b"\0" * _ID
_NONE_SHA = hashlib.sha256(b"").hexdigest()

_SEQUENCES = "conv_id long, path binary, lens array<int>"
_NODES = ("depth int, node binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string")


def _digest(before: bytes, role: str, text: str) -> bytes:
    """A node's digest from its parent's and its last turn."""
    said = role.encode()
    return hashlib.blake2b(before + len(said).to_bytes(8, "big") + said + text.encode(), digest_size=_ID).digest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            yield from zip(*[c.to_pylist() for c in batch.slice(begin, 1024).columns])


def _gathered(made: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches."""
    held = []
    for row in made:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)


def _sequence(conv_id: int, turns: list[tuple[str, str]]) -> tuple:
    path, lens, last = [], [], _ROOT
    for role, text in turns:
        last = _digest(last, role, text)
        path.append(last)
        lens.append(len(text))
    return conv_id, b"".join(path), lens


_SEQUENCE_ROWS = pa.schema([("conv_id", pa.int64()), ("path", pa.binary()), ("lens", pa.list_(pa.int32()))])


def _rebuilt(heads: int):
    """Task: conversations in order, the one that lends its first turns before those that borrow them."""
    def made(batches):
        base, lent, conv, turns = object(), [], object(), []

        def done():
            head = lent[:zlib.crc32(str(conv).encode()) % heads]
            return _sequence(conv, head + turns[zlib.crc32(str(conv).encode()) % heads:])

        for of, conv_id, role, text in _rows(batches):
            if conv_id != conv:
                if isinstance(conv, int):
                    yield done()
                conv, turns = conv_id, []
            if of != base:
                base, lent = of, []
            if conv_id == of and len(lent) < heads:
                lent.append((role, text))
            turns.append((role, text))
        if isinstance(conv, int):
            yield done()

    return lambda batches: _gathered(made(batches), _SEQUENCE_ROWS)


def rebuilt(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            every: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, path, lens) of each conversation c with its first h turns replaced by those of c - c % ``every``.

    h is crc32 of the id in decimal, modulo ``heads``; a lender that is shorter
    lends all it has, one that is absent nothing.  ``path`` holds the digests of the
    first 1, 2, ... turns, 16 bytes each, ``lens`` the code points of each text.
    Turns go by turn number, nulls first; ties by role, then text; repeated rows are
    repeated turns.  A null role or text counts as empty.  Rows without a conv_id
    take no part.  Turns are moved and sorted once; a conversation must fit in a task.
    """
    ship(turns.sparkSession)
    rows = picked(turns, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.col("conv_id") % every).alias("base"), F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "role", "text")
        .select("base", "conv_id", "role", "text").mapInArrow(_rebuilt(heads), _SEQUENCES))


_END_ROWS = pa.schema([("path", pa.binary()), ("lens", pa.list_(pa.int32())), ("conv_id", pa.int64()), ("n", pa.int64()),
                       ("sha", pa.string())])


def _ends(batches):
    """Task: equal sequences, in order of path and id, become one; their ids are hashed as they come."""
    def made():
        path = None
        for conv_id, of, lens in _rows(batches):
            if of != path:
                if path is not None:
                    yield path, kept, least, n, digest.hexdigest()
                path, kept, least, n, digest = of, lens, conv_id, 0, hashlib.sha256()
            digest.update((b"," if n else b"") + str(conv_id).encode())
            n += 1
        if path is not None:
            yield path, kept, least, n, digest.hexdigest()

    return _gathered(made(), _END_ROWS)


_NODE_ROWS = pa.schema([
    ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])


def _at(path: bytes, depth: int) -> bytes:
    """Digest of the first ``depth`` turns."""
    return path[(depth - 1) * _ID:depth * _ID] if depth else _ROOT


def peeled(ends: list[tuple], top: int) -> Iterator[tuple]:
    """Nodes of depth ``top`` and below of some sequences (path, lens, conv_id, n, sha), each sequence once.

    Nodes of depth ``top`` come without their parent's conversation.
    """
    ending: dict[int, list[tuple]] = {}
    for end in ends:
        ending.setdefault(len(end[0]) // _ID, []).append(end)
    below: list[list] = []
    for depth in range(max(ending, default=0), top - 1, -1):
        # A node: path and lengths of one that goes through it, then its values.
        nodes: dict[bytes, list] = {}
        for path, lens, conv_id, n, sha in ending.get(depth, ()):
            nodes[_at(path, depth)] = [path, lens, conv_id, n, 0, 0, 0, sha]
        parents = []
        for child in below:
            key = _at(child[0], depth)
            node = nodes.get(key)
            if node is None:
                nodes[key] = node = [child[0], child[1], child[2], 0, 0, 0, 0, _NONE_SHA]
            node[2] = min(node[2], child[2])
            node[3] += child[3]
            node[4] += 1
            node[5] += child[5]
            node[6] += child[6]
            parents.append(node)
        for child, parent in zip(below, parents):
            yield depth + 1, _at(child[0], depth + 1), _at(child[0], depth), child[2], parent[2], *child[3:]
        for node in nodes.values():
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[1][depth - 1]
        below = list(nodes.values())
    for node in below:
        yield top, _at(node[0], top), _at(node[0], top - 1), node[2], None, *node[3:]


def _subtrees(top: int):
    """Task: sequences sorted by their digest at depth ``top``; whole subtrees are peeled, small ones together."""
    def made(batches):
        held, turns, last = [], 0, None
        for path, lens, conv_id, n, sha in _rows(batches):
            key = _at(path, top)
            if turns >= _TOGETHER and key != last:
                yield from peeled(held, top)
                held, turns = [], 0
            held.append((path, lens, conv_id, n, sha or _NONE_SHA))
            turns, last = turns + len(lens), key
        yield from peeled(held, top)

    return lambda batches: _gathered(made(batches), _NODE_ROWS)


def _digest_at(depth: int):
    """Column: digest of a path's first ``depth`` turns."""
    return F.substring("path", (depth - 1) * _ID + 1, _ID) if depth else F.lit(_ROOT)


def prefix_trie(sequences: DataFrame, *, subtree_ends: int = SUBTREE_ENDS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``sequences`` are those of ``rebuilt``, each id once.  ``conv_id`` is the least
    member, ``saved_tokens`` what storing each turn of the node's subtree once saves
    in code points, ``ends_sha256`` the digest of the ids that end at the node, in
    ascending order, comma-joined.  Sequences without turns end at the root.  No
    sequences give no nodes, not even the root; equal ones are one path.

    Runs jobs.  Equal sequences are shuffled with their ids once, sorted, and hashed
    as they stream by: a task holds none of an end's ids.  Subtrees of at most
    ``subtree_ends`` sequences are peeled by tasks; above the least depth (doubling from
    1) at which all are that small, every depth is one aggregate with a map-side
    part, stored in the shared folder before the next.
    """
    spark = sequences.sparkSession
    ship(spark)
    ends = written(sequences.repartition("path").sortWithinPartitions("path", "conv_id").select(
        "conv_id", "path", "lens").mapInArrow(_ends, "path binary, lens array<int>, conv_id long, n long, sha string"))
    top = 1
    while True:
        most = ends.where(F.size("lens") >= top).groupBy(_digest_at(top)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most is None or most <= subtree_ends:
            break
        top *= 2
    bottom = written(
        ends.where(F.size("lens") >= top).repartition(_digest_at(top)).sortWithinPartitions(_digest_at(top)).select(
            "path", "lens", "conv_id", "n", F.col("sha")).mapInArrow(_subtrees(top), _NODES))
    # What is above the small subtrees: a path's digests and lengths down to the depth that is left.
    kept = written(ends.where(F.size("lens") < top))
    lens_of = ends.where(F.size("lens") >= top).groupBy(_digest_at(top).alias("node")).agg(
        F.min(F.struct(F.substring("path", 1, top * _ID).alias("path"), F.slice("lens", 1, top).alias("lens"))).alias("of"))
    below = bottom.where(F.col("depth") == top).join(lens_of, "node").select(
        F.col("of.path").alias("path"), F.col("of.lens").alias("lens"), "conv_id", "n_convs", "n_leaves", "saved_tokens")
    levels = []
    for depth in range(top - 1, -1, -1):
        ended = kept.where(F.size("lens") == depth).select(
            "path", "lens", "conv_id", F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"), F.lit(0).cast("long").alias("child"), "sha")
        met = below.select("*", F.lit(1).cast("long").alias("child"), F.lit(None).cast("string").alias("sha")).unionByName(ended)
        last = F.element_at("lens", depth) if depth else F.lit(0)
        nodes = met.groupBy(_digest_at(depth).alias("node")).agg(
            F.min(F.struct(F.substring("path", 1, depth * _ID).alias("path"), F.slice("lens", 1, depth).alias("lens"))).alias("of"),
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"),
            F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved"),
            F.coalesce(F.max("sha"), F.lit(_NONE_SHA)).alias("ends_sha256"))
        nodes = nodes.select("node", "of.path", "of.lens", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")
        nodes = written(nodes.select(
            F.lit(depth).alias("depth"), "node", (_digest_at(depth - 1) if depth else F.lit(None).cast("binary")).alias("parent"),
            "path", "lens", "conv_id", "n_convs", "n_children", "n_leaves",
            (F.col("saved") + (F.col("n_convs") - 1) * last).alias("saved_tokens"), "ends_sha256"))
        levels.append(nodes)
        below = nodes.select("path", "lens", "conv_id", "n_convs", "n_leaves", "saved_tokens")
    names = ["depth", "node", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = levels[0].select(*names)
    for level in levels[1:]:
        upper = upper.unionByName(level.select(*names))
    known = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hanging = upper.unionByName(bottom.where(F.col("depth") == top).select(*names)).join(known, "parent", "left")
    return hanging.unionByName(bottom.where(F.col("depth") > top).select(*hanging.columns)).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256")
