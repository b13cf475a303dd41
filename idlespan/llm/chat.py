"""Chat formatting: a declared state machine checks the turns, a declared template writes them.

Everything is DataFrame work.  A conversation becomes one text, made of segments
that each say whether they bear loss, and can be read back from that text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlespan.llm.frames import picked


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written and which order of roles is right.

    ``start`` + role + newline + text + ``end`` make a turn.  Both marks must begin
    with ``<|`` and hold it once: texts get a backslash between these two
    characters, and their backslashes doubled, so that no text holds a mark.
    ``moves`` maps (state, role) to the next state; ``final`` are the states a
    conversation may end in.  Roles in ``loss`` bear loss on their texts.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    first: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "instructed",
        ("start", "user"): "asked",
        ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })

    def __post_init__(self):
        if any(not m.startswith("<|") or m.count("<|") != 1 for m in (self.start, self.end)):
            raise ValueError("marks begin with <| and hold it once")


CHAT_ML = ChatTemplate()
#: State after a role that no move allows; it has no way out.
REJECTED = "rejected"


def escaped(text: Column) -> Column:
    """Backslashes doubled, then ``<|`` parted by one backslash: holds no ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given: only it puts a single backslash between ``<`` and ``|``."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _state(roles: Column, template: ChatTemplate) -> Column:
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(roles, F.lit(template.first), lambda state, role: F.coalesce(
        moves[F.concat(state, F.lit("\n"), role)], F.lit(REJECTED)))


def format_chats(turns: DataFrame, template: ChatTemplate = CHAT_ML, *, conv_id: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments, end_state, valid``.

    ``segments`` is an array of (text, loss): mark and role, escaped text, end mark
    of each turn; joined they are ``formatted``.  ``valid`` says that the roles led
    to a final state.  Conversations in a wrong order are formatted all the same.

    Turns go by turn number, nulls first; ties by role, then text; repeated rows are
    repeated turns.  A null role or text counts as empty (an empty role is not
    allowed by any move).  A null conv_id is a conversation of its own.  An empty
    table gives no rows; other columns do not matter.  All turns of a conversation
    meet in one row, since the result is one text: a conversation must fit in a
    Spark cell (2 GB); nothing else is gathered.
    """
    rows = picked(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.start), _role_out(t.role), F.lit("\n")).alias("text"),
                 F.lit(False).alias("loss")),
        F.struct(escaped(t.text).alias("text"), t.role.isin(*template.loss).alias("loss")),
        F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))))
    return (
        chats.select("conv_id", segments.alias("segments"),
                     _state(F.transform("turns", lambda t: t.role), template).alias("end_state"))
        .select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments", "end_state",
                F.col("end_state").isin(*template.final).alias("valid")))


def read_turns(formatted: Column, template: ChatTemplate = CHAT_ML) -> Column:
    """The (role, text) turns that a formatted text holds, found by its marks alone."""
    mark = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() and c != "_" else c for c in template.start)
    pieces = F.filter(F.split(formatted, mark), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        begin = F.length(role) + F.lit(2)
        text = F.substring(piece, begin, F.length(piece) - begin + F.lit(1) - F.lit(len(template.end)))
        return F.struct(_role_in(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescaped(s.text)), "")
