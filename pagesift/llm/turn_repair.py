"""Conversation structure repair: the cheapest edits to well-formed turns, by a dynamic program with square-root checkpoints.

A row's first fault counts: blank (nothing but blanks), duplicate (role and text seen earlier in the conversation), truncated (its last character that is no blank is none of
``.!?``). Edits, in the order of the rows: Keep costs nothing, Delete 3, Rerole to user or assistant 2, Insert an empty turn of user or assistant 2; a truncated row that isn't deleted
costs 1 more; blank and duplicate rows must be deleted. What stays has to be nothing, or an optional system turn and then pairs of user and assistant. Roles are told
apart by their first character. Of the cheapest edits those count whose initials are least in ASCII order.

The program knows four states: nothing yet, after the system turn, after a user, after an assistant. A cost vector says what the rest of a conversation costs from each state.
Vectors are computed backwards, and kept for each block of about the square root of the rows only. Then the edits are walked forwards: the vectors of a
block are computed once more from the checkpoint behind it, and in each state the least letter is taken whose cost and remaining cost make up the vector's. Letter and state decide the next
state, so nothing has to be looked at twice.

Rows are shuffled once, by conversation, each in two copies: one with its digest and flags, and one with its texts that is sorted behind all of the first kind. So a task knows
the edits before the texts come by, and holds one byte and one digest per row of a conversation, never its texts. The audit of a conversation is one value and
its digest is taken over texts in order, so one task reads one conversation; it reads it as a stream.

Null roles and texts are one space. Rows are sorted by turn, nulls first, then by role and by a digest of both; repeated rows are repeats. Null ids are one conversation. Other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import ship

FINE, TRUNCATED, DUPLICATE, BLANK = 0, 1, 2, 3
#: what a role's first character is to the program
OTHER, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: states: what the last turn was
NOTHING, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = 0, 1, 2, 3
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
NEVER = 1 << 60
#: (state after a user or an assistant was added) from each state
_ADDED = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
_KEPT = {
    (NOTHING, SYSTEM): AFTER_SYSTEM,
    (NOTHING, USER): AFTER_USER,
    (AFTER_SYSTEM, USER): AFTER_USER,
    (AFTER_ASSISTANT, USER): AFTER_USER,
    (AFTER_USER, ASSISTANT): AFTER_ASSISTANT,
}
#: two adjacent roles that are right
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Vector = tuple[int, int, int, int]


def _with_inserts(v: list[int]) -> Vector:
    """A cost vector once empty turns may be inserted first; two in a row lead from any state to ``AFTER_ASSISTANT``."""
    user, assistant = min(v[AFTER_USER], INSERT_COST + v[AFTER_ASSISTANT]), min(v[AFTER_ASSISTANT], INSERT_COST + v[AFTER_USER])
    return min(v[NOTHING], INSERT_COST + user), min(v[AFTER_SYSTEM], INSERT_COST + user), user, assistant


END: Vector = _with_inserts([0, NEVER, NEVER, 0])


def moves(role: int, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, next state, cost) of what may become of a row."""
    out = [("D", state, DELETE_COST)]
    if fault < DUPLICATE:
        more = TRUNCATED_COST * (fault == TRUNCATED)
        if (state, role) in _KEPT:
            out.append(("K", _KEPT[state, role], more))
        out.append(("R", _ADDED[state], REROLE_COST + more))
    return out


#: moves of every kind of row, role * 4 + fault, from every state
_MOVES = [[moves(code >> 2, code & 3, state) for state in range(4)] for code in range(16)]


def before(code: int, rest: Vector) -> Vector:
    """The cost vector in front of a row from the one behind it."""
    return _with_inserts([min(cost + rest[to] for _, to, cost in choices) for choices in _MOVES[code]])


def vectors(codes: bytes, rest: Vector) -> list[Vector]:
    """The cost vector in front of each row, and ``rest``, the one behind all."""
    out = [rest]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def checkpoints(codes: bytes, block: int) -> list[Vector]:
    """The cost vectors in front of rows 0, ``block``, 2 * ``block`` ..., and behind the last."""
    kept, v = [END], END
    for at in range(len(codes) - 1, -1, -1):
        v = before(codes[at], v)
        if at % block == 0:
            kept.append(v)
    return kept[::-1]


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows, given as role * 4 + fault."""
    n = len(codes)
    block = max(1, int(n**0.5))
    marks = checkpoints(codes, block)
    state, letters = NOTHING, []

    def inserted(state: int, v: Vector, choices) -> int:
        """Insert as long as that is cheapest and no smaller letter is."""
        while True:
            fits = [letter for letter, to, cost, rest in choices(state) if cost + rest[to] == v[state]]
            if "D" in fits or v[_ADDED[state]] + INSERT_COST != v[state]:
                return state
            letters.append("I")
            state = _ADDED[state]

    for number, start in enumerate(range(0, n, block)):
        own = codes[start : start + block]
        rest = vectors(own, marks[number + 1])
        for i, code in enumerate(own):
            behind = rest[i + 1]
            state = inserted(state, rest[i], lambda s: [(*m, behind) for m in _MOVES[code][s]])
            letter, state = min((m[0], m[1]) for m in _MOVES[code][state] if m[2] + behind[m[1]] == rest[i][state])
            letters.append(letter)
    inserted(state, END, lambda s: [])
    return marks[0][NOTHING], "".join(letters)


class _Conversation:
    """What a task holds of the conversation that comes by."""

    def __init__(self):
        self.roles, self.flags, self.digests = bytearray(), bytearray(), []
        self.turns, self.last, self.low, self.high = 0, None, None, None
        self.audit = None

    def add(self, turn: int | None, role: int, flag: int, digest: bytes) -> None:
        self.roles.append(role)
        self.flags.append(flag)
        self.digests.append(digest)
        if turn is not None:
            self.turns += turn != self.last
            self.low = turn if self.low is None else self.low
            self.last = self.high = turn

    def decide(self) -> None:
        roles, flags = (np.frombuffer(bytes(x), np.uint8) for x in (self.roles, self.flags))
        seen = np.ones(len(roles), bool)
        if len(roles):
            first = np.unique(np.array(self.digests, "S32"), return_index=True)[1]
            seen[first] = False
        faults = np.where(flags == BLANK, BLANK, np.where(seen, DUPLICATE, flags))
        self.digests = []
        self.counts = [int((faults == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)]
        legal = np.zeros(16, bool)
        legal[[a * 4 + b for a, b in _LEGAL]] = True
        self.illegal = int((~legal[roles[:-1] * 4 + roles[1:]]).sum())
        self.cost, self.audit = repair((roles * 4 + faults).astype(np.uint8).tobytes())
        self.at, self.state, self.sha, self.some = 0, NOTHING, sha256(), False

    def write(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = _ADDED[self.state]
            self.write("user" if self.state == AFTER_USER else "assistant", "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEPT[self.state, INITIALS[role[0]]]
            self.write(role, text)
        elif letter == "R":
            self.state = _ADDED[self.state]
            self.write("user" if self.state == AFTER_USER else "assistant", text)

    def result(self) -> tuple:
        if self.audit is None:
            self.decide()
        self.inserts()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts, self.illegal, self.cost, self.audit, self.sha.hexdigest())


def _rows_of(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _results(batches):
    """One row per conversation from rows (conv, part, turn, role, flag, digest, text), sorted by the first three."""
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = ["conv", *(x.split()[0] for x in SCHEMA.split(", "))]
    known, conversation, out = object(), None, []

    def flush():
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate([pa.string(), *kinds])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for conv, part, turn, role, flag, digest, text in _rows_of(batches):
        if conversation is None or conv != known:
            if conversation:
                out.append((known, *conversation.result()))
                if len(out) >= 1000:
                    yield flush()
                    out = []
            known, conversation = conv, _Conversation()
        if part == 1:
            conversation.add(turn, INITIALS.get(role[:1], OTHER), flag, digest)
        elif part == 2:
            if conversation.audit is None:
                conversation.decide()
            conversation.text(role, text)
    if conversation:
        out.append((known, *conversation.result()))
        yield flush()


def fault_of(text: Column) -> Column:
    """BLANK, TRUNCATED or FINE."""
    rest = F.rtrim(text, F.lit(BLANKS))
    return F.when(rest == "", BLANK).when(F.substring(rest, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """(conv, SCHEMA) of every conversation; where ``gone`` is true a row is not there, but its conversation is."""
    ship(rows.sparkSession)
    kind = rows.schema[conv].dataType.simpleString()
    body, name = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    there = F.lit(True) if gone is None else ~F.coalesce(gone, F.lit(False))
    narrow = rows.select(
        F.col(conv).cast("string").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        name.alias("role"),
        fault_of(body).alias("flag"),
        F.sha2(F.concat(F.char_length(name).cast("string"), F.lit(":"), name, body).cast("binary"), 256).alias("digest"),
        body.alias("text"),
        F.explode(F.when(there, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("part"),
    )
    digest = F.unhex(F.substring("digest", 1, 32))
    sent = narrow.select(
        "conv", "part", "turn", "role", "flag", F.hex(digest).cast("binary").alias("digest"), F.when(F.col("part") == 2, F.col("text")).alias("text")
    )
    order = ["conv", "part", F.asc_nulls_first("turn"), "role", "digest"]
    dealt = sent.repartition("conv").sortWithinPartitions(*order)
    found = dealt.mapInArrow(_results, "conv string, " + SCHEMA)
    return found.select(F.col("conv").cast(kind).alias(conv), *(x.split()[0] for x in SCHEMA.split(", ")))
