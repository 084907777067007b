"""Chat formatting by schema fingerprints: records of many layouts become canonical turns, then one text with a loss mask.

A record is a struct, as ``spark.read.json`` makes it of files that differ: the union of all fields, null where a record lacks one. Which nested paths a
record holds (``messages[].role``) is its schema; the 64-bit hash of the sorted paths is its fingerprint, and that selects a declarative mapping
from ``LAYOUTS``. A mapping names the fields of an exchange with their roles, or a list of messages with the fields for role and text. No layout has to be told
beforehand, and new ones are rows of the table. A record that no mapping fits stays, with null turns.

Turns are written with the marks of ``MARKS``. Text can't close a turn: a backslash is doubled, and a control string gets one behind its first character, so
none is left in it; a single backslash is never text, so this is reversed exactly. The mask gives per turn how many code points stand before, under and behind the
loss; only assistants' texts are under it, without marks. ``read_back`` takes turns and trained text from the output alone.

Everything is built-in expressions on single rows; nothing is shuffled here. ``conversation_records`` gathers the rows of a conversation with one
shuffle; a conversation is one value of the output, so it has to fit in one row (2 GB), however many there are.

Null texts and roles are empty strings once rows are gathered; in a record a null field is a missing one, and null texts in a list are empty. An unknown role is
written with its name. Rows of equal turn are ordered by role, then text; repeated rows are turns of their own; null ids are one conversation. Columns beside the record keep
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

SEED = 42


@dataclass(frozen=True)
class Exchange:
    """One exchange: (role, paths) per turn; present texts of several paths are joined by an empty line."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    @property
    def paths(self) -> list[str]:
        return [p for _, paths in self.turns for p in paths]


@dataclass(frozen=True)
class Messages:
    """A list of messages; ``roles`` translates names of roles."""

    at: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()
    #: a list whose roles or texts are all null, or that is empty, lacks these paths
    @property
    def paths(self) -> list[str]:
        return [self.at, f"{self.at}[].{self.role}", f"{self.at}[].{self.text}"]

    @property
    def optional(self) -> tuple[str, ...]:
        return tuple(self.paths[1:])


#: how layouts map to turns; paths lead through structs by dots
LAYOUTS: dict[str, Exchange | Messages] = {
    "prompt": Exchange((("user", ("prompt",)), ("assistant", ("response",)))),
    "completion": Exchange((("user", ("prompt",)), ("assistant", ("completion",)))),
    "question": Exchange((("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",))), ("system_prompt",)),
    "instruction": Exchange((("user", ("instruction", "input")), ("assistant", ("output",))), ("input",)),
    "messages": Messages("messages", "role", "content"),
    "shares": Messages("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    "dialogue": Messages("dialogue.turns", "speaker", "utterance", (("bot", "assistant"),)),
}

#: fixed marks of the template: what opens and closes a turn of each role, and the parts of a turn of any other role
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
TRAINED = "assistant"

_CONTROL = [m for marks in MARKS.values() for m in marks] + list(OTHER)
_BEHIND = {c: "|".join(re.escape(m[1:]) for m in _CONTROL if m[0] == c) for c in "<["}
_BREAK = "|".join(f"{re.escape(c)}(?={rest})" for c, rest in _BEHIND.items())
_TURN = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in [*MARKS.values(), (OTHER[0], OTHER[2])])

TURNS = "array<struct<role:string,text:string>>"


def fingerprint_of(paths: list[str]) -> int:
    """The fingerprint of a record that holds these paths, as a signed 64-bit number."""
    number = xxh64_intdigest("\n".join(sorted(paths)), SEED)
    return number - (1 << 64) if number >> 63 else number


def fingerprints_of(layout: Exchange | Messages) -> list[int]:
    """Those of all records that a layout fits: with and without each optional path."""
    fixed = [p for p in layout.paths if p not in layout.optional]
    return [fingerprint_of([*fixed, *some]) for n in range(len(layout.optional) + 1) for some in combinations(layout.optional, n)]


def _quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def present_paths(record: str, kind: T.StructType) -> list[tuple[str, Column]]:
    """(path, whether a record holds it) of all nested fields; of a list of structs, the fields that any element holds."""

    def any_has(field: str):
        return lambda x: x.getField(field).isNotNull()

    def walk(kind: T.StructType, prefix: str, value: Column) -> list[tuple[str, Column]]:
        out = []
        for field in kind.fields:
            path, at = prefix + field.name, value.getField(field.name)
            element = getattr(field.dataType, "elementType", None)
            if isinstance(field.dataType, T.StructType):
                out += walk(field.dataType, path + ".", at)
                continue
            out.append((path, at.isNotNull()))
            if isinstance(element, T.StructType):
                out += [(f"{path}[].{f}", F.coalesce(F.exists(at, any_has(f)), F.lit(False))) for f in element.names]
        return out

    return walk(kind, "", F.col(record))


def fingerprint(record: str, kind: T.StructType) -> Column:
    """The hash of the sorted paths that each record holds."""
    held = [F.when(holds, F.lit(path)) for path, holds in sorted(present_paths(record, kind), key=lambda p: p[0])]
    return F.xxhash64(F.concat_ws("\n", *held))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _has(kind: T.DataType, path: str) -> bool:
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return False
        kind = kind[name].dataType
    return True


def _element(kind: T.DataType, path: str) -> T.DataType:
    for name in path.split("."):
        kind = kind[name].dataType
    return getattr(kind, "elementType", None)


def turns_by(layout: Exchange | Messages, record: str, kind: T.StructType) -> Column | None:
    """The turns of a record of this layout; None if records of this type can't have it."""
    if isinstance(layout, Messages):
        element = _element(kind, layout.at) if _has(kind, layout.at) else None
        if not element or not (_has(element, layout.role) and _has(element, layout.text)):
            return None

        def turn(m):
            role = m.getField(layout.role)
            for name, meant in layout.roles:
                role = F.when(m.getField(layout.role) == name, F.lit(meant)).otherwise(role)
            return _turn(F.coalesce(role, F.lit("")), F.coalesce(m.getField(layout.text), F.lit("")))

        return F.transform(F.col(f"{record}.{_quoted(layout.at)}"), turn)
    if not all(_has(kind, p) for p in layout.paths if p not in layout.optional):
        return None
    out = []
    for role, paths in layout.turns:
        own = [F.col(f"{record}.{_quoted(p)}") for p in paths if _has(kind, p)]
        if own:
            text = own[0] if len(own) == 1 else F.concat_ws("\n\n", *own)
            out.append(F.when(F.coalesce(*own).isNotNull(), _turn(F.lit(role), text)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def canonical(df: DataFrame, record: str = "record", layouts: dict[str, Exchange | Messages] | None = None) -> DataFrame:
    """``df`` with ``fingerprint``, ``layout`` (null: none fits) and ``turns`` of its records in place of ``record``."""
    kind = df.schema[record].dataType
    marked = df.withColumn("fingerprint", fingerprint(record, kind))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for title, layout in (layouts or LAYOUTS).items():
        made = turns_by(layout, record, kind)
        if made is not None:
            fits = F.col("fingerprint").isin(fingerprints_of(layout))
            name, turns = F.when(fits, F.lit(title)).otherwise(name), F.when(fits, made).otherwise(turns)
    return marked.withColumns({"layout": name, "turns": turns}).drop(record)


def escaped(text: Column) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _marks(role: Column) -> tuple[Column, Column]:
    before, behind = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (a, b) in MARKS.items():
        before, behind = F.when(role == name, F.lit(a)).otherwise(before), F.when(role == name, F.lit(b)).otherwise(behind)
    return before, behind


def formatted(df: DataFrame) -> DataFrame:
    """``df`` with ``formatted`` and ``mask`` (per turn: code points before, under and behind the loss) in place of ``turns``; no turns: an empty text."""

    def piece(turn):
        before, behind = _marks(turn["role"])
        return F.struct(turn["role"].alias("role"), before.alias("before"), escaped(turn["text"]).alias("text"), behind.alias("behind"))

    def masked(p):
        size, trained = F.char_length(p["text"]), p["role"] == TRAINED
        return F.struct(
            (F.char_length(p["before"]) + F.when(trained, 0).otherwise(size)).alias("before"),
            F.when(trained, size).otherwise(0).alias("loss"),
            F.char_length(p["behind"]).alias("behind"),
        )

    pieces = df.withColumn("_pieces", F.coalesce(F.transform("turns", piece), F.array().cast("array<struct<role:string,before:string,text:string,behind:string>>")))
    joined = F.array_join(F.transform("_pieces", lambda p: F.concat(p["before"], p["text"], p["behind"])), "")
    return pieces.withColumns({"formatted": joined, "mask": F.transform("_pieces", masked)}).drop("turns", "_pieces")


def read_back(df: DataFrame) -> DataFrame:
    """``df`` with the turns that ``formatted`` holds, and ``trained``, the text under ``mask``, unescaped."""

    def turn(p):
        def between(a, b):
            return unescaped(F.substr(p, F.lit(len(a) + 1), F.char_length(p) - len(a) - len(b)))

        head = F.substring_index(p, OTHER[1], 1)
        start = F.char_length(head) + len(OTHER[1])
        out = _turn(
            unescaped(F.substr(head, F.lit(len(OTHER[0]) + 1))),
            unescaped(F.substr(p, start + 1, F.char_length(p) - start - len(OTHER[2]))),
        )
        for name, (a, b) in MARKS.items():
            out = F.when(F.startswith(p, F.lit(a)), _turn(F.lit(name), between(a, b))).otherwise(out)
        return out

    def under(p, m):
        return unescaped(F.substr(p, m["before"] + 1, m["loss"]))

    pieces = df.withColumn("_pieces", F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)))
    trained = F.array_join(F.zip_with("_pieces", "mask", under), "")
    return pieces.withColumns({"turns": F.transform("_pieces", turn), "trained": trained}).drop("_pieces")


def conversation_records(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, record): the rows of each conversation by turn, as a record of the layout that datasets of its kind come in.

    One exchange is a prompt, or a question if a system turn is before it; other conversations are lists of messages, some of them as shared ones, if all
    their roles have a name there.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    gathered = rows.groupBy(F.col(conv).alias("_conv")).agg(F.sort_array(F.collect_list(said)).alias("_said"))
    roles = F.transform("_said", lambda x: x["role"])
    kind = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), "prompt")
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "question")
        .when(F.forall(roles, lambda r: r.isin("system", "user", "assistant")) & (F.crc32(F.col("_conv").cast("string")) % 2 == 0), "shares")
        .otherwise("messages")
    )
    first, second, third = (F.get("_said", F.lit(i))["text"] for i in range(3))
    shared = {"user": "human", "assistant": "gpt"}

    def share(x):
        name = x["role"]
        for own, there in shared.items():
            name = F.when(x["role"] == own, F.lit(there)).otherwise(name)
        return F.struct(name.alias("from"), x["text"].alias("value"))

    is_prompt, is_question = F.col("_kind") == "prompt", F.col("_kind") == "question"
    record = F.struct(
        F.when(is_prompt, first).alias("prompt"),
        F.when(is_question, first).alias("system_prompt"),
        F.when(is_question, second).alias("question"),
        F.when(is_prompt, second).when(is_question, third).alias("response"),
        F.when(F.col("_kind") == "messages", F.transform("_said", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
        F.when(F.col("_kind") == "shares", F.transform("_said", share)).alias("conversations"),
    )
    return gathered.withColumn("_kind", kind).select(F.col("_conv").alias(conv), record.alias("record"))
