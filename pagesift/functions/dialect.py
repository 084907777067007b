"""User patterns as syntax trees: printed for Java, measured for what a cut in the text does to them.

The tree is the one Python's own compiler reads from a pattern, so every sign means what it means there: inside a class a bracket or ``&&`` is text. A
printed pattern says the same in Java's spelling, each doubtful character escaped.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable
from re import _constants as sre
from re import _parser

NEWLINE = 10

#: fixed values: how categories and places are written in Java
_CATEGORIES = {
    sre.CATEGORY_DIGIT: r"\d",
    sre.CATEGORY_NOT_DIGIT: r"\D",
    sre.CATEGORY_SPACE: r"\s",
    sre.CATEGORY_NOT_SPACE: r"\S",
    sre.CATEGORY_WORD: r"\w",
    sre.CATEGORY_NOT_WORD: r"\W",
}
_PLACES = {
    sre.AT_BEGINNING: r"(?<![^\n])",  # also behind the last line break, where Java's own sign doesn't match
    sre.AT_END: "$",
    sre.AT_BEGINNING_STRING: r"\A",
    sre.AT_END_STRING: r"\z",
    sre.AT_BOUNDARY: r"\b",
    sre.AT_NON_BOUNDARY: r"\B",
}
_WITH_NEWLINE = {sre.CATEGORY_SPACE, sre.CATEGORY_NOT_DIGIT, sre.CATEGORY_NOT_WORD}
_REPEATS = {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}
_LOOKS = {(sre.ASSERT, 1): "?=", (sre.ASSERT, -1): "?<=", (sre.ASSERT_NOT, 1): "?!", (sre.ASSERT_NOT, -1): "?<!"}
_FLAGS = {re.I: "i", re.M: "m", re.S: "s"}


class Unreadable(ValueError):
    """A pattern that Python does not compile, or that Java has no spelling for."""


def tree(pattern: str) -> tuple[list, int]:
    """(nodes, global flags) of a pattern."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # brackets and set signs in classes, which are text
            parsed = _parser.parse(pattern, re.I | re.M)
    except (re.error, RecursionError, OverflowError) as error:
        raise Unreadable(f"{error}: {pattern}") from None
    if parsed.state.flags & re.ASCII:
        raise Unreadable(f"ASCII classes: {pattern}")
    return list(parsed), parsed.state.flags


def _char(code: int) -> str:
    c = chr(code)
    if c.isascii() and not c.isalnum():
        return f"\\{c}" if c.isprintable() and c != " " else f"\\x{{{code:x}}}" if c != " " else " "
    return c if c.isalnum() and code < 0xD800 else f"\\x{{{code:x}}}"


def _class(items: list) -> str:
    out = []
    for op, value in items:
        if op is sre.NEGATE:
            out.append("^")
        elif op is sre.LITERAL:
            out.append("\\x{20}" if value == 32 else _char(value))
        elif op is sre.RANGE:
            out.append(f"\\x{{{value[0]:x}}}-\\x{{{value[1]:x}}}")
        else:
            out.append(_CATEGORIES[value])
    return f"[{''.join(out)}]"


def _quantifier(low: int, high: int) -> str:
    if high is sre.MAXREPEAT:
        return {0: "*", 1: "+"}.get(low, f"{{{low},}}")
    return "?" if (low, high) == (0, 1) else f"{{{low},{high}}}"


def _single(nodes: list) -> bool:
    return len(nodes) == 1 and nodes[0][0] in (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN, sre.SUBPATTERN)


def _flagged(text: str, add: int, drop: int) -> str:
    on, off = ("".join(c for f, c in _FLAGS.items() if flags & f) for flags in (add, drop))
    return f"(?{on}{'-' * bool(off)}{off}:{text})"


def _node(op, value, loose: bool) -> str:
    """One node in Java. ``loose`` leaves out what looks without reading, groups' numbers and atoms, so it matches at least as much."""
    if op is sre.LITERAL:
        return _char(value)
    if op is sre.NOT_LITERAL:
        return f"[^{_char(value) if value != 32 else '\\x{20}'}]"
    if op is sre.ANY:
        return "."
    if op is sre.IN:
        return _class(value)
    if op is sre.BRANCH:
        return f"(?:{'|'.join(printed(list(x), loose) for x in value[1])})"
    if op is sre.SUBPATTERN:
        group, add, drop, nodes = value
        text = printed(list(nodes), loose)
        if group is not None:
            return f"(?:{text})" if loose else f"({text})"
        return _flagged(text, add, drop)
    if op in _REPEATS:
        low, high, nodes = value
        text = printed(list(nodes), loose)
        return (text if _single(list(nodes)) else f"(?:{text})") + _quantifier(low, high) + ("" if loose else _REPEATS[op])
    if op is sre.ATOMIC_GROUP:
        return f"(?{':' if loose else '>'}{printed(list(value), loose)})"
    if op in (sre.ASSERT, sre.ASSERT_NOT):
        return "" if loose else f"({_LOOKS[op, value[0]]}{printed(list(value[1]), False)})"
    if op is sre.AT:
        return "" if loose else _PLACES[value]
    if op is sre.GROUPREF and not loose:
        return f"(?:\\{value})"
    if op is sre.FAILURE:
        return "(?!)"
    raise Unreadable(f"no spelling for {op}")


def printed(nodes: list, loose: bool = False) -> str:
    return "".join(_node(op, value, loose) for op, value in nodes)


def java(pattern: str) -> str:
    """The pattern in Java's spelling, from its tree."""
    nodes, flags = tree(pattern)
    text = printed(nodes)
    return f"(?s:{text})" if flags & re.S else text


def _parts(op, value) -> list[list]:
    """The node lists inside a node."""
    if op is sre.BRANCH:
        return [list(x) for x in value[1]]
    if op is sre.SUBPATTERN:
        return [list(value[3])]
    if op in _REPEATS:
        return [list(value[2])]
    if op is sre.ATOMIC_GROUP:
        return [list(value)]
    if op in (sre.ASSERT, sre.ASSERT_NOT):
        return [list(value[1])]
    return []


def _any(nodes: Iterable, holds: Callable[[object, object], bool]) -> bool:
    return any(holds(op, value) or any(_any(part, holds) for part in _parts(op, value)) for op, value in nodes)


def _may_be_newline(op, value, dot: bool) -> bool:
    if op is sre.LITERAL:
        return value == NEWLINE
    if op is sre.NOT_LITERAL:
        return value != NEWLINE
    if op is sre.ANY:
        return dot
    if op is sre.IN:
        items = [x for x in value if x[0] is not sre.NEGATE]
        hit = any(
            (o is sre.LITERAL and v == NEWLINE) or (o is sre.RANGE and v[0] <= NEWLINE <= v[1]) or (o is sre.CATEGORY and v in _WITH_NEWLINE)
            for o, v in items
        )
        return hit != (len(items) < len(value))
    return False


def crosses_lines(pattern: str) -> bool:
    """May a match, or what it looks at, hold a line break? A pattern without a tree may."""
    try:
        nodes, flags = tree(pattern)
    except Unreadable:
        return True
    dot = bool(flags & re.S) or _any(nodes, lambda op, v: op is sre.SUBPATTERN and bool(v[1] & re.S))
    return _any(nodes, lambda op, v: _may_be_newline(op, v, dot))


def needs_whole_text(pattern: str) -> bool:
    """Does a match depend on more than the text from where it starts: the text's ends, an earlier line, what a group held before?

    A pattern with a property or another sign that only its own library knows has no tree, and counts as such.
    """
    try:
        nodes, flags = tree(pattern)
    except Unreadable:
        return True
    dot = bool(flags & re.S) or _any(nodes, lambda op, v: op is sre.SUBPATTERN and bool(v[1] & re.S))

    def far(op, value) -> bool:
        if op in (sre.GROUPREF, sre.GROUPREF_EXISTS):
            return True
        if op is sre.AT:
            return value in (sre.AT_BEGINNING_STRING, sre.AT_END_STRING)
        back = op in (sre.ASSERT, sre.ASSERT_NOT) and value[0] < 0
        return back and _any(list(value[1]), lambda o, v: _may_be_newline(o, v, dot))

    return _any(nodes, far)


def _begun(nodes: list, rest: str) -> str:
    """What a match has read of ``nodes`` when the text ends, then ``rest`` if it has read them all."""
    for op, value in reversed(nodes):
        rest = _begun_node(op, value, rest)
    return rest


def _begun_node(op, value, rest: str) -> str:
    whole = _node(op, value, True) + rest
    if op is sre.AT:
        return rest
    if op is sre.BRANCH:
        inner = [_begun(list(x), "") for x in value[1]]
    elif op is sre.SUBPATTERN:
        group, add, drop, nodes = value
        inner = [_flagged(_begun(list(nodes), ""), add, drop)]
    elif op in _REPEATS:
        low, high, nodes = value
        before = "*" if high is sre.MAXREPEAT else f"{{0,{max(0, high - 1)}}}"
        inner = [f"(?:{printed(list(nodes), True)}){before}{_begun(list(nodes), '')}"] if high else []
    elif op is sre.ATOMIC_GROUP:
        inner = [_begun(list(value), "")]
    elif op in (sre.ASSERT, sre.ASSERT_NOT):
        inner = [_begun(list(value[1]), "")] if value[0] > 0 else []
    else:
        inner = []
    return f"(?:{'|'.join(['', *inner, whole])})"


def open_end(pattern: str) -> str:
    """A pattern that deletes a text but for places from which a match reaches the text's end, complete or not.

    It goes over a text as a search does: from each place a whole match is passed over, or else one character. At a place from where the text is used up it matches
    nothing. So what it leaves tells that more text could change, or add, a match. It never takes such a place for a safe one.
    """
    nodes, flags = tree(pattern)
    own, begun = printed(nodes), _begun(nodes, "")
    if flags & re.S:
        own, begun = f"(?s:{own})", f"(?s:{begun})"
    return f"(?!{begun}\\z)(?:(?>{own})|(?s:.))"
