"""User patterns are written for a Python-style regex dialect and run on Java's.

``FLAGS`` gives Java the same defaults (ignore case, multiline, Unicode classes, only a newline
ends a line). Classes that Java would read in another way are printed anew (``dialect``); what has no spelling there is refused by
``lint`` rather than run with another meaning.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import dialect

FLAGS = "(?idmU)"

#: an escape in full: code points, control characters, properties, named references and names, quotes
_ESCAPE = re.compile(
    r"\\(?:x\{[^}]*\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|0(?:[0-3][0-7]{2}|[0-7]{1,2})|c.|[pPN]\{[^}]*\}|[pP].|k<[^>]*>"
    r"|Q.*?(?:\\E|$)|.)?",
    re.DOTALL,
)

#: escaped letters that stand for themselves alone, so that what follows them is text
_LONE_ESCAPES = set("dDwWsSbBAzGhHvVRntrf")

_NAMED = re.compile(r"\(\?P<(\w+)>|\(\?P=(\w+)\)")


class PatternError(ValueError):
    """A pattern that does not compile or would change its meaning."""


def _reads_classes_differently(pattern: str) -> bool:
    """Does Java see a nested class or a set operation where a bracket or a sign is meant?"""
    return any(
        in_class and (token == "[" or bool(re.match(r"&&|--|\|\||~~", pattern[i:])))
        for i, token, in_class in _tokens(pattern)
    )


def translated(pattern: str) -> str:
    """The pattern in Java's spelling: ``(?P<name>``, ``(?P=name)`` and the end of the text, ``\\Z``.

    Java's group names have no underscores, so groups are renamed by their order. A pattern whose classes Java would read
    differently is printed anew from its syntax tree.
    """
    if _reads_classes_differently(pattern):
        try:
            return dialect.java(pattern)
        except dialect.Unreadable as error:
            raise PatternError(str(error)) from None
    out, at, names = [], 0, {}
    for i, token, in_class in _tokens(pattern):
        if i < at:
            continue
        named = None if in_class else _NAMED.match(pattern, i)
        if named:
            opened, referred = named.groups()
            if opened:
                names[opened] = f"g{len(names) + 1}"
                out.append(f"(?<{names[opened]}>")
            elif referred in names:
                out.append(f"\\k<{names[referred]}>")
            else:
                raise PatternError(f"unknown group {referred}: {pattern}")
            at = named.end()
        else:
            out.append(r"\z" if token == r"\Z" and not in_class else token)
            at = i + len(token)
    return "".join(out)


def flagged(pattern: str) -> str:
    return FLAGS + translated(pattern)


def like(text: Column, pattern: str) -> Column:
    """Does the pattern match anywhere in the text?"""
    return F.regexp_like(text, F.lit(flagged(pattern)))


def _tokens(pattern: str) -> Iterator[tuple[int, str, bool]]:
    """Yield (offset, token, inside a character class); an escape is one token, whatever its length."""
    i, in_class = 0, False
    while i < len(pattern):
        token = _ESCAPE.match(pattern, i).group() if pattern[i] == "\\" else pattern[i]
        if token == "[" and not in_class:
            # a bracket straight after the opening one (or its caret) is a literal
            token = re.compile(r"\[\^?\]?").match(pattern, i).group()
            yield i, token, False
            in_class = True
        else:
            yield i, token, in_class
            in_class = in_class and token != "]"
        i += len(token)


def group_count(pattern: str) -> int:
    """Number of capturing groups."""
    return sum(
        token == "(" and not in_class and bool(re.match(r"\((?!\?)|\(\?P?<(?![=!])", pattern[i:]))
        for i, token, in_class in _tokens(pattern)
    )


def group_index(pattern: str) -> int:
    """The group whose text is the match: the whole match, or the only capturing group."""
    n = group_count(pattern)
    if n > 1:
        raise PatternError(f"more than one capturing group: {pattern}")
    return n


#: letters that some non-ASCII character matches when case is ignored (dotless i, Kelvin sign, long s)
_FOLDED = "iks"


def _literal_runs(pattern: str) -> Iterator[tuple[str, bool]]:
    """Yield (text, leading) for literal text that every match contains.

    ``leading`` text is what a match starts with. Only text outside groups and alternatives counts;
    patterns that switch flags, quote, or hold an escape of a character, a property or a reference give nothing.
    """
    tokens = []
    counted = False
    for _, token, in_class in _tokens(pattern):
        if token[0] == "\\" and (len(token) != 2 or token[1].isalnum() and token[1] not in _LONE_ESCAPES):
            return
        # what stands inside the braces of a repetition is no text
        if not counted:
            tokens.append((token, in_class))
        counted = not in_class and (token == "{" or counted and token != "}")
    outside = "".join(token for token, in_class in tokens if not in_class)
    if re.search(r"\(\?[^:=!<]|\(\?<(?![=!])", outside):
        return
    depth, run, leading = 0, "", True
    zero_width: list[bool] = []
    following = [token for token, _ in tokens[1:]] + [""]
    for i, ((token, in_class), after) in enumerate(zip(tokens, following)):
        if not in_class and token == "|" and depth == 0:
            raise LookupError("alternatives")
        literal = depth == 0 and not in_class and _is_literal(token)
        repeated = after in ("?", "*", "{", "+")
        if literal and not (repeated and after != "+"):
            run += token[-1]
        if literal and not repeated:
            continue
        if run:
            yield run, leading
            run = ""
        if not in_class and token == "(":
            depth += 1
            ahead = "".join(following[i : i + 3])
            zero_width.append(bool(re.match(r"\?(?:=|!|<=|<!)", ahead)))
            leading = leading and (depth > 1 or zero_width[-1])
        elif not in_class and token == ")":
            depth -= 1
            zero_width.pop()
            leading = leading and (depth > 0 or not repeated)
        elif depth == 0:
            leading = leading and token in ("^", r"\b")
    if run:
        yield run, leading


def _is_literal(token: str) -> bool:
    if token[0] == "\\":
        return len(token) == 2 and not token[1].isalnum() and token[1].isascii()
    return len(token) == 1 and token.isascii() and token not in ".^$|()[]{}?*+\\"


def literals(pattern: str) -> tuple[str, str]:
    """(leading, required) literal text of a pattern, either may be empty.

    A match starts with the first. The second, in lower case, is contained in the lower-case form
    of every text with a match.
    """
    try:
        runs = list(_literal_runs(translated(pattern)))
    except LookupError:
        return "", ""
    leading = runs[0][0] if runs and runs[0][1] else ""
    pieces = [piece for run, _ in runs for piece in re.split(f"[{_FOLDED}]", run.lower())]
    required = max(pieces, key=len, default="")
    return leading, required


def with_leading_check(pattern: str) -> str:
    """The pattern behind a look-ahead for the text it starts with.

    The meaning is the same. A pattern that opens with a look-behind is otherwise tried in full at
    every character.
    """
    leading, _ = literals(pattern)
    if not leading or not pattern.startswith("("):
        return pattern
    return f"(?={re.sub(r'([^A-Za-z0-9])', r'\\\1', leading)}){pattern}"


def held_words(lower: Column, words: Sequence[str]) -> Column:
    """The numbers of the words that a text contains, found in one pass by one automaton, however many words there are.

    Texts go to Python workers in Arrow batches; only the numbers come back.
    """

    @F.pandas_udf("array<int>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        import pandas

        automaton = ahocorasick.Automaton()
        for number, word in enumerate(words):
            automaton.add_word(word, number)
        automaton.make_automaton()
        for batch in texts:
            yield pandas.Series([sorted({n for _, n in automaton.iter(t)}) if t else [] for t in batch])

    return find(lower)


def required_words(patterns: Iterable[str]) -> list[str]:
    """The literal texts that matches of the patterns must contain, without repeats."""
    return sorted({literals(p)[1] for p in patterns} - {""})


def find_all(content: Column, lower: Column, pattern: str) -> Column:
    """All matches of a pattern, in order: the only group of each, or the whole of it.

    ``lower`` is the lower-case content. Where it lacks text that a match must contain, the
    pattern is not run at all.
    """
    found = F.regexp_extract_all(
        content, F.lit(flagged(with_leading_check(pattern))), F.lit(group_index(pattern))
    )
    _, required = literals(pattern)
    if not required:
        return found
    return F.when(F.contains(lower, F.lit(required)), found).otherwise(F.array().cast("array<string>"))


def contains_match(content: Column, lower: Column, pattern: str) -> Column:
    """As ``like``, but the pattern is run only where its literal text is present."""
    _, required = literals(pattern)
    matched = like(content, with_leading_check(pattern))
    return F.contains(lower, F.lit(required)) & matched if required else matched


def lint(pattern: str) -> None:
    """Refuse what has no spelling in Java, and more than one group."""
    if any(in_class and pattern.startswith("[:", i) for i, _, in_class in _tokens(pattern)):
        raise PatternError(f"named class inside a character class: {pattern}")
    if group_count(pattern) > 1:
        raise PatternError(f"more than one capturing group: {pattern}")
    translated(pattern)


def _compiles(spark: SparkSession, patterns: list[str]) -> bool:
    try:
        spark.range(1).select(*[F.regexp_like(F.lit(""), F.lit(flagged(p))) for p in patterns]).collect()
    except PySparkException:
        return False
    return True


def check_patterns(spark: SparkSession, patterns: Iterable[str]) -> None:
    """Every pattern must pass ``lint`` and compile; the first bad one stops the run."""
    patterns = list(dict.fromkeys(patterns))
    for pattern in patterns:
        lint(pattern)
    if patterns and not _compiles(spark, patterns):
        bad = next((p for p in patterns if not _compiles(spark, [p])), "together")
        raise PatternError(f"does not compile: {bad}")
