"""Text columns: decoding, whitespace, order keys, page text."""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: bytes without a declared charset are read as this
ENCODING = "ISO-8859-1"

#: every white-space character; the last one is the ideographic space
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

_INVISIBLE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"


def strip(text: Column) -> Column:
    """Remove outer white space of any kind; plain ``F.trim`` removes blanks only."""
    return F.trim(text, F.lit(_SPACES))


def decode(content: Column, encoding: str = ENCODING) -> Column:
    return F.decode(content, encoding)


def file_text(content: Column, encoding: str = ENCODING) -> Column:
    """A file read as text: decoded, every line end a newline, outer white space removed."""
    return strip(F.regexp_replace(decode(content, encoding), r"\r\n?", "\n"))


@cache
def foldings() -> tuple[str, str, dict[str, str]]:
    """Characters that full case folding turns into one other, those others, and what becomes of the rest that it changes."""
    changed = {c: c.casefold() for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c != c.casefold()}
    single = [(c, f) for c, f in changed.items() if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), {c: f for c, f in changed.items() if len(f) > 1}


def casefold_key(text: Column) -> Column:
    """Sort key of the case-insensitive order, by full case folding: ``ß`` is ``ss``. Use the text itself to break ties.

    ASCII text, told by its length in bytes, is put in lower case only.
    """
    given, folded, longer = foldings()
    expanded = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(expanded, c), c))
    whole = F.when(text.rlike(f"[{''.join(longer)}]"), F.array_join(letters, "")).otherwise(text)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(whole, given, folded))


def casefold_order(text: Column) -> list[Column]:
    return [casefold_key(text), text]


def sorted_distinct(values: Column) -> Column:
    """Array without repeats, in case-insensitive order; ties keep their first-seen order."""
    keyed = F.transform(
        F.array_distinct(values), lambda v, i: F.struct(casefold_key(v).alias("k"), i.alias("i"), v.alias("v"))
    )
    return F.transform(F.sort_array(keyed), lambda s: s["v"])


def visible_text(html: Column) -> Column:
    """Page text without tags, comments, scripts and styles."""
    return F.regexp_replace(html, _INVISIBLE, " ")


def title_text(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def month_floor(asof, months: int) -> Column:
    """The day ``months`` months before ``asof``."""
    return F.add_months(F.lit(asof).cast("date"), -months)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
