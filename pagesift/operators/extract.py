"""Extraction: every pattern of a template over every page, in one scan, with literal patterns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import patterns, text, urls
from pagesift.operators import fetch
from pagesift.session import materialize
from pagesift.sources.tables import copy_order, latest
from pagesift.sources.templates import Entry, Template, template_for_stage


def exclude_content(df: DataFrame, excludes: Sequence[str], column: str = "text") -> DataFrame:
    """Delete every match of each pattern, one pattern after the other."""
    cleaned = reduce(
        lambda c, pattern: F.regexp_replace(c, F.lit(patterns.flagged(pattern)), F.lit("")), excludes, F.col(column)
    )
    return df.withColumn(column, cleaned) if excludes else df


_LOWER = "lower_text"


_HELD = "held_words"

#: patterns that become expressions of their own; more are data of one expression
MANY_PATTERNS = 64

_PLANNED = "array<struct<key string, ord int, pattern string, idx int, word int, prepend string, append string>>"


def _searched(df: DataFrame, column: str, entries: Sequence[Entry], many: int) -> DataFrame:
    """``df`` with the lower-case text, computed once for all patterns, or, for many patterns, with the numbers of the required texts that it holds."""
    lowered = df.withColumn(_LOWER, F.lower(column))
    if len(entries) <= many:
        return lowered
    return lowered.withColumn(_HELD, patterns.held_words(F.col(_LOWER), patterns.required_words(e.extract for e in entries)))


def _possible(entries: Sequence[Entry]) -> Column:
    """The entries, as structs, whose required text is among those held; their patterns alone are compiled for a text."""
    numbers = {word: i for i, word in enumerate(patterns.required_words(e.extract for e in entries))}
    rows = [
        {
            "key": e.key,
            "ord": e.ord,
            "pattern": patterns.flagged(patterns.with_leading_check(e.extract)),
            "idx": patterns.group_index(e.extract),
            "word": numbers.get(patterns.literals(e.extract)[1]),
            "prepend": e.extract_prepend or "",
            "append": e.extract_append or "",
        }
        for e in entries
    ]
    planned = F.from_json(F.lit(json.dumps(rows)), _PLANNED)
    return F.filter(planned, lambda p: p["word"].isNull() | F.array_contains(_HELD, p["word"]))


def _found(content: Column, entry: Column) -> Column:
    return F.regexp_extract_all(content, entry["pattern"], entry["idx"])


def decorate(value: Column, entry: Entry) -> Column:
    """A match with the entry's text in front and behind."""
    if not (entry.extract_prepend or entry.extract_append):
        return value
    return F.concat(F.lit(entry.extract_prepend), value, F.lit(entry.extract_append))


def extract_matches(df: DataFrame, template: Template, ids: Sequence[str], column: str = "text", many: int = MANY_PATTERNS) -> DataFrame:
    """(ids…, key, ord, pos, value): every match of every entry, as found."""

    def rows(found: Column, key: Column, ord: Column) -> Column:
        return F.transform(found, lambda v, i: F.struct(key.alias("key"), ord.alias("ord"), i.alias("pos"), v.alias("value")))

    entries = template_for_stage(template, schemas.EXTRACTION)
    searched, content = _searched(df.select(*ids, column), column, entries, many), F.col(column)
    if len(entries) > many:
        each = F.transform(_possible(entries), lambda p: rows(_found(content, p), p["key"], p["ord"]))
    else:
        each = F.array(*[rows(patterns.find_all(content, F.col(_LOWER), e.extract), F.lit(e.key), F.lit(e.ord)) for e in entries])
    return searched.select(*ids, F.inline(F.flatten(each)))


def results_map(content: Column, lower: Column, entries: Sequence[Entry], many: int = MANY_PATTERNS) -> Column:
    """Map of key to its decorated values, distinct and in order. Keys without a match are absent."""

    def values(entry: Entry) -> Column:
        found = patterns.find_all(content, lower, entry.extract)
        return text.sorted_distinct(F.transform(found, lambda v: decorate(v, entry)))

    def planned(p: Column) -> Column:
        found = F.transform(_found(content, p), lambda v: F.concat(p["prepend"], v, p["append"]))
        return F.struct(p["key"].alias("key"), text.sorted_distinct(found).alias("values"))

    if len(entries) > many:
        by_key = F.transform(_possible(entries), planned)
    else:
        by_key = F.array(*[F.struct(F.lit(e.key).alias("key"), values(e).alias("values")) for e in entries])
    return F.map_from_entries(F.filter(by_key, lambda e: F.size(e["values"]) > 0))


def extract_results(
    df: DataFrame,
    template: Template,
    ids: Sequence[str],
    excludes: Sequence[str] = (),
    column: str = "text",
    only_matched: bool = False,
    many: int = MANY_PATTERNS,
) -> DataFrame:
    """(ids…, results): one row per input row, or per row with a match, without a shuffle.

    The map leaves through a generator. Behind a plain projection Spark would push filters on it
    below the projection and so run every pattern once more per filter.
    """
    entries = template_for_stage(template, schemas.EXTRACTION)
    cleaned = _searched(exclude_content(df.select(*ids, column), excludes, column), column, entries, many)
    rows = F.array(F.struct(results_map(F.col(column), F.col(_LOWER), entries, many).alias("results")))
    if only_matched:
        rows = F.filter(rows, lambda row: F.size(row["results"]) > 0)
    return cleaned.select(*ids, F.inline(rows))


def extract_plaintext(texts: DataFrame, template: Template, excludes: Sequence[str] = ()) -> DataFrame:
    """(file, results) of the texts with at least one match."""
    return extract_results(texts, template, ["file"], excludes, only_matched=True)


def extract_pages(
    inputs: DataFrame,
    responses: DataFrame,
    template: Template,
    excludes: Sequence[str] = (),
    order_by: str | None = None,
    max_broadcast: int = fetch.BROADCAST_BYTES,
) -> DataFrame:
    """(url, outcome, results): stage one, one row per input URL.

    A URL meets the response of any URL that leads to the same request. Pages are searched where they are read; only what
    was found is written, reduced to one response per request (the latest by ``order_by``) and joined with the distinct input
    URLs. Those are written once, to be measured and joined twice.
    """
    wanted = inputs.select("url").distinct().withColumn("request", urls.canonical(F.col("url")))
    wanted = materialize(wanted, "wanted")
    content = fetch.content()
    fetched = responses.withColumn("request", urls.canonical(F.col("url")))
    pages = fetch.only_wanted(fetched, wanted, max_broadcast, "request").select(
        "request",
        copy_order(order_by, "status", "error", "text", "body").alias("copy"),
        content.isNotNull().alias("usable"),
        content.alias("text"),
    )
    found = extract_results(pages, template, ["request", "copy", "usable"], excludes)
    found = materialize(found.withColumn("number", F.monotonically_increasing_id()), "found")
    joined = wanted.join(latest(found, "request", "copy"), "request", "left")
    results = F.coalesce("results", F.create_map().cast("map<string,array<string>>"))
    usable = F.coalesce("usable", F.lit(False))
    return joined.select(
        "url", fetch.outcome(usable, F.size(results) > 0).alias("outcome"), results.alias("results")
    )


def result_values(extraction: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids…, key, value): the extracted values as rows."""
    by_key = extraction.select(*ids, F.explode("results").alias("key", "values"))
    return by_key.select(*ids, "key", F.explode("values").alias("value"))
