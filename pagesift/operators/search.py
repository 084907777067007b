"""Search side: which queries run, which pages each query finds, how many results it keeps."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions import patterns, text, urls
from pagesift.operators.distinct import distinct_keep_first

#: fixed values
SITE_OPERATOR = r"(?<!in|\-)site\:"
MAX_WORDS = 32
MAX_RESULTS = 100
PAGE_SIZE = 10

#: beyond this Spark no longer cuts groups before the shuffle by itself
_GROUP_LIMIT = 1000
_SALTS = 64


def has_site(query: Column) -> Column:
    """Does the query restrict the site? A negated operator or a word ending in it does not count."""
    return patterns.like(query, SITE_OPERATOR)


def _scoped(queries: DataFrame, site: str) -> DataFrame:
    """Add ``conflict`` and ``scoped``, the text that would be searched."""
    query = F.col("query")
    if not site:
        return queries.withColumns({"conflict": F.lit(False), "scoped": query})
    return queries.withColumns(
        {"conflict": has_site(query), "scoped": F.concat(F.lit(f"site:{site} "), query)}
    )


def _too_long(query: Column) -> Column:
    return F.size(F.split(query, " ")) > MAX_WORDS


def prepare_queries(queries: DataFrame, site: str = "") -> DataFrame:
    """(query, pos): queries limited to ``site``, without conflicting, too long and repeated ones."""
    kept = _scoped(queries, site).where(~F.col("conflict") & ~_too_long(F.col("scoped")))
    return distinct_keep_first(kept.select(F.col("scoped").alias("query"), "pos"), "query")


def ignored_queries(queries: DataFrame, site: str = "") -> DataFrame:
    """(query, pos, reason): what ``prepare_queries`` leaves out."""
    scoped = _scoped(queries, site)
    reason = F.when(F.col("conflict"), "site").when(_too_long(F.col("scoped")), "length")
    return (
        scoped.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(F.when(F.col("conflict"), F.col("query")).otherwise(F.col("scoped")).alias("query"), "pos", "reason")
    )


def recency_filter(df: DataFrame, ts: str, asof, months: int) -> DataFrame:
    """Rows not older than ``months`` months before ``asof``, counted in days; 0 is no limit."""
    if months < 0:
        raise ValueError("months must not be negative")
    return df.where(F.col(ts) >= text.month_floor(asof, months)) if months else df


_TERM = re.compile(r'(-?)(?:(intext|intitle|ext|site):)?("[^"]*"|\S+)', re.IGNORECASE)


@dataclass(frozen=True)
class _Plan:
    """Queries over numbered terms: each distinct term is looked for once per page, whatever the number of queries."""

    terms: dict[str, list[str]]
    queries: list[dict]


def _kind(operator: str | None, word: str) -> tuple[str, str]:
    kind = (operator or "any").lower()
    word = word.strip('"').lower()
    if kind == "site" and word.startswith("*."):
        return "below", word.removeprefix("*.")
    return kind, word


def _plan(queries: Sequence[str]) -> _Plan:
    """Terms are all required; OR joins its two neighbours first; a leading minus negates a term."""
    terms: dict[str, dict[str, int]] = {kind: {} for kind in _HITS}
    parsed = []
    for query in queries:
        clauses: list[list[tuple[str, int, bool]]] = []
        join_next = False
        for found in _TERM.finditer(query):
            if found.group(0) == "OR":
                join_next = bool(clauses)
                continue
            minus, operator, word = found.groups()
            kind, word = _kind(operator, word)
            term = (kind, terms[kind].setdefault(word, len(terms[kind])), bool(minus))
            if join_next:
                clauses[-1].append(term)
            else:
                clauses.append([term])
            join_next = False
        parsed.append((query, clauses))
    first, starts = 1, {}
    for kind, words in terms.items():
        starts[kind] = first
        first += len(words)
    numbered = [
        {"query": query, "clauses": [[{"term": starts[k] + n, "minus": m} for k, n, m in clause] for clause in clauses]}
        for query, clauses in parsed
    ]
    return _Plan({kind: list(words) for kind, words in terms.items()}, numbered)


#: how a term of each kind is looked for in the columns of ``_searchable``
_HITS = {
    "intext": lambda word: F.contains("t_text", word),
    "intitle": lambda word: F.contains("t_title", word),
    "ext": lambda word: F.col("t_ext") == word,
    "site": lambda word: (F.col("t_host") == word) | F.endswith("t_host", F.concat(F.lit("."), word)),
    "below": lambda word: F.endswith("t_host", F.concat(F.lit("."), word)),
    "any": lambda word: F.contains("t_url", word) | F.contains("t_title", word) | F.contains("t_text", word),
}


def _constant(value: object, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _text_words(queries: Sequence[str]) -> set[str]:
    """One word of each term that looks at the page text: its longest piece without a blank."""
    terms = [found.groups() for query in queries for found in _TERM.finditer(query) if found.group(0) != "OR"]
    words = [word.strip('"').lower() for _, operator, word in terms if (operator or "intext").lower() == "intext"]
    return {max(word.split(" "), key=len) for word in words}


def _searchable(pages: DataFrame, queries: Sequence[str], url: str, html: str) -> DataFrame:
    """Add the lower-case parts of a page that terms look at.

    Tags are replaced by blanks, so a word of the visible text is in the page source as well. Where
    the source has none of the searched words, the visible text is not needed.
    """
    lowered = pages.select("*", F.lower(F.coalesce(html, F.lit(""))).alias("t_html"))
    visible = text.visible_text(F.col("t_html"))
    words = sorted(_text_words(queries))
    if words:
        needed = F.exists(_constant(words, "array<string>"), lambda word: F.contains("t_html", word))
        visible = F.when(needed, visible).otherwise("")
    return lowered.withColumns(
        {
            "t_url": F.lower(F.coalesce(url, F.lit(""))),
            "t_host": urls.host(F.coalesce(url, F.lit(""))),
            "t_ext": urls.extension(F.coalesce(url, F.lit(""))),
            "t_title": text.title_text(F.col("t_html")),
            "t_text": visible,
        }
    )


def search_pages(
    pages: DataFrame, queries: Sequence[str], pos: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(query, url, pos): the pages each query finds, in one scan for any number of queries and without a shuffle.

    ``pos`` is a column that ranks pages, unique per page.
    """
    if not queries:
        raise ValueError("no queries")
    plan = _plan(queries)
    hits = [F.transform(_constant(words, "array<string>"), _HITS[kind]) for kind, words in plan.terms.items() if words]
    hits = F.concat(*hits) if hits else F.array().cast("array<boolean>")
    prepared = _searchable(pages, queries, url, html).select(
        F.col(url).alias("url"),
        F.col(pos).cast("bigint").alias("pos"),
        # a generator, so that the terms aren't looked for again by each query
        F.explode(F.array(hits)).alias("hits"),
    )
    asked = _constant(plan.queries, "array<struct<query string, clauses array<array<struct<term int, minus boolean>>>>>")

    def holds(clause: Column) -> Column:
        return F.exists(clause, lambda t: F.element_at("hits", t["term"]) != t["minus"])

    found = F.filter(asked, lambda q: F.forall(q["clauses"], holds))
    return prepared.select(F.explode(F.transform(found, lambda q: q["query"])).alias("query"), "url", "pos")


def cap_results(results: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """The first ``limit`` distinct URLs of each query, with their ``rank`` from 1.

    Only ``limit`` rows per query and task reach the shuffle, so a query that finds a third of all
    pages costs no more than others. Spark cuts small limits itself; larger ones are cut in salted
    groups first.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    first = distinct_keep_first(results, "query", "url")
    if limit > _GROUP_LIMIT:
        part = W.partitionBy("query", F.pmod(F.xxhash64("url"), F.lit(_SALTS))).orderBy("pos", "url")
        first = first.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limit)
    ranked = W.partitionBy("query").orderBy("pos", "url")
    return first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)


def page_number(capped: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Add the result page of each ranked URL."""
    if not 1 <= size <= 100:
        raise ValueError("page size must be between 1 and 100")
    return capped.withColumn("page", F.floor((F.col("rank") - 1) / size).cast("int") + 1)
