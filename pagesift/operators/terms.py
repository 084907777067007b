"""Search with queries as a table: any number of queries, no list of them on the driver or in the plan.

Queries are taken apart into clauses of terms, and the distinct terms are looked for with one automaton: a page is read once, and what that costs depends on its length and on
what is found, not on the number of terms. Terms are dealt by hash into groups of a bounded size, and each group makes one pass over the pages; a few hundred thousand terms
are one or two passes. What is left of a page is its number and the numbers of the terms it holds.

Which queries a page answers is decided by division: a query is led by the clause that the fewest pages can meet, only pages with a term of that clause are its candidates, and
a candidate holds if it meets all clauses. A leading term that many pages share is salted. A query that only excludes is held against all pages, since most answer it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions import text, urls
from pagesift.operators.skew import join_hot
from pagesift.session import materialize

#: terms of one pass (some hundred bytes each in the automaton)
GROUP_TERMS = 100_000
#: queries without a leading clause that meet a page in one row
OPEN_QUERIES = 1_000
#: pages that a worker unpacks at a time
SLICE_ROWS = 32
#: fixed value: the parts of a query; a term is a sign, an operator and a word
_TOKEN = r'-?(?:(?:intext|intitle|ext|site):)?(?:"[^"]*"|\S+)'
_TERM = r'(?iU)\A(-?)(?:(intext|intitle|ext|site):)?("[^"]*"|\S+)\z'


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, clause, kind, word, minus) of every term: clauses are all required, OR joins its two neighbours first."""
    tokens = queries.select("query", F.regexp_extract_all("query", F.lit("(?iU)" + _TOKEN), F.lit(0)).alias("tokens"))

    def is_term(i: Column) -> Column:
        return F.get("tokens", i) != "OR"

    def begins(i: Column) -> Column:
        earlier = F.exists(F.slice("tokens", F.lit(1), i), lambda t: t != "OR")
        return is_term(i) & ~((i > 0) & (F.coalesce(F.get("tokens", i - 1), F.lit("")) == "OR") & earlier)

    places = F.sequence(F.lit(0), F.size("tokens") - 1)
    marked = tokens.where(F.size("tokens") > 0).withColumn("places", places).withColumn("begins", F.transform("places", begins))
    each = marked.select("query", "tokens", "begins", F.explode(F.filter("places", is_term)).alias("i"))
    token = F.get("tokens", F.col("i"))
    clause = F.size(F.filter(F.slice("begins", F.lit(1), F.col("i") + 1), lambda b: b))
    word = F.lower(F.regexp_replace(F.regexp_extract(token, _TERM, 3), '^"+|"+$', ""))
    minus = F.regexp_extract(token, _TERM, 1) == "-"
    found = each.select(
        "query", clause.alias("clause"), F.lower(F.regexp_extract(token, _TERM, 2)).alias("kind"), word.alias("word"), minus.alias("minus")
    )
    below = (F.col("kind") == "site") & F.col("word").startswith("*.")
    return found.select(
        "query",
        "clause",
        F.when(below, "below").when(F.col("kind") == "", "any").otherwise(F.col("kind")).alias("kind"),
        F.when(below, F.substring("word", 3, 1 << 30)).otherwise(F.col("word")).alias("word"),
        "minus",
    )


def searchable(pages: DataFrame, pos: str, url: str, html: str) -> DataFrame:
    """(pos, url, t_url, t_host, t_ext, t_title, t_text): the lower-case parts of a page that terms look at."""
    lowered = pages.select(F.col(pos).cast("bigint").alias("pos"), F.col(url).alias("url"), F.lower(F.coalesce(html, F.lit(""))).alias("t_html"))
    address = F.coalesce("url", F.lit(""))
    return lowered.select(
        "pos",
        "url",
        F.lower(address).alias("t_url"),
        urls.host(address).alias("t_host"),
        urls.extension(address).alias("t_ext"),
        text.title_text(F.col("t_html")).alias("t_title"),
        text.visible_text(F.col("t_html")).alias("t_text"),
    )


def held_terms(prepared: DataFrame, terms: list[tuple[int, str, str]]) -> DataFrame:
    """(pos, url, hits): the numbers of the terms (number, kind, word) that each page of ``searchable`` holds, ascending."""

    slice_rows = SLICE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import pyarrow

        words: dict[str, list[tuple[str, int]]] = {}
        exact: dict[tuple[str, str], int] = {}
        always = []
        for number, kind, word in terms:
            if kind in ("ext", "site", "below"):
                exact[kind, word] = number
            elif word:
                words.setdefault(word, []).append((kind, number))
            else:
                always.append(number)
        automaton = ahocorasick.Automaton()
        for word, wanted in words.items():
            automaton.add_word(word, wanted)
        automaton.make_automaton()
        fields = {"t_url": ("any",), "t_title": ("any", "intitle"), "t_text": ("any", "intext")}
        for batch in batches:
            hits = []
            # few pages at a time become Python objects
            for row in (row for at in range(0, batch.num_rows, slice_rows) for row in batch.slice(at, slice_rows).to_pylist()):
                found = set(always)
                for name, kinds in fields.items():
                    if words and row[name]:
                        for _, wanted in automaton.iter(row[name]):
                            found.update(n for kind, n in wanted if kind in kinds)
                host = row["t_host"] or ""
                ends = [host[i + 1 :] for i, c in enumerate(host) if c == "."]
                keys = [("ext", row["t_ext"] or ""), ("site", host), *((k, e) for e in ends for k in ("site", "below"))]
                found.update(exact[k] for k in keys if k in exact)
                hits.append(sorted(found))
            yield pyarrow.RecordBatch.from_arrays(
                [batch.column("pos"), batch.column("url"), pyarrow.array(hits, pyarrow.list_(pyarrow.int64()))], names=["pos", "url", "hits"]
            )

    return prepared.mapInArrow(run, "pos bigint, url string, hits array<bigint>")


def page_terms(pages: DataFrame, terms: DataFrame, pos: str, url: str, html: str, group_terms: int = GROUP_TERMS) -> DataFrame:
    """(pos, url, hits) of every page; ``terms``: (number, kind, word), one pass per ``group_terms`` of them."""
    prepared = searchable(pages, pos, url, html)
    groups = max(1, -(-terms.count() // group_terms))
    passes = []
    for group in range(groups):
        own = terms.where(F.pmod(F.xxhash64("number"), F.lit(groups)) == group)
        listed = [(r["number"], r["kind"], r["word"]) for r in own.select("number", "kind", "word").toLocalIterator()]
        passes.append(materialize(held_terms(prepared, listed), "page_terms"))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    if groups > 1:
        found = found.groupBy("pos", "url").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return found


def search_table(
    pages: DataFrame, queries: DataFrame, pos: str = "page_id", url: str = "url", html: str = "html", group_terms: int = GROUP_TERMS
) -> DataFrame:
    """(query, url, pos): the pages each query of a table finds, as ``search.search_pages`` does for a list.

    ``pos`` is a column that ranks pages, unique per page.
    """
    parsed = materialize(query_terms(queries.select("query").distinct()), "query_terms")
    numbered = parsed.select("kind", "word").distinct().withColumn("number", F.monotonically_increasing_id())
    terms = materialize(numbered, "terms")
    found = materialize(page_terms(pages, terms, pos, url, html, group_terms), "page_hits")
    seen = found.select(F.explode("hits").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("pages"))
    rated = terms.join(seen, "number", "left").select("kind", "word", "number", F.coalesce("pages", F.lit(0)).alias("pages"))
    key = F.struct("kind", "word")
    many, few = (df.withColumn("key", key).drop("kind", "word") for df in (parsed, rated))
    known = join_hot(many, few, "key", "query")
    clauses = known.groupBy("query", "clause").agg(
        F.collect_list(F.struct("number", "minus")).alias("terms"), F.sum("pages").alias("pages"), F.max("minus").alias("excludes")
    )
    leading = F.min(F.when(~F.col("excludes"), F.struct("pages", "clause", F.transform("terms", lambda t: t["number"]).alias("numbers"))))
    asked = clauses.groupBy("query").agg(F.collect_list("terms").alias("clauses"), leading.alias("lead"))
    asked = materialize(asked.select("query", "clauses", F.array_distinct("lead.numbers").alias("lead")), "asked")
    led = asked.where(F.col("lead").isNotNull()).withColumn("number", F.explode("lead"))
    candidates = join_hot(found.select("pos", "url", "hits", F.explode("hits").alias("number")), led, "number", "pos")
    # a page with several terms of the leading clause is a candidate once
    once = candidates.where(F.array_min(F.array_intersect("hits", "lead")) == F.col("number")).select("query", "url", "pos", "hits", "clauses")
    # queries that only exclude, and those that ask for nothing, such as OR alone
    empty = queries.select("query").distinct().join(asked, "query", "left_anti")
    bare = asked.where(F.col("lead").isNull()).select("query", "clauses")
    bare = materialize(bare.unionByName(empty.withColumn("clauses", F.array().cast(asked.schema["clauses"].dataType))), "open_queries")
    width = -(-bare.count() // OPEN_QUERIES)
    slots = F.sequence(F.lit(0), F.lit(width - 1)) if width else F.array().cast("array<int>")
    everywhere = found.withColumn("slot", F.explode(slots))
    dealt = bare.withColumn("slot", F.pmod(F.xxhash64("query"), F.lit(max(1, width))).cast("int"))
    every = everywhere.join(dealt, "slot").select("query", "url", "pos", "hits", "clauses")

    def holds(clause: Column) -> Column:
        return F.exists(clause, lambda t: F.array_contains("hits", t["number"]) != t["minus"])

    return once.unionByName(every).where(F.forall("clauses", holds)).select("query", "url", "pos")
