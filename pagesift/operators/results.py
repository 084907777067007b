"""Result rows (query, url, pos): cleaning, distinct URLs, grouping, file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions import patterns, urls
from pagesift.operators.distinct import deterministic_shuffle, distinct_keep_first
from pagesift.operators.search import has_site
from pagesift.operators.skew import join_hot

#: URLs per row of a grouped result
CHUNK = 1000

#: positions that are ranked together
RANK_SPAN = 100_000


def blacklist_filter(results: DataFrame, blacklist: str = urls.BLACKLIST) -> DataFrame:
    """Drop URLs about search tricks, except for queries that name their site."""
    return results.where(has_site(F.col("query")) | ~patterns.like(F.col("url"), blacklist))


def clean_result_urls(results: DataFrame, blacklist: str = urls.BLACKLIST) -> DataFrame:
    """Blacklist, then text fragments, then distinct URLs per query. Empty queries vanish."""
    kept = blacklist_filter(results, blacklist).withColumn("url", urls.strip_text_fragment(F.col("url")))
    return distinct_keep_first(kept, "query", "url")


def select_urls(results: DataFrame) -> DataFrame:
    """(url, pos): every URL once, at its first position."""
    return distinct_keep_first(results, "url")


def download_urls(results: DataFrame, seed: int = 0) -> DataFrame:
    """Every URL once, in a random but repeatable order."""
    return deterministic_shuffle(results.select("url").distinct(), seed=seed)


def ranked(results: DataFrame, by: Sequence[str] = ("query",), span: int = RANK_SPAN) -> DataFrame:
    """Add ``rank``, from 1, in the order of position and URL.

    A query is ranked in parts of ``span`` positions, each starting where the parts before it end, so a query that
    finds a third of all pages is no single task.
    """
    parted = results.withColumn("part", F.floor(F.col("pos") / span))
    key = [*by, "part"]
    within = parted.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("pos", "url")))
    before = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        parted.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
        .select(*key, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    return within.join(starts, key).withColumn("rank", F.col("start") + F.col("n")).select(*results.columns, "rank")


def collect_urls_by_query(results: DataFrame, chunk: int = CHUNK, by: Sequence[str] = ("query",)) -> DataFrame:
    """(by…, chunk, urls): the URLs of a query in order.

    A query with up to ``chunk`` results is one row. A larger one is cut into several full rows, so that no row grows with
    the data. Rows read from several files are told apart by ``by=("file", "query")``.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "url")))
    return (
        ranked(results, by).groupBy(*by, F.floor((F.col("rank") - 1) / chunk).alias("chunk"))
        .agg(F.transform(ordered, lambda r: r["url"]).alias("urls"))
    )


def links_per_query(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query, links) for every query, also those without a result."""
    counts = results.groupBy("query").agg(F.count("url").alias("links"))
    return (
        queries.select("query").distinct().join(counts, "query", "left")
        .select("query", F.coalesce("links", F.lit(0)).alias("links"))
    )


def url_filename(url_table: DataFrame, directory: str = "") -> DataFrame:
    """(url, filename): the last path segment; of several URLs with one name all but one get a number.

    A segment that ends in a number in brackets itself counts under the name in front of it, if others do too: so no name is
    given twice. Many sites share a name such as ``index.html``. The group is therefore numbered in parts, cut
    by a hash prefix, and each part starts where the parts before it end. Numbers are dense.
    """
    part_key = ["stem", "part"]
    base = urls.file_base(F.col("url"))
    named = url_table.select("url").distinct().select(
        "url",
        base.alias("base"),
        F.regexp_replace(base, r"( \([0-9]+\))+$", "").alias("stem"),
        F.substring(F.md5("url"), 1, 3).alias("part"),
    )
    in_part = named.withColumn("n", F.row_number().over(W.partitionBy(*part_key).orderBy("url")) - 1)
    # at most 4096 parts per name
    by_stem = W.partitionBy("stem")
    before = by_stem.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        named.groupBy(*part_key).agg(F.count(F.lit(1)).alias("rows"))
        .select(*part_key, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(by_stem).alias("all"))
    )
    number = F.col("start") + F.col("n")
    name = (
        F.when(F.col("all") == 1, F.col("base"))
        .when(number == 0, F.col("stem"))
        .otherwise(F.concat("stem", F.lit(" ("), number, F.lit(")")))
    )
    prefix = directory.rstrip("/") + "/" if directory else ""
    return in_part.join(starts, part_key).select("url", F.concat(F.lit(prefix), name).alias("filename"))


def fetch_dedup(inputs: DataFrame) -> DataFrame:
    """(url, file): one URL per canonical form, with the files of all URLs of that form.

    The files stay rows, since a URL may come from any number of them.
    """
    pairs = inputs.select(urls.canonical(F.col("url")).alias("canonical"), "url", "file")
    request = pairs.groupBy("canonical").agg(F.min("url").alias("url"))
    files = pairs.select("canonical", "file").distinct()
    return join_hot(files, request, "canonical", "file").select("url", "file")
