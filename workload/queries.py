"""One registered query per operator. Nested columns are rendered as text, to be compared."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import patterns, text, urls
from pagesift.operators import distinct, extract, fetch, parts, report, results, search, terms, validate
from pagesift.operators.distinct import distinct_keep_first
from pagesift.plans.runs import ExtractRun
from pagesift.session import materialize
from pagesift.sinks import writers
from pagesift.sources import arrays, files, store
from pagesift.sources.social import social_template
from pagesift.sources.tables import one_per_url
from pagesift.sources.templates import entries_of
from pagesift.sources.templates import read_template as read_template_file
from pagesift.sources.templates import template_for_stage as stage_template
from pagesift.streaming.results import first_results, follow, saved_changes, stream_results
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def registered(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def joined(values: Column) -> Column:
    return F.array_join(values, "\n")


def pairs(values: Column) -> Column:
    return F.array_join(F.sort_array(F.transform(F.map_entries(values), lambda e: F.concat_ws("=", e["key"], e["value"]))), "; ")


# --- extraction -----------------------------------------------------------------------------------


@registered
def extract_matches(spark, sf):
    return extract.extract_matches(inputs.page_texts(spark, sf), inputs.template(), ["url"])


@registered
def extract_results(spark, sf):
    found = extract.extract_results(inputs.page_texts(spark, sf), inputs.template(), ["url"])
    return found.select("url", F.explode("results").alias("key", "v")).select("url", "key", joined(F.col("v")).alias("values"))


@registered
def extract_social(spark, sf):
    """The social-network template over pages with links to such networks."""
    found = extract.extract_results(inputs.social_texts(spark, sf), social_template(), ["url"])
    return extract.result_values(found, ["url"])


@registered
def exclude_content(spark, sf):
    cleaned = extract.exclude_content(inputs.page_texts(spark, sf), inputs.EXCLUDES)
    return cleaned.select("url", F.length("text").alias("length"), F.md5("text").alias("digest"))


@registered
def extract_plaintext(spark, sf):
    found = extract.extract_plaintext(inputs.document_texts(spark, sf), inputs.text_template())
    return found.select("file", F.explode("results").alias("key", "v")).select("file", "key", joined(F.col("v")).alias("values"))


@registered
def decode_body(spark, sf):
    """Page bytes in UTF-8 read back in the default and in their own encoding."""
    pages = inputs.page_texts(spark, sf).select("url", F.encode("text", "UTF-8").alias("body"))
    none = F.lit(None).cast("string")
    default, own = (fetch.decode_body(none, F.col("body"), e) for e in (text.ENCODING, "UTF-8"))
    return pages.select("url", F.length(default).alias("default_length"), F.md5(default).alias("default_digest"), F.md5(own).alias("own_digest"))


# --- search ---------------------------------------------------------------------------------------


@registered
def has_site(spark, sf):
    return inputs.queries(spark, sf).select("query", "pos", search.has_site(F.col("query")).alias("has_site"))


@registered
def prepare_queries(spark, sf):
    return search.prepare_queries(inputs.queries(spark, sf), inputs.SITE)


@registered
def ignored_queries(spark, sf):
    return search.ignored_queries(inputs.queries(spark, sf), inputs.SITE)


@registered
def search_pages(spark, sf):
    return search.search_pages(inputs.pages(spark, sf), inputs.SEARCHES)


@registered
def search_table(spark, sf):
    """A query for a phrase of every page, searched as a table of queries."""
    return terms.search_table(inputs.pages(spark, sf), inputs.phrases(spark, sf))


@registered
def recency_filter(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    return search.recency_filter(events, "ts", inputs.ASOF, 1).select("event_id")


@registered
def cap_results(spark, sf):
    return search.cap_results(inputs.results(spark, sf), 20).select("query", "url", "rank")


@registered
def follow_results(spark, sf):
    """Saved searches followed a few files at a time: the first 20 results of each query."""
    searches = inputs.saved_searches(spark, sf)
    rows = stream_results(spark, f"{searches}/*", max_files=4, encoding="UTF-8")
    folder = inputs.written(rows, "followed")
    follow(first_results(rows, 20), folder, f"{folder}-checkpoint").awaitTermination()
    return search.cap_results(saved_changes(spark, folder, "query", "url", "pos"), 20).select("query", "url", "rank")


@registered
def page_number(spark, sf):
    """The result page of every result of every query."""
    return search.page_number(results.ranked(inputs.results(spark, sf), span=500), 7).select("query", "url", "page")


# --- results --------------------------------------------------------------------------------------


@registered
def blacklist_filter(spark, sf):
    return results.blacklist_filter(inputs.raw_results(spark, sf))


@registered
def strip_text_fragment(spark, sf):
    return inputs.raw_results(spark, sf).select("pos", urls.strip_text_fragment(F.col("url")).alias("url"))


@registered
def clean_result_urls(spark, sf):
    return results.clean_result_urls(inputs.raw_results(spark, sf))


@registered
def distinct_keep_first_urls(spark, sf):
    return distinct_keep_first(inputs.results(spark, sf), "file", "url")


@registered
def select_urls(spark, sf):
    return results.select_urls(inputs.results(spark, sf))


@registered
def download_urls(spark, sf):
    return results.download_urls(inputs.results(spark, sf))


@registered
def collect_urls_by_query(spark, sf):
    grouped = results.collect_urls_by_query(inputs.results(spark, sf), chunk=100)
    return grouped.select("query", "chunk", joined(F.col("urls")).alias("urls"))


@registered
def links_per_query(spark, sf):
    """The searches and the documents' lines as queries, with the results of the searches."""
    searches = spark.createDataFrame([(q,) for q in inputs.SEARCHES], "query STRING")
    queries = inputs.queries(spark, sf).select("query").union(searches)
    return results.links_per_query(queries, inputs.results(spark, sf))


@registered
def url_normalize(spark, sf):
    return inputs.odd_urls(spark, sf).select(
        "page_id",
        urls.normalize(F.col("url")).alias("normalized"),
        urls.redirected(F.col("url"), F.col("url")).alias("redirected"),
    )


@registered
def url_validate(spark, sf):
    return inputs.odd_urls(spark, sf).select("page_id", urls.url_problem(F.col("url")).alias("problem"))


@registered
def url_filename(spark, sf):
    return results.url_filename(inputs.numbered_urls(spark, sf), "downloads")


@registered
def filename_unique(spark, sf):
    """How many URLs got each file name: one."""
    named = results.url_filename(inputs.numbered_urls(spark, sf))
    return named.groupBy("filename").agg(F.count(F.lit(1)).alias("urls")).groupBy("urls").agg(F.count(F.lit(1)).alias("names"))


@registered
def fetch_dedup(spark, sf):
    return results.fetch_dedup(inputs.same_requests(spark, sf))


@registered
def request_forms(spark, sf):
    """Pages asked for in several forms: one row per request, and whether it failed."""
    asked = materialize(results.fetch_dedup(inputs.same_requests(spark, sf)), "asked")
    found = extract.extract_pages(asked, inputs.responses(spark, sf), inputs.template(), order_by="fetched_at")
    return found.select("url", (F.col("outcome") == schemas.ERROR).alias("failed"))


# --- fetched content ------------------------------------------------------------------------------


def _unique_responses(spark, sf):
    return one_per_url(inputs.responses(spark, sf), F.col("fetched_at")).drop("fetched_at")


def _files(spark, sf):
    return inputs.results(spark, sf).select("url", "file").distinct()


@registered
def responses(spark, sf):
    return _unique_responses(spark, sf).select("url", "status", F.length("text").alias("length"))


@registered
def attach_responses(spark, sf):
    pages = inputs.pages(spark, sf).select("url")
    fetched = fetch.attach_responses(pages, _unique_responses(spark, sf))
    return fetched.select("url", "status", F.length("text").alias("length"))


@registered
def attach_stored(spark, sf):
    """Responses from a bucketed store, which keeps the latest of each request."""
    path = inputs.written(inputs.pages(spark, sf), "store")
    kept = store.write_store(inputs.responses(spark, sf), f"store_{uuid.uuid4().hex}", path, 8, order_by="fetched_at")
    fetched = store.attach_stored(inputs.pages(spark, sf).select("url"), kept)
    return fetched.select("url", "status", F.length("text").alias("length"))


@registered
def classify_response(spark, sf):
    pages = inputs.pages(spark, sf).select("url")
    fetched = fetch.attach_responses(pages, _unique_responses(spark, sf))
    return fetch.classify_response(fetched).select("url", "response")


def _extraction(spark, sf):
    return extract.extract_pages(
        _files(spark, sf), inputs.responses(spark, sf), inputs.template(), inputs.EXCLUDES, order_by="fetched_at"
    )


@registered
def extract_pages(spark, sf):
    """Stage one, end to end: search results joined with responses, extracted and classified."""
    return _extraction(spark, sf).select(
        "url",
        "outcome",
        F.size("results").alias("keys"),
        F.md5(F.array_join(F.flatten(F.map_values("results")), "\n")).alias("digest"),
    )


def _run(spark, sf):
    """Both stages over the derived tables, as the end-to-end run writes them."""
    files = materialize(_files(spark, sf), "files")
    template = inputs.template()
    extraction = materialize(
        extract.extract_pages(
            files, inputs.responses(spark, sf), template, inputs.EXCLUDES, order_by="fetched_at"
        ),
        "extraction",
    )
    fetched = inputs.value_responses(validate.validation_values(extraction, template))
    validation = materialize(validate.validate_urls(extraction, fetched, template), "validation")
    return ExtractRun(template, extraction, validation, files)


def _by_file(spark, sf):
    files = materialize(_files(spark, sf), "files")
    extraction = extract.extract_pages(
        files, inputs.responses(spark, sf), inputs.template(), inputs.EXCLUDES, order_by="fetched_at"
    )
    return report.page_files(extraction, files)


@registered
def stage_outcomes(spark, sf):
    return _run(spark, sf).outcomes()


@registered
def status_counts(spark, sf):
    return fetch.status_counts(_run(spark, sf).outcomes())


# --- validation -----------------------------------------------------------------------------------


def _page_values(spark, sf):
    found = extract.extract_results(inputs.page_texts(spark, sf), inputs.template(), ["url"])
    return found, extract.result_values(found, ["url"])


@registered
def template_semi_join(spark, sf):
    return validate.template_semi_join(_page_values(spark, sf)[1], inputs.template()).select("url", "key", "value")


@registered
def validation_input(spark, sf):
    found, _ = _page_values(spark, sf)
    return validate.validation_input(found, inputs.template(), _files(spark, sf))


@registered
def group_by_url(spark, sf):
    found, _ = _page_values(spark, sf)
    rows = materialize(validate.validation_input(found, inputs.template(), _files(spark, sf)), "inputs")
    return validate.group_by_url(rows, inputs.template())


@registered
def fetch_plan(spark, sf):
    found, _ = _page_values(spark, sf)
    plan = fetch.fetch_plan(validate.validation_values(found, inputs.template()), inputs.template())
    return plan.withColumns({"headers": pairs(F.col("headers")), "cookies": pairs(F.col("cookies"))})


@registered
def needs_browser(spark, sf):
    return fetch.browser_keys(_page_values(spark, sf)[1], inputs.template())


@registered
def validate_match(spark, sf):
    """Page text tested with the validation pattern of a key that changes from page to page."""
    template = inputs.template()
    pages = inputs.page_texts(spark, sf)
    key = F.element_at(F.array(*[F.lit(e.key) for e in template]), (F.col("page_id") % len(template)).cast("int") + 1)
    body = F.concat("text", F.when(F.col("page_id") % 3 == 0, "NOT FOUND").otherwise("moved, welcome"))
    return pages.select("url", validate.validate_match(body, key, template).alias("matched"))


@registered
def validate_urls(spark, sf):
    return _run(spark, sf).validation


# --- reports --------------------------------------------------------------------------------------


@registered
def summary_extracted(spark, sf):
    return report.summary_extracted(_page_values(spark, sf)[0])


@registered
def summary_validated(spark, sf):
    return report.summary_validated(_run(spark, sf).outcomes())


@registered
def failed_extraction(spark, sf):
    return report.failed_extraction(fetch.stage_outcomes(_extraction(spark, sf)))


@registered
def failed_validation(spark, sf):
    return report.failed_validation(_run(spark, sf).outcomes())


@registered
def full_results(spark, sf):
    full = report.full_results(_extraction(spark, sf))
    return full.select("url", F.explode("results").alias("key", "v")).select("url", "key", joined(F.col("v")).alias("values"))


@registered
def select_files(spark, sf):
    return report.select_files(_by_file(spark, sf))


@registered
def select_by_file(spark, sf):
    chosen = report.select_by_file(_by_file(spark, sf), "results_1.json")
    return chosen.select("file", "url", "outcome")


STARTED_AT, ENDED_AT = "2024-01-01 00:00:00", "2024-01-01 01:00:00"


@registered
def build_report(spark, sf):
    lines = _run(spark, sf).report(STARTED_AT, ENDED_AT)
    return lines.select("section_ord", "slot", "value", "line")


@registered
def file_reports(spark, sf):
    lines = _run(spark, sf).file_reports(STARTED_AT, ENDED_AT)
    return lines.select("file", "section_ord", "slot", "value", "line")


# --- sources and sinks: round trips through files -------------------------------------------------


@registered
def read_queries(spark, sf):
    """The documents' lines, written as text files and read as query lists."""
    return files.read_queries(spark, f"{inputs.document_files(spark, sf)}/part=*", "UTF-8").select("query")


@registered
def read_plaintext(spark, sf):
    """The documents, written as text files and read whole."""
    texts = files.read_plaintext(spark, f"{inputs.document_files(spark, sf)}/part=*", "UTF-8")
    part = F.regexp_extract("file", "part=([0-9]+)/", 1).cast("bigint")
    return texts.select(part.alias("part"), F.length("text").alias("length"), F.md5("text").alias("digest"))


@registered
def read_results(spark, sf):
    """Searches saved per site, all read together: every result under the file it was saved in, in its place."""
    read = files.read_results(spark, f"{inputs.saved_searches(spark, sf)}/*", encoding="UTF-8")
    named = read.withColumn("file", F.element_at(F.split("file", "/"), -1))
    return results.ranked(named, ("file", "query")).select("file", "query", "url", F.col("rank").cast("bigint").alias("rank"))


@registered
def read_arrays(spark, sf):
    """Large JSON arrays read in pieces."""
    read = arrays.read_result_arrays(spark, f"{inputs.result_arrays(spark, sf)}/*", encoding="UTF-8")
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint")
    return read.select(part.alias("part"), F.shiftright("pos", 31).alias("e"), "query", "url")


@registered
def write_results(spark, sf):
    """Saved searches line by line: how many lines a query takes, and how many URLs in all."""
    lines = spark.read.json(f"{inputs.saved_searches(spark, sf)}/*")
    return lines.groupBy("query").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("urls")).alias("urls"))


@registered
def read_template(spark, sf):
    """The template read from a file, and how often each of its patterns matches."""
    template = read_template_file(spark, inputs.text_file(spark, "template", inputs.TEMPLATE_JSON), "UTF-8")
    return _match_counts(spark, sf, template)


def _match_counts(spark, sf, template):
    found = extract.extract_matches(inputs.page_texts(spark, sf), template, ["url"])
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("matches"))


@registered
def template_for_stage(spark, sf):
    """How often the patterns of the entries that take part in validation match."""
    return _match_counts(spark, sf, stage_template(inputs.template(), schemas.VALIDATION))


@registered
def read_excludes(spark, sf):
    """Exclude patterns read from a file, applied to every page."""
    excludes = files.read_excludes(spark, inputs.text_file(spark, "excludes", "\n".join(inputs.EXCLUDES)))
    cleaned = extract.exclude_content(inputs.page_texts(spark, sf), excludes)
    return cleaned.select("url", F.length("text").alias("length"), F.md5("text").alias("digest"))


def _written_report(spark, sf):
    run = _run(spark, sf)
    folder = inputs.written(run.extraction, "report")
    run.save(f"{folder}/all", f"{folder}/by_file", STARTED_AT, ENDED_AT)
    return folder


@registered
def write_report(spark, sf):
    """The lines of the written report, and how often each stands in it."""
    lines = spark.read.text(f"{_written_report(spark, sf)}/all").withColumnRenamed("value", "line")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


#: values between quotes, names with the first line of what they hold, and lines that end a list
_AGAIN = entries_of(
    {"address": {"extract": r'https?:\/\/[^" \n]+'}, "opens": {"extract": r'"\w+": [\[{]\s+"[^"]+"'}, "closes": {"extract": r'[^\n"]*"\n +\]'}}
)


@registered
def read_report(spark, sf):
    """The written report searched again, line by line, where patterns cross lines across its cuts."""
    found = parts.extract_parts(files.read_report(spark, f"{_written_report(spark, sf)}/all", "UTF-8"), _AGAIN)
    return found.select("key", "value")


@registered
def write_file_reports(spark, sf):
    """The lines of each file's written report, and how often each stands in it."""
    folder = f"{_written_report(spark, sf)}/by_file"
    lines = spark.read.text(f"{folder}/reports").withColumnRenamed("value", "line")
    counted = lines.groupBy("report", "line").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(spark.read.parquet(f"{folder}/names"), "report").select("file", "report_name", "line", "n")


@registered
def write_downloads(spark, sf):
    """Every fetched page under its file name, read back from the written table."""
    wanted, fetched = inputs.pages(spark, sf).select("url"), inputs.responses(spark, sf)
    folder = inputs.written(wanted, "downloads")
    writers.write_downloads(wanted, fetched, folder, "downloads", order_by="fetched_at")
    return spark.read.parquet(folder).select("filename", "url", F.md5("content").alias("digest"))


@registered
def check_patterns(spark, sf):
    """Which of these patterns pass the check, and how many pages each of those matches."""
    passed = []
    for pattern in inputs.CANDIDATES:
        try:
            patterns.check_patterns(spark, [pattern])
            passed.append(pattern)
        except patterns.PatternError:
            continue
    pages = inputs.page_texts(spark, sf)
    hits = F.array_compact(F.array(*[F.when(patterns.like(F.col("text"), p), F.lit(inputs.CANDIDATES.index(p))) for p in passed]))
    return pages.select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("pages"))


def _places(df: DataFrame) -> DataFrame:
    """``df`` with ``place``, the number of each row in the order of the frame, from 1. The frame is written to keep its order."""
    numbered = materialize(df.withColumn("number", F.monotonically_increasing_id()), "ordered")
    numbered = numbered.withColumn("part", F.shiftright("number", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as the frame has partitions
    starts = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.col("start") + F.col("number").bitwiseAND((1 << 33) - 1) + 1
    return numbered.join(F.broadcast(starts.select("part", "start")), "part").withColumn("place", place).drop("number", "part", "start")


@registered
def sort_casefold(spark, sf):
    """All extracted values in order, with their places."""
    values = _page_values(spark, sf)[1].select("value").distinct()
    return _places(distinct.sort_casefold(values, "value")).select("value", "place")


@registered
def deterministic_shuffle(spark, sf):
    """Page URLs in random order: two runs agree on every place, another seed on few, and no place is left out."""
    urls_ = inputs.pages(spark, sf).select("url").distinct()
    first, again, other = (
        _places(distinct.deterministic_shuffle(table, "url", seed)).withColumnRenamed("place", name)
        for table, seed, name in ((urls_, 1, "first"), (urls_.repartition(3), 1, "again"), (urls_, 2, "other"))
    )
    joined = first.join(again, "url").join(other, "url")
    return joined.agg(
        F.count(F.lit(1)).alias("urls"),
        F.sum((F.col("first") == F.col("again")).cast("bigint")).alias("same"),
        (F.sum((F.col("first") == F.col("other")).cast("bigint")) < 10).alias("mixed"),
        F.sum("first").cast("bigint").alias("places"),
    )
