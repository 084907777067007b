"""The two programs as runs over tables: search, then extract, validate and report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import urls
from pagesift.functions.patterns import check_patterns, group_index
from pagesift.operators import extract, fetch, report, results, search, terms, validate
from pagesift.session import materialize, materialize_counted
from pagesift.sinks import writers
from pagesift.sources.templates import Template


#: prepared queries that become part of the plan
LISTED_QUERIES = 100


@dataclass(frozen=True)
class SearchRun:
    """``results`` are clean (query, url, pos) rows; ``ignored`` the queries left out."""

    queries: DataFrame
    ignored: DataFrame
    results: DataFrame

    def links(self) -> DataFrame:
        return results.links_per_query(self.queries, self.results)

    def save(self, path: str) -> bool:
        """Write the results; nothing is written when there are none."""
        if self.results.isEmpty():
            return False
        writers.write_results(self.results, path)
        return True


def search_run(
    pages: DataFrame,
    queries: DataFrame,
    site: str = "",
    limit: int = search.MAX_RESULTS,
    blacklist: str = urls.BLACKLIST,
    pos: str = "page_id",
    asof=None,
    months: int = 0,
    ts: str = "ts",
    listed: int = LISTED_QUERIES,
) -> SearchRun:
    """Prepare the queries, search the pages, keep the first results and clean them.

    Up to ``LISTED_QUERIES`` prepared queries are a list somebody wrote and become constants of one scan; more stay a table and are
    searched with an automaton. What the search found, at most ``limit`` rows per query, is written once, so that saving and counting don't search again.
    """
    prepared = search.prepare_queries(queries, site)
    recent = search.recency_filter(pages, ts, asof, months) if months else pages
    asked = materialize(prepared, "queries")
    count = asked.count()
    if not count:
        raise ValueError("no valid queries")
    if count <= listed:
        found = search.search_pages(recent, [row.query for row in asked.orderBy("pos").collect()], pos)
    else:
        found = terms.search_table(recent, asked, pos)
    capped = materialize(search.cap_results(found, limit), "searched")
    ranked = capped.select("query", "url", F.col("rank").cast("bigint").alias("pos"))
    clean = results.clean_result_urls(ranked, blacklist)
    return SearchRun(asked, search.ignored_queries(queries, site), clean)


@dataclass(frozen=True)
class ExtractRun:
    """The tables of both stages.

    ``extraction``: (url | file, outcome, results); ``validation``: (url, key, outcome);
    ``files``: (url, file) of the pages, none for plain text, whose id is its file.
    """

    template: Template
    extraction: DataFrame
    validation: DataFrame
    files: DataFrame | None = None
    #: by stage and outcome, as counted while the tables were written
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    @property
    def page(self) -> str:
        return "url" if self.files is not None else "file"

    def outcomes(self) -> DataFrame:
        first = self.extraction.select(F.col(self.page).alias("url"), "outcome")
        return fetch.stage_outcomes(first, self.validation)

    def status_counts(self) -> DataFrame:
        """(stage, outcome, n): how many URLs ended how. A run has counted them already; a hand-made one counts now."""
        if not self.counts:
            return fetch.status_counts(self.outcomes())
        rows = [(stage, kind, n) for stage, by_kind in self.counts.items() for kind, n in by_kind.items() if n]
        return self.extraction.sparkSession.createDataFrame(rows, "stage STRING, outcome STRING, n BIGINT")

    def report(self, started_at: str = "", ended_at: str = "") -> DataFrame:
        items = materialize(report.report_items(self.extraction, self.validation, self.page), "items")
        return report.report_lines(items, started_at, ended_at, page=self.page)

    def file_reports(self, started_at: str = "", ended_at: str = "") -> DataFrame:
        by_file = self.extraction
        if self.files is not None:
            by_file = materialize(report.page_files(self.extraction, self.files), "by_file")
        value_files = materialize(validate.validation_input(by_file, self.template), "value_files")
        items = materialize(report.file_items(by_file, self.validation, value_files, self.page), "file_items")
        return report.report_lines(items, started_at, ended_at, by=["file"], page=self.page)

    def save(self, path: str, file_path: str | None = None, started_at: str = "", ended_at: str = "") -> bool:
        """Write the report, and with ``file_path`` one report per source file."""
        written = writers.write_report(self.report(started_at, ended_at), self.outcomes(), path)
        if written and file_path:
            writers.write_file_reports(self.file_reports(started_at, ended_at), file_path)
        return written


def extract_run(
    result_rows: DataFrame,
    responses: DataFrame,
    template: Template,
    excludes: Sequence[str] = (),
    per_key: bool = False,
    order_by: str | None = None,
) -> ExtractRun:
    """Extract from the pages of result rows (url, file), then validate the values.

    URLs that lead to the same request are one, with the files of all. Every stage is written once: later steps read it
    several times and never repeat the pattern work. ``order_by`` tells the latest of several responses of a URL.
    """
    _check(responses, template, excludes)
    files = materialize(results.fetch_dedup(result_rows.select("url", "file").distinct()), "files")
    extraction, first = _counted(extract.extract_pages(files, responses, template, excludes, order_by), schemas.EXTRACTION)
    validation, second = _validation(extraction, responses, template, per_key, order_by)
    return ExtractRun(template, extraction, validation, files, {**first, **second})


def plaintext_run(
    texts: DataFrame,
    responses: DataFrame,
    template: Template,
    excludes: Sequence[str] = (),
    per_key: bool = False,
    order_by: str | None = None,
) -> ExtractRun:
    """Extract from texts (file, text), then validate the values."""
    _check(texts, template, excludes)
    found = extract.extract_plaintext(texts, template, excludes)
    extraction, first = _counted(found.withColumn("outcome", F.lit(schemas.SUCCESS)), schemas.EXTRACTION)
    validation, second = _validation(extraction, responses, template, per_key, order_by)
    return ExtractRun(template, extraction, validation, counts={**first, **second})


def _check(df: DataFrame, template: Template, excludes: Sequence[str]) -> None:
    """Bad patterns stop a run before it begins."""
    given = [p for e in template for p in (e.extract, e.validate) if p]
    check_patterns(df.sparkSession, [*given, *excludes])
    for entry in template:
        group_index(entry.extract)


def _counted(outcomes: DataFrame, stage: str) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """A written stage, and how many of its rows ended how."""
    kinds = (schemas.SUCCESS, schemas.NO_MATCH, schemas.ERROR)
    table, counts = materialize_counted(outcomes, stage, **{kind: F.count_if(F.col("outcome") == kind) for kind in kinds})
    return table, {stage: counts}


def _validation(
    extraction: DataFrame, responses: DataFrame, template: Template, per_key: bool, order_by: str | None
) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    return _counted(validate.validate_urls(extraction, responses, template, per_key, order_by), schemas.VALIDATION)
