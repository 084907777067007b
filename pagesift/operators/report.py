"""Reports as tables, and as JSON text that no single task or row has to hold.

A report lists every page and every value, so it grows with the data, and one file may own a third
of it. It is therefore written as ordered *lines*: each item is one row, the brackets around a list
are rows too, and Spark sorts them over many tasks. The part files, read in order, are the document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import text
from pagesift.operators.distinct import sort_casefold
from pagesift.operators.extract import result_values
from pagesift.operators.skew import SALT_ROWS, join_hot

VALIDATED = "validated"
EXTRACTED = "extracted"
FAILED_VALIDATION = "failed_validation"
FAILED_EXTRACTION = "failed_extraction"
FULL = "full"

_INDENT = "    "


# --- single parts of a report ---------------------------------------------------------------------


def summary_extracted(extraction: DataFrame) -> DataFrame:
    """All extracted values, distinct and in order."""
    return sort_casefold(result_values(extraction, []).select("value").distinct(), "value")


def _urls(outcomes: DataFrame, stage: str, kind: str) -> DataFrame:
    chosen = outcomes.where((F.col("stage") == stage) & (F.col("outcome") == kind))
    return sort_casefold(chosen.select("url").distinct(), "url")


def summary_validated(outcomes: DataFrame) -> DataFrame:
    return _urls(outcomes, schemas.VALIDATION, schemas.SUCCESS)


def failed_extraction(outcomes: DataFrame) -> DataFrame:
    return _urls(outcomes, schemas.EXTRACTION, schemas.ERROR)


def failed_validation(outcomes: DataFrame) -> DataFrame:
    return _urls(outcomes, schemas.VALIDATION, schemas.ERROR)


def full_results(extraction: DataFrame, by: str = "url") -> DataFrame:
    """Every page with results, in order of its URL or file."""
    return sort_casefold(extraction.where(F.size("results") > 0).select(by, "results"), by)


def page_files(extraction: DataFrame, source_files: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(file, and the columns of ``extraction``): each page once per file that names it."""
    files = source_files.select("url", "file").distinct()
    return join_hot(files, extraction, "url", "file", salt_rows=salt_rows)


def select_by_file(by_file: DataFrame, file: str) -> DataFrame:
    """The results of one file."""
    return by_file.where(F.col("file") == file)


def select_files(by_file: DataFrame) -> DataFrame:
    """The files with results."""
    return by_file.where(F.size("results") > 0).select("file").distinct()


# --- items ----------------------------------------------------------------------------------------


def _items(df: DataFrame, by: Sequence[str], *parts: tuple[str, Column, Column | None]) -> DataFrame:
    """(by…, section, value, results): the given parts of each row, where their value is not null."""
    none = F.lit(None).cast("map<string,array<string>>")
    rows = [
        F.struct(F.lit(section).alias("section"), value.alias("value"), (none if results is None else results).alias("results"))
        for section, value, results in parts
    ]
    exploded = df.select(*by, F.inline(F.array(*rows)))
    return exploded.where(F.col("value").isNotNull())


def _extraction_items(extraction: DataFrame, by: Sequence[str], page: str) -> DataFrame:
    """Pages with results, failed pages, and the distinct values of all results."""
    pages = _items(
        extraction,
        by,
        (FULL, F.when(F.size("results") > 0, F.col(page)), F.col("results")),
        (FAILED_EXTRACTION, F.when(F.col("outcome") == schemas.ERROR, F.col(page)), None),
    )
    values = result_values(extraction, by).select(*by, "value").distinct()
    return pages.unionByName(_items(values, by, (EXTRACTED, F.col("value"), None)))


def _validation_items(validation: DataFrame, by: Sequence[str]) -> DataFrame:
    section = F.when(F.col("outcome") == schemas.SUCCESS, VALIDATED).when(
        F.col("outcome") == schemas.ERROR, FAILED_VALIDATION
    )
    chosen = validation.select(*by, section.alias("section"), F.col("url").alias("value")).where("section IS NOT NULL")
    return chosen.distinct().withColumn("results", F.lit(None).cast("map<string,array<string>>"))


def report_items(extraction: DataFrame, validation: DataFrame, page: str = "url") -> DataFrame:
    """(section, value, results): the content of the overall report; only ``full`` has results."""
    pages = _with_outcome(extraction)
    return _extraction_items(_one_per_file(pages) if page == "file" else pages, [], page).unionByName(_validation_items(validation, []))


def _one_per_file(texts: DataFrame) -> DataFrame:
    """A text that was given several times is one page of its report, with the larger of its results by hash."""
    rest = [c for c in texts.columns if c != "file"]
    digest = F.xxhash64(F.to_json("results"))
    chosen = F.max_by(F.struct(*rest), digest)
    return texts.groupBy("file").agg(chosen.alias("r")).select("file", *[F.col("r")[c].alias(c) for c in rest])


def _with_outcome(extraction: DataFrame) -> DataFrame:
    """Plain text has no outcome column: all its rows are successes."""
    if "outcome" in extraction.columns:
        return extraction
    return extraction.withColumn("outcome", F.lit(schemas.SUCCESS))


def file_items(
    by_file: DataFrame,
    validation: DataFrame,
    value_files: DataFrame,
    page: str = "url",
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """(file, section, value, results): the content of every file's report.

    ``by_file`` has one row per page and file (``page_files``, or plain text as it is).
    ``value_files`` (``validation_input``) tells which files a validated URL comes from. Files
    without results have no report.
    """
    by_file = _with_outcome(by_file)
    success, error = (by_file.where(F.col("outcome") == kind) for kind in (schemas.SUCCESS, schemas.ERROR))
    if page == "file":
        shown = _one_per_file(success).withColumn("page", F.col("file"))
        items = _extraction_items(shown, ["file"], "page")
    else:
        failed = join_hot(error, select_files(success), "file", page, salt_rows=salt_rows)
        items = _extraction_items(success.unionByName(failed), ["file"], page)
    decided = validation.where(F.col("outcome") != schemas.NO_MATCH).select("url", "outcome").distinct()
    validated = join_hot(value_files.select("url", "file").distinct(), decided, "url", "file", salt_rows=salt_rows)
    return items.unionByName(_validation_items(validated, ["file"]))


#: ends of lists (a file has five at most) that may be broadcast, a few hundred bytes each; more are joined by a shuffle
BROADCAST_ENDS = 100_000


# --- lines ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Section:
    """Where a list stands in the document: the text before it and after it."""

    name: str
    before: str
    after: str
    depth: int


def _layout(plaintext: bool, per_file: bool, started_at: str, ended_at: str) -> list[_Section]:
    def quoted(value: str) -> str:
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'

    i = _INDENT
    head = f'{{\n{i}"started_at": {quoted(started_at)},\n{i}"ended_at": {quoted(ended_at)},\n{i}"summary": {{\n'
    validation_first = f'{i}"failed": {{\n{2 * i}"validation": '
    sections = [
        _Section(VALIDATED, f'{head}{2 * i}"validated": ', ",", 2),
        _Section(EXTRACTED, f'{2 * i}"extracted": ', f"\n{i}}},", 2),
    ]
    if plaintext:
        sections.append(_Section(FAILED_VALIDATION, validation_first, f"\n{i}}},", 2))
    else:
        sections.append(_Section(FAILED_VALIDATION, validation_first, ",", 2))
        sections.append(_Section(FAILED_EXTRACTION, f'{2 * i}"extraction": ', f"\n{i}}},", 2))
    name = "results" if plaintext and per_file else "full"
    sections.append(_Section(FULL, f'{i}"{name}": ', "\n}", 1))
    return sections


def _json_string(value: Column) -> Column:
    """A quoted string; only one that needs escapes takes the way through the JSON writer."""
    escaped = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    return F.when(F.regexp_like(value, F.lit(r'[\x00-\x1f"\\]')), escaped).otherwise(
        F.concat(F.lit('"'), value, F.lit('"'))
    )


def _json_map(results: Column, depth: int) -> Column:
    """A results map as indented JSON. One page's results are one row already."""
    outer, inner, leaf = (_INDENT * (depth + n) for n in range(3))

    def entry(e: Column) -> Column:
        lines = F.transform(e["value"], lambda v: F.concat(F.lit(leaf), _json_string(v)))
        return F.concat(
            F.lit(inner), _json_string(e["key"]), F.lit(": [\n"), F.array_join(lines, ",\n"), F.lit(f"\n{inner}]")
        )

    entries = F.transform(F.map_entries(results), entry)
    return F.concat(F.lit("{\n"), F.array_join(entries, ",\n"), F.lit(f"\n{outer}}}"))


def _body(page: str, single: bool) -> Column:
    """The text of an item: a string, or a page with its results."""
    if single:
        full = _json_map(F.col("results"), 1)
    else:
        i = _INDENT
        full = F.concat(
            F.lit(f'{2 * i}{{\n{3 * i}"{page}": '),
            _json_string(F.col("value")),
            F.lit(f',\n{3 * i}"results": '),
            _json_map(F.col("results"), 3),
            F.lit(f"\n{2 * i}}}"),
        )
    return F.when(F.col("section") == FULL, full).otherwise(F.concat(F.lit(3 * _INDENT), _json_string(F.col("value"))))


def report_lines(
    items: DataFrame,
    started_at: str = "",
    ended_at: str = "",
    by: Sequence[str] = (),
    page: str = "url",
) -> DataFrame:
    """(by…, section_ord, slot, fold, value, line): the rows of a report as text, not yet sorted.

    ``page`` names the column that identifies a page: ``url``, or ``file`` for plain text.
    """
    plaintext, per_file = page == "file", bool(by)
    layout = _layout(plaintext, per_file, started_at, ended_at)
    single = plaintext and per_file
    ordinals = F.create_map(*[F.lit(x) for n, s in enumerate(layout) for x in (s.name, n)])
    listed = items.where(F.col("section").isin(*[s.name for s in layout]))
    keyed = listed.withColumns(
        {"section_ord": F.try_element_at(ordinals, F.col("section")), "fold": text.casefold_key(F.col("value"))}
    )
    last = keyed.groupBy(*by, "section_ord").agg(F.max(F.struct("fold", "value")).alias("last"))

    # joined on the value too, so that a long list is not one key
    group = [*by, "section_ord"]
    ends = last.select(*group, F.col("last.value").alias("value"), F.lit(True).alias("is_last"))
    small = not by or ends.count() <= BROADCAST_ENDS
    marked = keyed.join(F.broadcast(ends) if small else ends, [*group, "value"], "left")
    comma = F.when(F.col("is_last"), F.lit("")).otherwise(F.lit(","))
    body = marked.select(
        *group, F.lit(1).alias("slot"), "fold", "value", F.concat(_body(page, single), comma).alias("line")
    )

    framed = _frames(last, layout, by, single)
    if single:
        # the only object of the section follows its name on the same line
        before = F.lit(layout[-1].before)
        closing = F.lit(layout[-1].after)
        body = body.withColumn(
            "line", F.when(F.col("section_ord") == len(layout) - 1, F.concat(before, "line", closing)).otherwise(F.col("line"))
        )
    return body.unionByName(framed)


def _frames(last: DataFrame, layout: list[_Section], by: Sequence[str], single: bool) -> DataFrame:
    """The lines around each list; an empty list is one line."""
    framed = layout[:-1] if single else layout
    table = F.array(*[
        F.struct(
            F.lit(n).alias("section_ord"),
            F.lit(s.before).alias("before"),
            F.lit(s.after).alias("after"),
            F.lit(_INDENT * s.depth).alias("indent"),
        )
        for n, s in enumerate(framed)
    ])
    owners = last.select(*by).distinct() if by else last.sparkSession.range(1)
    sections = owners.select(*by, F.inline(table))
    joined = sections.join(last, [*by, "section_ord"], "left")
    filled = F.col("last").isNotNull()
    opening = F.struct(
        F.lit(0).alias("slot"),
        F.when(filled, F.concat("before", F.lit("["))).otherwise(F.concat("before", F.lit("[]"), "after")).alias("line"),
    )
    closing = F.struct(F.lit(2).alias("slot"), F.when(filled, F.concat("indent", F.lit("]"), "after")).alias("line"))
    return (
        joined.select(*by, "section_ord", F.inline(F.array(opening, closing)))
        .where(F.col("line").isNotNull())
        .select(*by, "section_ord", "slot", F.lit("").alias("fold"), F.lit("").alias("value"), "line")
    )


LINE_ORDER = ("section_ord", "slot", "fold", "value")


def build_report(
    extraction: DataFrame, validation: DataFrame, started_at: str = "", ended_at: str = "", page: str = "url"
) -> DataFrame:
    """The overall report as lines (see ``report_lines``)."""
    return report_lines(report_items(extraction, validation, page), started_at, ended_at, page=page)


def file_reports(
    by_file: DataFrame,
    validation: DataFrame,
    value_files: DataFrame,
    started_at: str = "",
    ended_at: str = "",
    page: str = "url",
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Every file's report as lines, with the file they belong to."""
    items = file_items(by_file, validation, value_files, page, salt_rows)
    return report_lines(items, started_at, ended_at, by=["file"], page=page)
