"""Results, downloads and reports as files. Nothing passes through the driver or a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.operators import fetch
from pagesift.operators.report import LINE_ORDER
from pagesift.operators.results import CHUNK, collect_urls_by_query, url_filename
from pagesift.session import materialize
from pagesift.sources.files import REPORT_EXTENSION
from pagesift.sources.tables import copy_order, latest

#: report entries per part file: later readers load a part as one text
REPORT_PART_ROWS = 100_000


def write_results(results: DataFrame, path: str, chunk: int = CHUNK, mode: str = "errorifexists") -> None:
    """One JSON object per line: a query with its URLs in order (several lines for a long list).

    Rows that name their file keep the positions they have there, so a query of several files has lines of its own for each.
    """
    grouped = collect_urls_by_query(results, chunk, ("file", "query") if "file" in results.columns else ("query",))
    grouped.select(
        "query", F.lit("").alias("user_agent"), F.lit("").alias("proxy"), "urls", "chunk"
    ).write.mode(mode).json(path)


def write_downloads(
    url_table: DataFrame,
    responses: DataFrame,
    path: str,
    directory: str = "",
    order_by: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """(filename, url, content) of every URL whose status is 200.

    Only those URLs get a file name, so names are numbered without gaps.
    """
    downloads(url_table, responses, directory, order_by).write.mode(mode).parquet(path)


def downloads(
    url_table: DataFrame, responses: DataFrame, directory: str = "", order_by: str | None = None
) -> DataFrame:
    """(filename, url, content) of the URLs with status 200 and some content."""
    wanted = materialize(url_table.select("url").distinct(), "wanted")
    content = F.coalesce("body", F.encode("text", "UTF-8"))
    fetched = fetch.only_wanted(responses, wanted).select(
        "url", "status", content.alias("content"), copy_order(order_by, "status", "text", "body").alias("copy")
    )
    # the copy is chosen on narrow columns; the content is written once and moved once at most, by the join with the names
    fetched = materialize(fetched.withColumn("number", F.monotonically_increasing_id()), "fetched")
    usable = F.col("status").eqNullSafe(200) & (F.coalesce(F.length("content"), F.lit(0)) > 0)
    narrow = fetched.select("url", "copy", "number", usable.alias("usable"))
    saved = latest(narrow.join(wanted, "url", "left_semi").withColumn("row", F.col("number")), "url", "copy")
    saved = materialize(saved.where("usable").select("url", F.col("row").alias("number")), "saved")
    named = saved.join(url_filename(saved.select("url"), directory), "url").select("number", "filename")
    return fetched.join(named, "number").select("filename", "url", "content")


def write_report(lines: DataFrame, outcomes: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """The overall report: a directory of text parts that, in order, are one JSON document.

    Written only if a page gave results; the answer tells whether it was.
    """
    if not fetch.has_outcome(outcomes, schemas.EXTRACTION, schemas.SUCCESS):
        return False
    ordered = lines.orderBy(*LINE_ORDER).select("line")
    ordered.write.mode(mode).option("maxRecordsPerFile", REPORT_PART_ROWS).text(path)
    return True


def write_file_reports(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A directory per file, with the parts of that file's report, and ``names``: which directory is whose.

    Names of files may be longer than a directory's name can be, so directories go by a hash; ``names`` holds (report, report_name, file).
    Rows are sorted by file and then by place in the report, so a file with a third of all pages is
    written by many tasks and a task with many small files keeps one open at a time. Files whose
    names differ only in the extension share a report name and are kept apart by the file.
    """
    named = lines.withColumn("report", F.md5("file"))
    names = named.select("report", report_name().alias("report_name"), "file").distinct()
    names.write.mode(mode).parquet(f"{path}/names")
    keys = ["report", *LINE_ORDER]
    (
        named.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("line", "report")
        .write.mode(mode)
        .option("maxRecordsPerFile", REPORT_PART_ROWS)
        .partitionBy("report")
        .text(f"{path}/reports")
    )


def report_name():
    """The file name without its last extension, then the report extension.

    Only the file name is cut: a dot in a directory name is part of the directory.
    """
    return F.concat(F.regexp_replace("file", r"\.[^./]*$", ""), F.lit(REPORT_EXTENSION))
