"""Text and JSON files. A file is one row of ``binaryFile`` until it is decoded and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import text
from pagesift.operators.distinct import distinct_keep_first

#: fixed value: files written by the per-file report, which are no input
REPORT_EXTENSION = ".report.json"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, content) of every non-empty file; a directory is read one level deep."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "false")
        .load(path)
        .where(F.col("length") > 0)
        .select(F.col("path").alias("file"), "content")
    )


def read_queries(spark: SparkSession, path: str, encoding: str = text.ENCODING) -> DataFrame:
    """(query, pos): the lines of a file, stripped, without empty and repeated ones."""
    lines = read_files(spark, path).select(
        F.posexplode(F.split(text.file_text(F.col("content"), encoding), "\n")).alias("pos", "line")
    )
    stripped = lines.select(text.strip(F.col("line")).alias("query"), F.col("pos").cast("bigint").alias("pos"))
    return distinct_keep_first(stripped.where(F.col("query") != ""), "query")


def literal_queries(spark: SparkSession, queries: list[str]) -> DataFrame:
    """(query, pos) of queries given by hand; they are taken as they are."""
    rows = [(query, pos) for pos, query in enumerate(queries)]
    return distinct_keep_first(spark.createDataFrame(rows, schemas.QUERIES), "query")


def read_excludes(spark: SparkSession, path: str) -> list[str]:
    """Exclude patterns, one per line. They become literals of a plan, so they end on the driver."""
    from pagesift.functions.patterns import check_patterns

    rows = read_queries(spark, path).orderBy("pos").collect()
    patterns = [row.query for row in rows]
    check_patterns(spark, patterns)
    return patterns


def parse_result_files(files: DataFrame, encoding: str = text.ENCODING) -> DataFrame:
    """Add ``entries`` to (file, content): the parsed array, or null for a rejected file.

    One bad element rejects its file, and so does anything but one array: another root, text behind it, single quotes. The
    array is read as the only field of an object, since the parser would ignore what follows it. Lines of
    objects with a ``chunk``, as ``write_results`` makes them, count as an array.
    """
    content = text.file_text(F.col("content"), encoding)
    lines = F.concat(F.lit("["), F.regexp_replace(content, "\\n", ","), F.lit("]"))
    array = F.when(content.startswith("{"), lines).when(content.startswith("[") & content.endswith("]"), content)
    schema = f"entries {schemas.RESULTS_RAW}, bad STRING"
    options = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "bad"}
    read = F.from_json(F.concat(F.lit('{"entries":'), array, F.lit("}")), schema, options)
    parsed = files.select("file", content.startswith("{").alias("lines"), read.alias("read"))
    bad = F.exists("read.entries", lambda e: e.isNull() | (F.col("lines") & e["chunk"].isNull()))
    return parsed.select("file", F.when(F.col("read.bad").isNull() & ~bad, F.col("read.entries")).alias("entries"))


def flat_rows(entries: DataFrame, entry: Column, order: list[Column]) -> DataFrame:
    """(query, url, pos, file): one row per URL of an entry; entries without URLs give none."""
    urls = entries.select(
        "file",
        *order,
        F.coalesce(entry["query"], F.lit("")).alias("query"),
        F.posexplode(entry["urls"]).alias("i", "url"),
    )
    return urls.select("query", F.coalesce("url", F.lit("")).alias("url"), (F.col("n") + F.col("i")).alias("pos"), "file")


def read_results(
    spark: SparkSession, path: str | list[str], skip_reports: bool = True, encoding: str = text.ENCODING
) -> DataFrame:
    """Flat result rows of JSON array files; rejected files are left out (see ``rejected_results``)."""
    return flatten_results(parse_result_files(_result_files(spark, path, skip_reports), encoding))


def flatten_results(parsed: DataFrame) -> DataFrame:
    entries = parsed.where(F.col("entries").isNotNull()).select("file", F.posexplode("entries").alias("e", "entry"))
    # an entry holds fewer than 2^31 URLs, so the offset keeps the order across entries, or across the rows of a long list
    offset = F.shiftleft(F.coalesce(F.col("entry.chunk"), F.col("e").cast("bigint")), 31)
    return flat_rows(entries, F.col("entry"), [offset.alias("n")])


def rejected_results(spark: SparkSession, path: str | list[str], skip_reports: bool = True) -> DataFrame:
    """Files that could not be read as results."""
    parsed = parse_result_files(_result_files(spark, path, skip_reports))
    return parsed.where(F.col("entries").isNull()).select("file")


def _result_files(spark: SparkSession, path: str | list[str], skip_reports: bool) -> DataFrame:
    files = read_files(spark, path).withColumn("file", saved_name(F.col("file")))
    return files.where(~F.col("file").endswith(REPORT_EXTENSION)) if skip_reports else files


def saved_name(file: Column) -> Column:
    """The parts of a saved search go by the name of its folder; any other file by its own."""
    return F.regexp_replace(file, r"/part-[^/]*$", "")


def read_result_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Flat result rows of searches saved by ``write_results``, each under the name of its folder; ``chunk`` orders its lines."""
    lines = spark.read.schema(f"{schemas.RESULTS_LINE}, chunk BIGINT").json(path)
    lines = lines.withColumn("file", saved_name(F.col("_metadata.file_path")))
    return flat_rows(lines, F.struct("query", "urls"), [F.shiftleft("chunk", 31).alias("n")])


def read_plaintext(spark: SparkSession, path: str | list[str], encoding: str = text.ENCODING) -> DataFrame:
    """(file, text): a file is one text, treated like a fetched page."""
    return read_files(spark, path).select("file", text.file_text(F.col("content"), encoding).alias("text"))


def read_text_parts(spark: SparkSession, path: str | list[str], encoding: str = text.ENCODING) -> DataFrame:
    """(file, part, text): the lines of texts of any size, read by many tasks; ``part`` sorts them.

    Files that are the parts of one saved text go by the name of its folder. The encoding must keep ASCII as it is; ``operators.parts`` finds patterns in such rows.
    """
    if "\n".encode(encoding) != b"\n":
        raise ValueError(f"lines can't be told apart in {encoding}; read the whole text")
    lines = spark.read.text(path).select(
        saved_name(F.col("_metadata.file_path")).alias("file"),
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("n"),
        ).alias("part"),
        text.decode(F.col("value").cast("binary"), encoding).alias("text"),
    )
    return lines


def read_report(spark: SparkSession, path: str, encoding: str = text.ENCODING) -> DataFrame:
    """(file, part, text) of an earlier report, to be tested again with ``parts.extract_parts``.

    A report written here is a folder of part files; in order their lines are one text, as any other file's are. Name UTF-8 to
    get non-ASCII values back as they were.
    """
    return read_text_parts(spark, path, encoding)
