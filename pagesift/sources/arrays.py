"""Result files of any size: JSON arrays that many tasks read together.

Spark's text source cuts files at closing braces, wherever they stand, and deals the pieces of a large file to many tasks. Where an element of
the array ends depends on all text before it, by two facts alone: whether a piece begins inside a string, and how deep in brackets. Each piece tells what it
does to both, for either way it may begin; running sums within a block of the file, and sums over the few blocks before it, settle the rest. Only pieces'
numbers are sorted for that. Pieces of an element are then brought together, most elements being one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift import schemas
from pagesift.functions import text
from pagesift.operators.skew import join_hot
from pagesift.session import materialize
from pagesift.sources.files import REPORT_EXTENSION, flat_rows, saved_name

#: the schema of one element, and whether it could not be read
_ENTRY = schemas.RESULTS_RAW.removeprefix("ARRAY<").removesuffix(">>") + ", bad: STRING>"


def _count(of: Column, signs: str) -> Column:
    return F.length(of) - F.length(F.translate(of, signs, ""))


def _deeper(plain: Column, inside: bool) -> Column:
    """How much deeper in brackets a piece without escapes leads that begins inside a string or not; its closing brace counts."""
    outside = F.regexp_replace(F.concat(F.lit('"' if inside else ""), plain), '"[^"]*("|$)', "")
    closes = F.when((_count(plain, '"') + int(inside)) % 2 == 0, 1).otherwise(0)
    return _count(outside, "[{") - _count(outside, "]") - closes


def _pieces(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(file, block, n, piece, size, quotes, deeper0, deeper1), written: the text up to each closing brace, in the order of block and n."""
    if "}".encode(encoding) != b"}":
        raise ValueError(f"braces can't be told apart in {encoding}")
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        F.col("_metadata.file_size").alias("size"),
        text.decode(F.col("value").cast("binary"), encoding).alias("piece"),
        (F.octet_length("value") + 1).alias("bytes"),
    ).where(~F.col("file").endswith(REPORT_EXTENSION))
    plain = F.regexp_replace("piece", r"(?s)\\.|\\$", "")
    told = raw.select("*", _count(plain, '"').alias("quotes"), _deeper(plain, False).alias("deeper0"), _deeper(plain, True).alias("deeper1"))
    return materialize(told, "pieces")


def _before(*by: str) -> Window:
    return Window.partitionBy("file", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(of: Column | str, *by: str) -> Column:
    return F.coalesce(F.sum(of).over(_before(*by)), F.lit(0))


def _placed(pieces: DataFrame) -> DataFrame:
    """(file, block, n, element, depth, inside, ends, last) of each piece: the number of its element, how it begins, whether it ends it."""
    block = ["file", "block"]
    narrow = pieces.select(*block, "n", "quotes", "deeper0", "deeper1").withColumn("odd", _sum_before("quotes", "block", "n") % 2)
    # in a block that begins outside a string, and in one that begins inside
    either = narrow.withColumns(
        {
            "way0": F.when(F.col("odd") == 0, F.col("deeper0")).otherwise(F.col("deeper1")),
            "way1": F.when(F.col("odd") == 0, F.col("deeper1")).otherwise(F.col("deeper0")),
        }
    ).withColumns({"depth0": _sum_before("way0", "block", "n"), "depth1": _sum_before("way1", "block", "n")})
    either = materialize(either, "depths")
    blocks = either.groupBy(*block).agg(*[F.sum(c).alias(f"all_{c}") for c in ("quotes", "way0", "way1")])
    blocks = blocks.withColumn("begins", _sum_before("all_quotes", "block") % 2)
    blocks = blocks.withColumn("level", _sum_before(F.when(F.col("begins") == 0, F.col("all_way0")).otherwise(F.col("all_way1")), "block"))
    outside = F.col("begins") == 0
    known = either.join(blocks.select(*block, "begins", "level"), block).select(
        *block,
        "n",
        (F.col("level") + F.when(outside, F.col("depth0")).otherwise(F.col("depth1"))).alias("depth"),
        F.when(outside, F.col("way0")).otherwise(F.col("way1")).alias("deeper"),
        ((F.col("odd") + F.col("begins")) % 2).alias("inside"),
        ((F.col("odd") + F.col("begins") + F.col("quotes")) % 2 == 0).alias("brace"),
    )
    known = known.withColumn("ends", F.col("brace") & (F.col("depth") + F.col("deeper") == 1))
    known = materialize(known.withColumn("within", F.count_if("ends").over(_before("block", "n"))), "ends")
    by_block = known.groupBy(*block).agg(F.count_if("ends").alias("all_ends"), F.max("n").alias("last_n"))
    latest = F.max("block").over(Window.partitionBy("file")) == F.col("block")
    by_block = by_block.select(*block, _sum_before("all_ends", "block").alias("before"), F.when(latest, F.col("last_n")).alias("last_n"))
    return known.join(by_block, block).select(
        *block, "n", (F.col("before") + F.col("within")).alias("element"), "depth", "inside", "ends", F.col("n").eqNullSafe(F.col("last_n")).alias("last")
    )


def parse_arrays(spark: SparkSession, path: str | list[str], encoding: str = text.ENCODING) -> tuple[DataFrame, DataFrame]:
    """(file, e, entry) of the elements of all files that are one JSON array of result objects, and (file) of those that are not.

    The rules are those of ``files.parse_result_files`` for arrays: one bad element rejects its file, and so does any other root, a text
    behind the array or between elements, or a file that ends too soon. An element is one row, as there, and limited by what a row can hold. Empty
    files are neither.
    """
    pieces = _pieces(spark, path, encoding)
    placed = _placed(pieces).join(pieces.select("n", "piece"), "n")
    placed = materialize(placed, "placed")
    # the tail counts as a piece without its brace
    tail = placed.where("last")
    lone = (F.col("element") == 0) & (F.col("depth") == 0)
    closed = (F.col("depth") == 1) & (F.col("inside") == 0)
    stripped = text.strip(F.col("piece"))
    good = (lone & stripped.rlike(r"^\[\s*\]$")) | (closed & (F.col("element") > 0) & (stripped == "]"))
    sizes = pieces.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.first("size").alias("size"))
    whole = sizes.join(tail.select("file", good.alias("good")), "file").where(~F.col("good") | (F.col("bytes") != F.col("size") + 1)).select("file")

    body = placed.where(~F.col("last"))
    one_piece = (F.col("depth") == F.when(F.col("element") == 0, 0).otherwise(1)) & (F.col("inside") == 0) & F.col("ends")
    single, several = body.where(one_piece), body.where(~one_piece)
    ordered = F.array_sort(F.collect_list(F.struct("block", "n", "piece")))
    brought = several.groupBy("file", "element").agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "}").alias("piece"), F.max("ends").alias("ends")
    )
    elements = single.select("file", "element", "piece", "ends").unionByName(brought)
    given = text.strip(F.col("piece"))
    opened = F.when(F.col("element") == 0, F.lit("[")).otherwise(F.lit(","))
    inner = F.concat(text.strip(F.substr(given, F.lit(2))), F.lit("}"))
    options = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "bad"}
    read = F.from_json(inner, _ENTRY, options)
    fits = F.col("ends") & given.startswith(opened) & inner.startswith("{")
    parsed = materialize(elements.select("file", F.col("element").alias("e"), F.when(fits, read).alias("entry")), "elements")
    bad = parsed.where(F.col("entry").isNull() | F.col("entry.bad").isNotNull()).select("file").union(whole).distinct()
    bad = materialize(bad.withColumn("rejected", F.lit(True)), "rejected")
    kept = join_hot(parsed, bad, "file", "e", "left").where(F.col("rejected").isNull())
    return kept.select("file", "e", F.col("entry").dropFields("bad").alias("entry")), bad.select("file")


def read_result_arrays(spark: SparkSession, path: str | list[str], encoding: str = text.ENCODING) -> DataFrame:
    """Flat result rows of JSON array files of any size, as ``files.read_results`` gives them; rejected files are left out."""
    entries, _ = parse_arrays(spark, path, encoding)
    offset = F.shiftleft(F.coalesce(F.col("entry.chunk"), F.col("e").cast("bigint")), 31)
    return flat_rows(entries.withColumn("file", saved_name(F.col("file"))), F.col("entry"), [offset.alias("n")])
