"""Documents to packed training sequences: quality rules, languages, exact and near duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last return the columns
of ``docs`` for the documents that stay. Between stages, ``run`` writes what stays as Parquet in the shared folder and reads it again.

Stages carry the columns of documents under names of their own, so no column of the input clashes with what a stage computes. Nulls, empty texts, repeated
rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import byte_cnn, histogram_packing, jaccard_links, repetition, stream_dedup
from pagesift.llm.queries import SPECIALS
from pagesift.operators.skew import join_hot
from pagesift.session import delete_folder, materialize, shared_dir, stage_tables

#: part of a document's bytes that some language must claim clearly
LEAST_CLEAR = 0.3
#: dropped rows (8 bytes each) that may be broadcast; more are joined by a shuffle
BROADCAST_ROWS = 1_000_000
#: files whose names may be broadcast (some 200 bytes each) to number rows where they are; rows of more files are numbered in a copy
NUMBERED_FILES = 100_000


def _own_names(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``docs`` with its columns renamed, their new names, and that of the text."""
    names = [f"column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and repeat little of themselves."""
    own, names, text = _own_names(docs)
    return repetition.repetition_rules(own, names, text).where("kept").select(*names).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which enough is clearly in some learned language; the network learns from the stage's own input.

    Documents without a letter go. Where no row has a language to learn, all others stay.
    """
    own, names, text = _own_names(docs)
    net = byte_cnn.learn(docs.select("doc_id", "text", "lang"))
    if net is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = byte_cnn.identify(own, names, net, text)
    return found.where((F.col("lang_pred") != byte_cnn.NONE) & (F.col("clear") >= LEAST_CLEAR)).select(*names).toDF(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, the one with the smallest id."""
    return stream_dedup.dedup(docs, docs.columns).where("kept").select("doc.*")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``node``, a number of each row that is the same whenever the table is read.

    Rows of files are numbered by file and place, without a copy of them; other rows are written with their number.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not read from files
        placed = None
    files = materialize(placed.select("_file").distinct(), "files") if placed else None
    if not files or files.count() > NUMBERED_FILES:
        return materialize(docs.withColumn("node", F.monotonically_increasing_id()), "numbered")
    names = sorted(r["_file"] for r in files.collect())
    table = docs.sparkSession.createDataFrame(list(enumerate(names)), "_number long, _file string")
    node = F.shiftleft("_number", 40) + F.col("_row")
    return placed.join(F.broadcast(table), "_file").withColumn("node", node).drop("_file", "_row", "_number")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group that near copies connect: the one with the smallest id, rows without an id last.

    Rows count, not ids: of rows that share an id each is kept or dropped by its own text.
    """
    own, names, text = _own_names(docs)
    rows = numbered(docs.toDF(*names))
    groups = materialize(jaccard_links.near_copies(rows.select("node", F.col(text).alias("text"))), "near_copies")
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    doc_id = F.col(names[docs.columns.index("doc_id")])
    ids = materialize(groups.join(rows.select("node", F.struct(doc_id.isNull(), doc_id, "node").alias("rank")), "node"), "ranks")
    stays = ids.groupBy("root").agg(F.min_by("node", "rank").alias("stays"))
    dropped = materialize(join_hot(ids.drop("rank"), stays, "root", "node").where("node <> stays").select("node"), "near_duplicates")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, "node", "left_anti").select(*names).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, and where they are in which sequence."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = histogram_packing.pieces(docs.select("doc_id", "text"), ["doc_id"], ranks, public_tokenizers.PATTERN, specials=SPECIALS)
    return histogram_packing.place(spark, cut, ["doc_id", "start", "ids_crc32", "doc_tokens"]).drop("piece")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("packing", packing),
]

#: the stages use a trained network, a tokenizer and graph search, which SQL can't express; a test holds them against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage wrote for itself, and what it read, is deleted once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pagesift/{name}-{uuid.uuid4().hex}"
        with stage_tables(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), path
    return docs
