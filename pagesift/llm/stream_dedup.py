"""Exact deduplication by a stream with disk-backed keyed state.

Texts are equal if they are identical after each run of blanks became one space. Documents are first written to a content store, a
table in the shared folder in which a row's number locates its content. A stream then reads the store's digests. Its state, kept
in RocksDB on the executors' disks and saved with the checkpoint, has no watermark and never expires: per digest it holds the smallest
stable id so far, the locator of that row's content and the number of rows. Rows are pre-aggregated before they reach the state, so a digest
that a third of all rows share costs no more than others. Every batch writes the keys it changed; a batch that is run
again overwrites what it wrote.

A digest that was hit is only a candidate: the content of each further row is compared with the located content, byte by byte. Rows that differ
(none, as long as nobody breaks SHA-256; a weaker digest may be given) go through another round among themselves.

The row with the smallest id stays. Null texts count as empty texts, a null id as larger than any other; of rows with equal id and equal text
one stays. All columns of the input are carried in one struct, so no name can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import text_of
from pagesift.operators.skew import join_hot
from pagesift.session import shared_dir, written

#: groups of copies whose keys may be broadcast (under 100 bytes each); more are joined by a shuffle
BROADCAST_KEYS = 200_000
#: copies of one text that are compared in one task
SALT_ROWS = 50_000
LAST_ID = 2**63 - 1

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # many small stores: a log file set aside in each would take more room than the state
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def write_store(docs: DataFrame, carry: list[str], path: str, text: str = "text", doc_id: str = "doc_id") -> None:
    """Add documents to the content store; ``row`` is their locator in the files of this call."""
    docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.unhex(F.sha2(normalised(text_of(text)).cast("binary"), 256)).alias("sha"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"),
        F.col(text).alias("text") if text not in carry else F.lit(None).cast("string").alias("text"),
    ).write.mode("append").parquet(path)


def stream_keys(spark: SparkSession, store: str, keys: str, checkpoint: str, digest: Callable[[Column], Column], max_files: int) -> None:
    """Run the stream over all files of the store that the checkpoint hasn't seen, ``max_files`` per batch."""
    session = spark.newSession()
    for name, value in _STATE.items():
        session.conf.set(name, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        session.readStream.schema(session.read.parquet(store).schema)
        .option("maxFilesPerTrigger", max_files)
        .parquet(store)
        .select(digest(F.col("sha")).alias("digest"), "id", "row")
    )
    state = rows.groupBy("digest").agg(
        F.min("id").alias("keep_id"), F.min_by("row", "id").alias("keep_row"), F.count(F.lit(1)).alias("n")
    )

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{keys}/batch={number}")

    query = (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(changed)
        .start()
    )
    query.awaitTermination()


def latest_copies(spark: SparkSession, keys: str) -> DataFrame:
    """(digest, keep_id, keep_row, n) of the digests with more than one row, as the last batch left them."""
    seen = spark.read.schema("digest binary, keep_id long, keep_row long, n long").parquet(keys)
    last = seen.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min_by("keep_row", "keep_id").alias("keep_row"), F.max("n").alias("n"))
    return last.where("n > 1")


def dedup(
    docs: DataFrame,
    carry: list[str],
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = lambda sha: sha,
    max_files: int = 10_000,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc`` (struct of the ``carry`` columns), ``keep_id``, ``group_size``, ``kept``, ``sha``."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/pagesift/dedup-{uuid.uuid4().hex}"
    written(folder)
    store = f"{folder}/store"
    write_store(docs, carry, store, text, doc_id)
    body = F.col(f"doc.`{text}`") if text in carry else F.col("text")
    return _rounds(spark, folder, store, body, digest, max_files, broadcast_keys)


def _rounds(spark: SparkSession, folder: str, store: str, body: Column, digest: Callable[[Column], Column], max_files: int, broadcast_keys: int) -> DataFrame:
    rows = spark.read.parquet(store)
    if rows.isEmpty():
        return _result(rows.withColumns({"keep_id": F.lit(0), "n": F.lit(0), "keep_row": F.col("row")}))
    stream_keys(spark, store, f"{folder}/keys", f"{folder}/checkpoint", digest, max_files)
    latest_copies(spark, f"{folder}/keys").write.parquet(f"{folder}/copies")
    copies = spark.read.parquet(f"{folder}/copies")
    few = copies.count() <= broadcast_keys

    def with_copies(keyed: DataFrame, copies: DataFrame, how: str = "left") -> DataFrame:
        return keyed.join(F.broadcast(copies), "digest", how) if few else join_hot(keyed, copies, "digest", "row", how, SALT_ROWS)

    keyed = rows.withColumn("digest", digest(F.col("sha")))
    hits = with_copies(keyed, copies, "inner").withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
    content = normalised(F.coalesce(body, F.lit("")))
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    first = hits.where("row = keep_row").select("keep_row", content.alias("located"), salts.alias("salt"))
    salt = F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
    others = hits.where("row <> keep_row").select("row", "keep_row", salt.alias("salt"), content.alias("content"))
    compared = others.join(first, ["keep_row", "salt"]).select("row", (F.col("content") != F.col("located")).alias("differs"))
    differing = compared.where("differs").select("row")
    if differing.isEmpty():
        return _result(with_copies(keyed, copies))
    differing.write.parquet(f"{folder}/differing")
    differing = spark.read.parquet(f"{folder}/differing")
    rows.join(differing, "row", "left_semi").write.parquet(f"{folder}/next/store")
    same = with_copies(keyed.join(differing, "row", "left_anti"), copies.drop("n"))
    sizes = same.where("keep_row is not null").groupBy("keep_row").agg(F.count(F.lit(1)).alias("n"))
    others = _rounds(spark, f"{folder}/next", f"{folder}/next/store", body, digest, max_files, broadcast_keys)
    return _result(join_hot(same, sizes, "keep_row", "row", "left", SALT_ROWS)).unionByName(others)


def _result(rows: DataFrame) -> DataFrame:
    own = F.when(F.col("id") != LAST_ID, F.col("id"))
    return rows.select(
        "doc",
        F.when(F.col("keep_row").isNull(), own).otherwise(F.nullif(F.col("keep_id"), F.lit(LAST_ID))).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "sha",
    )
