"""Responses stored so that attaching them moves no body: bucketed and sorted by request.

A store is written once and read many times. Of the copies of a request it holds the last one, so ``attach_stored`` joins it as it lies: the
inputs are brought to its buckets, the bodies stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import urls
from pagesift.session import materialize
from pagesift.sources.tables import copy_order, latest

#: column that a store is bucketed by: the canonical form of the URL
REQUEST = "request"

_CONTENT = ("status", "error", "text", "body")


def write_store(responses: DataFrame, table: str, path: str, buckets: int, order_by: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Save the last response of every request as a bucketed table at ``path``.

    Choose ``buckets`` so that one holds a few hundred MB. Which copy counts is decided on narrow columns. Where there are copies, a join on row
    numbers, which no hot URL slows, drops them before bodies are shuffled into their buckets. A response without a URL answers no request and is left out.
    """
    given = responses.where(F.col("url").isNotNull()).withColumns({REQUEST: urls.canonical(F.col("url")), "copy": copy_order(order_by, *_CONTENT)})
    numbered = materialize(given.withColumn("number", F.monotonically_increasing_id()), "copies")
    narrow = numbered.select(REQUEST, "copy", "number").withColumn("row", F.col("number"))
    chosen = materialize(latest(narrow, REQUEST, "copy").select(F.col("row").alias("number")), "chosen")
    if chosen.count() < numbered.count():
        numbered = numbered.join(chosen, "number", "left_semi")
    stored = numbered.drop("copy", "number").repartition(buckets, REQUEST)
    stored.write.mode(mode).bucketBy(buckets, REQUEST).sortBy(REQUEST).option("path", path).saveAsTable(table)
    return responses.sparkSession.table(table)


def open_store(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """Name a store that another session wrote to ``path`` with this number of buckets."""
    columns = spark.read.parquet(path).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({fields}) USING parquet "
        f"CLUSTERED BY ({REQUEST}) SORTED BY ({REQUEST}) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def attach_stored(inputs: DataFrame, store: DataFrame) -> DataFrame:
    """Each row of ``inputs`` (url, …) with the stored response of its request, or nulls; the stored URL is ``stored_url``.

    A merge join on the buckets, or a broadcast of inputs that Spark knows to be small.
    """
    asked = inputs.withColumn(REQUEST, urls.canonical(F.col("url")))
    held = store.withColumnRenamed("url", "stored_url")
    return asked.join(held, REQUEST, "left").drop(REQUEST)
