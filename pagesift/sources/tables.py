"""Tables of fetched content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift import schemas


#: bytes up to which a table is spread over the cores; larger ones are split by the scan alone
SPREAD_BYTES = 1 << 30


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of pages.

    A table of up to ``SPREAD_BYTES`` in fewer scan partitions than cores is spread out, because the work per page is
    heavy. A larger table is never shuffled here, however many cores there are. Rows are dealt out in turn, so
    neither a hot site nor a run of long pages lands in one task.
    """
    pages = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    few = pages.rdd.getNumPartitions() < cores
    return pages.repartition(cores) if few and stored_bytes(pages) <= SPREAD_BYTES else pages


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table, as Spark has listed them."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of responses; columns it lacks are null."""
    stored = read_pages(spark, path)
    fields = (field.strip().split(" ") for field in schemas.RESPONSES.split(","))
    return stored.select(
        *[(F.col(n) if n in stored.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
    )


def copy_order(order_by: str | None, *content: str) -> Column:
    """Order among the copies of a URL: by ``order_by``, nulls before all, then by content hash."""
    digest = F.xxhash64(*content)
    return digest if order_by is None else F.struct(F.col(order_by), digest)


def one_per_url(responses: DataFrame, order: Column | None = None, key: str = "url") -> DataFrame:
    """One row per URL: the last in ``order``. Copies of a hot URL are reduced before the shuffle."""
    rest = [c for c in responses.columns if c != key]
    last = F.max_by(F.struct(*rest), copy_order(None, *rest) if order is None else order)
    return responses.groupBy(key).agg(last.alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def latest(copies: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a written table that come last in ``order`` for their key.

    Copies are told apart by a number, so that only key, order and number are sorted and compared, and what a
    row holds is moved once, by the join on the number.
    """
    chosen = copies.groupBy(key).agg(F.max_by("number", order).alias("number"))
    return copies.join(chosen.select("number"), "number").drop("number", order)
