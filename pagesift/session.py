"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: settings the plans are written for; pass them to ``SparkSession.builder.config(map=SETTINGS)``
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # pages are long; this many go to a Python worker at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


#: folders written by ``materialize`` or named by ``written``, for ``stage_tables``
_written: list[str] = []


def written(path: str) -> None:
    """Name a folder that ``stage_tables`` is to delete with the tables."""
    _written.append(path)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one machine, gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pagesift-"))
    return shared_dir(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage that several later steps read, and read it back.

    A parquet table, not a cache: later steps prune its columns, and a lost executor costs nothing.
    """
    path = f"{shared_dir(df.sparkSession)}/pagesift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """``materialize``, and metrics of the rows taken while they were written, so that counting does not read them again.

    They are observed by the tasks that write, whose results count once, also where a task is run again.
    """
    seen = Observation(name)
    table = materialize(df.observe(seen, *[metric.alias(n) for n, metric in metrics.items()]), name)
    return table, {n: seen.get.get(n) or 0 for n in metrics}


@contextmanager
def stage_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that were written meanwhile, once what was made of them is saved.

    ``with stage_tables(spark): run = extract_run(...); run.save(...)``
    """
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            delete_folder(spark, path)
        del _written[before:]


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
