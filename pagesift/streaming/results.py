"""Searches are run site by site into a growing directory, which a file stream can follow.

``stream_results`` gives the rows of new files. What later steps do with single rows works on a stream as it is. Two steps depend on rows that came
before and hold state: ``distinct_keep_first`` as a streaming aggregate, and ``first_results``. Both give changes; ``follow`` saves these,
and the saved changes, read as a table, give what reading all files at once would: positions only ever get smaller, so the
smallest one saved is the right one, and a row that was overtaken falls out when the table is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagesift.functions import text
from pagesift.sources.files import REPORT_EXTENSION, flatten_results, parse_result_files, saved_name

_BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

#: groups that the results of a query are spread over, so that one that finds most pages is no single task
SALTS = 16


def stream_results(spark: SparkSession, directory: str, max_files: int = 1000, encoding: str = text.ENCODING) -> DataFrame:
    """Flat result rows of the files of a directory, as they arrive."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("maxFilesPerTrigger", max_files)
        .load(directory)
        .where((F.col("length") > 0) & ~F.col("path").endswith(REPORT_EXTENSION))
    )
    return flatten_results(parse_result_files(files.select(saved_name(F.col("path")).alias("file"), "content"), encoding))


def first_results(rows: DataFrame, limit: int, salts: int = SALTS) -> DataFrame:
    """(query, url, pos): the rows of a stream that are, when they come, among the first ``limit`` distinct URLs of their query and group.

    A group is a query and a hash of the URL; its state is ``limit`` URLs with their smallest positions, whatever has been read. A URL
    that was overtaken by ``limit`` others stays behind them unless it comes again further in front, so it may be forgotten. Rows
    have a URL and a position. The number of groups is fixed when a stream is first started.
    """
    if limit < 1 or salts < 1:
        raise ValueError("limit and salts must be positive")

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = dict(zip(*state.get)) if state.exists else {}
        held = dict(before)
        for chunk in chunks:
            for url, pos in chunk.groupby("url")["pos"].min().items():
                held[url] = min(int(pos), held.get(url, int(pos)))
            if len(held) > limit:
                held = dict(sorted(held.items(), key=lambda item: (item[1], item[0]))[:limit])
        state.update((list(held), list(held.values())))
        changed = [(url, pos) for url, pos in held.items() if before.get(url) != pos]
        yield pd.DataFrame({"query": key[0], "url": [u for u, _ in changed], "pos": [p for _, p in changed]})

    salt = F.pmod(F.xxhash64("url"), F.lit(salts)).alias("salt")
    return (
        rows.select("query", "url", "pos", salt)
        .groupBy("query", "salt")
        .applyInPandasWithState(
            step, "query STRING, url STRING, pos BIGINT", "urls ARRAY<STRING>, positions ARRAY<BIGINT>", "update", GroupStateTimeout.NoTimeout
        )
    )


def follow(changes: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Save the changes of a stream, one folder per batch; a batch that is run again replaces its folder.

    ``trigger`` is that of ``DataStreamWriter.trigger``; by default what is there is read and the stream ends.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(save)
        .start()
    )


def saved_changes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The saved changes of all batches; ``distinct_keep_first`` or ``cap_results`` of them is the state of the stream."""
    return spark.read.parquet(folder).select(*columns)
