"""Token counts of documents in flat token files that have no index, by a scan for separators.

Files are cut into blocks of a fixed number of tokens, whatever documents they hold, and blocks are searched in parallel: one vectorised
comparison finds all end-of-document ids of a block. A block alone knows only the documents that lie within it. A prefix scan over the blocks of each
file supplies the rest: how many documents ended before the block, and how many tokens of an open document lie before it. So a document may
span any number of blocks. Tokens after a file's last separator are one more, unfinished document.

``write_flat`` makes such files: ids and the end-of-document id, 2 bytes each where the ids allow it, one file per task. It also returns
which document is the n-th of which file, which the files themselves don't tell. Null and empty texts are documents of no tokens. An empty table
gives no files and an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.llm.byte_bpe import byte_bpe
from pagesift.llm.common import file_system, fresh_dir, ship, text_chunks, text_of, whole_file
from pagesift.session import materialize

#: tokens in a block
BLOCK = 1 << 20
#: blocks that a task searches
TASK_BLOCKS = 8


def write_flat(docs: DataFrame, path: str, pattern: str, end: int, folder: str, text: str = "text", doc_id: str = "doc_id", kind: str = "<u2") -> DataFrame:
    """Write all documents as flat token files into ``folder``; (doc_id, file, ordinal) of each."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("body"))
    limit = np.iinfo(kind).max

    def run(batches):
        encoder = byte_bpe(path, pattern)
        name, done = f"part-{TaskContext.get().partitionId():06d}.tokens", 0
        parts = text_chunks(batches, "body")
        first = next(parts, None)
        if first is None:
            return
        with whole_file(folder, name) as out:
            while first is not None:
                for body in first.column("body").to_pylist():
                    ids = np.append(encoder.ids(body), np.uint32(end))
                    if ids.max() > limit:
                        raise ValueError("an id doesn't fit the token files' number type")
                    out.write(ids.astype(kind).tobytes())
                n = first.num_rows
                yield pa.RecordBatch.from_arrays(
                    [first.column("doc_id"), pa.array([name] * n), pa.array(np.arange(done, done + n))],
                    names=["doc_id", "file", "ordinal"],
                )
                done += n
                first = next(parts, None)

    return materialize(narrow.mapInArrow(run, "doc_id long, file string, ordinal long"), "flat")


def blocks_of(spark: SparkSession, folder: str, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, block) of all blocks of the token files in a folder. Files are listed, not read."""
    size = np.dtype(kind).itemsize * block
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select("path", "length")
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)).cast("long"))
    return files.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(blocks).alias("block"))


def scan(spark: SparkSession, folder: str, end: int, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Per block: tokens, separators, tokens before the first and after the last of them, and the counts of documents that lie within."""
    ship(spark)
    width = np.dtype(kind).itemsize
    listed = blocks_of(spark, folder, kind, block)

    def run(batches):
        system, at = file_system(folder)
        for batch in batches:
            for name, number in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                with system.open_input_file(f"{at}/{name}") as file:
                    tokens = np.frombuffer(file.read_at(block * width, number * block * width), kind)
                found = np.flatnonzero(tokens == end)
                head, tail = (found[0], len(tokens) - found[-1] - 1) if len(found) else (0, len(tokens))
                inner = np.diff(found).astype(np.int32) - 1
                numbers = [pa.array([int(x)], pa.int64()) for x in (number, len(found), head, tail)]
                inner = pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), pa.array(inner.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), *numbers, inner], names=["file", "block", "found", "head", "tail", "inner"]
                )

    tasks = max(1, -(-listed.count() // TASK_BLOCKS))
    dealt = listed.repartition(tasks, "file", "block")
    return dealt.mapInArrow(run, "file string, block long, found long, head long, tail long, inner array<int>")


def stitched(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``first``, the documents that ended before the block, and ``carry``, the tokens of the one open at its start."""
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # blocks without a separator belong to the run that the last block with one has opened
    by_run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    holds = F.col("found") > 0
    open_tokens = F.coalesce(F.last(F.when(holds, F.col("tail")), ignorenulls=True).over(by_file), F.lit(0))
    passed = F.coalesce(F.sum(F.when(~holds, F.col("tail"))).over(by_run), F.lit(0))
    return (
        blocks.withColumn("first", F.coalesce(F.sum("found").over(by_file), F.lit(0)))
        .withColumn("run", F.coalesce(F.sum(holds.cast("int")).over(by_file), F.lit(0)))
        .withColumn("carry", open_tokens + passed)
        .withColumn("final", F.col("block") == F.max("block").over(Window.partitionBy("file")))
        .drop("run")
    )


def token_counts(spark: SparkSession, folder: str, end: int, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens, finished) of every document in the token files, separators not counted."""
    seen = materialize(scan(spark, folder, end, kind, block), "separators")
    sums = stitched(seen.drop("inner", "head")).select("file", "block", "first", "carry", "final")
    joined = seen.join(sums, ["file", "block"])
    counts = F.concat(F.array(F.col("head") + F.col("carry")), F.col("inner").cast("array<bigint>"))
    inside = joined.where("found > 0").select("file", "first", F.posexplode(counts).alias("i", "n_tokens"))
    inside = inside.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("finished"))
    rest = F.when(F.col("found") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carry"))
    unfinished = joined.where("final").select(
        "file", (F.col("first") + F.col("found")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("finished")
    )
    return inside.unionByName(unfinished.where("n_tokens > 0"))


def flat_dir(spark: SparkSession) -> str:
    return fresh_dir(spark, "tokens")
