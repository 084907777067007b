"""What the operators of this subpackage share: shipping code, text batches, exact ranks, tables between steps."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.session import shared_dir

#: bytes of text that a task turns over at a time
CHUNK_BYTES = 1 << 20
#: rows that are sent to a Python worker at a time, unless the session says otherwise; texts are long
BATCH_ROWS = 1_000
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: rows that are ranked together in one task
RANK_ROWS = 20_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; workers keep it, and so its caches, between tasks.

    A session that leaves the number of rows per batch at Spark's default gets ``BATCH_ROWS``.
    """
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="ship-")) / "pagesift_code.zip"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent).as_posix())
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_text(
    df: DataFrame, keep: list[str], text: str | Column, compute: Callable[[list], dict[str, pa.Array]], schema: str
) -> DataFrame:
    """``keep`` columns of ``df`` with what ``compute`` makes of the text, row by row, in slices of bounded size.

    ``text`` is a column or its name; one that is kept is sent once. Null counts as empty. ``compute`` gets a list of UTF-8 byte strings and returns equally long arrays. ``schema`` holds the added columns. If it also
    returns ``take``, numbers of rows, the other arrays are as long as that, and ``keep`` is repeated accordingly.
    """
    ship(df.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    body = names[keep.index(text)] if isinstance(text, str) and text in keep else "body"
    own = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    added = [(text_of(text) if isinstance(text, str) else text).cast("binary").alias("body")] if body == "body" else []
    narrow = df.select(*own, *added)
    kept = ", ".join(f"{n} {narrow.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        for part in text_chunks(batches, body):
            made = compute([t or b"" for t in part.column(body).cast(pa.binary()).to_pylist()])
            own = part.select(names)
            if "take" in made:
                own = own.take(made.pop("take"))
            yield pa.RecordBatch.from_arrays([*own.columns, *made.values()], names=[*names, *made])
            pa.default_memory_pool().release_unused()

    out = narrow.mapInArrow(run, ", ".join(filter(None, [kept, schema])))
    return out.withColumnsRenamed(dict(zip(names, keep)))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster."""
    path = f"{shared_dir(spark)}/pagesift/{name}-{uuid.uuid4().hex}"
    system, at = file_system(path)
    system.create_dir(at, recursive=True)
    return path


@contextmanager
def whole_file(folder: str, name: str):
    """A stream that becomes the file ``name`` of a shared folder once all is written; attempts of a task don't meet."""
    system, at = file_system(folder)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        yield out
    target = f"{at}/{name}"
    if system.get_file_info(target).type != fs.FileType.NotFound:  # of an attempt whose result was lost
        system.delete_file(target)
    system.move(own, target)


def drawn(df: DataFrame, doc_id: str, rows: int, order: list[str]) -> DataFrame:
    """At most ``rows`` rows of ``df``: those whose id has the smallest hash, sorted by it. ``order`` decides ties.

    Rows are thinned out by a second hash first, as their number allows, so that each task sorts and returns few.
    """
    total = df.count()
    if total > 2 * rows:
        sieve = F.pmod(F.xxhash64(doc_id, F.lit("sieve")), F.lit(1 << 40))
        df = df.where(sieve < int((1 << 40) * 1.5 * rows / total))
    return df.withColumn("draw", F.xxhash64(doc_id, F.lit("draw"))).orderBy("draw", *order).limit(rows).drop("draw")


def buckets_for(rows: int, each: int = RANK_ROWS) -> int:
    return max(1, -(-rows // each))


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, rows: int) -> DataFrame:
    """``df`` with the exact rank, from 0, of each row among those of equal ``keys``.

    The rows of one key are ranked in parts of about ``RANK_ROWS`` rows, dealt out by the hash of ``order``, and each part
    starts where the parts before it end; so no key is sorted in one task, whatever its share. ``rows``: of ``df``, about.
    """
    n = buckets_for(rows)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(n)))
    by = [*keys, "_part"]
    within = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    return (
        within.join(starts.drop("_n"), by).withColumn(rank, (F.col("_start") + F.col("_row")).cast("long")).drop("_part", "_row", "_start")
    )
