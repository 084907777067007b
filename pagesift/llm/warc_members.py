"""WARC archives: written as monolithic gzip files, normalised to one gzip member per record, read back by a sidecar index.

``write_archives`` writes a record per page into files that are one gzip stream each, as some crawlers do; such a file can only be read from its
start. ``normalise`` inflates every such stream once, block by block, writes each record as a member of its own into a new file, and beside that file
an index with a line per record: offset, length, type, record id. ``read_records`` seeks by the index and inflates single members. Files are written under
another name first and then renamed, so a repeated task leaves no half file; it replaces what an earlier attempt had finished.

A page without an id gets a record id made of its archive and place, and is read back without one. Of records with equal payloads the one with the largest page_id is a response with the payload; the others are revisits that
refer to it and hold the HTTP header only. Payloads are told apart by SHA-256 and length. A null html is an empty payload; a null url leaves out the
target field, line breaks in a url are percent-encoded. Rows with the same page_id and html are all responses or all revisits, and so are pages with equal payloads of which none has an id. An empty table gives no files and an empty
result. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import file_system, ship, text_chunks, text_of, whole_file
from pagesift.operators.skew import join_hot
from pagesift.session import materialize

#: uncompressed bytes after which the next archive is begun
ARCHIVE_BYTES = 16 << 20
#: groups of equal payloads that may be broadcast (about 60 bytes each); more are joined by a shuffle in which
#: a payload with more pages than ``SALT_PAGES`` is split
BROADCAST_GROUPS = 200_000
SALT_PAGES = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 20


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "") -> bytes:
    """A response with its payload, or a revisit of the response ``refers_to``; ``place`` names a record without a page_id."""
    own = f"urn:page:{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, place).urn
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{own}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url and url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": refers_to is not None and PROFILE,
        "WARC-Refers-To": refers_to is not None and f"<urn:page:{refers_to}>",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def inflated(file) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in blocks."""
    member = zlib.decompressobj(31)
    fresh = True
    while data := file.read(_READ):
        while data:
            out = member.decompress(data)
            fresh = False
            if out:
                yield out
            data = member.unused_data
            if member.eof:
                member, fresh = zlib.decompressobj(31), True
    if not fresh:
        raise EOFError("the gzip stream ends within a member")


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with the empty lines that end them."""
    held = bytearray()
    for block in blocks:
        held += block
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            size = end + 8 + int(fields_of(bytes(held[at:end]))["content-length"])
            if len(held) < size:
                break
            yield bytes(held[at:size])
            at = size
        del held[:at]
    if held:
        raise EOFError("the archive ends within a record")


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(uri: str | None) -> int | None:
    return int(uri.strip("<>").removeprefix("urn:page:")) if uri and uri.startswith("<urn:page:") else None


def parsed(data: bytes) -> dict:
    """What a record says: ids, type, size and digest of the full payload, and the payload that it holds (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, _, body = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": _number(fields["warc-record-id"]),
        "record_type": fields["warc-type"],
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload_bytes": int(fields_of(http)["content-length"]) if revisit else len(body),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(body).digest()).decode(),
        "payload": None if revisit else body,
    }


def assigned(pages: DataFrame, broadcast_groups: int = BROADCAST_GROUPS, salt_pages: int = SALT_PAGES) -> DataFrame:
    """(page_id, url, body, refers_to): which response each page with a copied payload refers to."""
    body = text_of("html").cast("binary")
    keyed = pages.select(F.col("page_id").cast("long"), "url", body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"), F.length(body).alias("size"))
    keyed = keyed.withColumn("payload", F.struct("sha", "size")).drop("sha", "size")
    groups = keyed.groupBy("payload").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null")
    groups = materialize(groups.drop("n"), "payloads")
    if groups.count() <= broadcast_groups:
        joined = keyed.join(F.broadcast(groups), "payload", "left")
    else:
        joined = join_hot(keyed.withColumn("row", F.monotonically_increasing_id()), groups, "payload", "row", "left", salt_pages)
    other = F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response"))
    return joined.select("page_id", "url", "body", other.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic archives into ``folder``; (archive, records) of each."""
    ship(pages.sparkSession)

    def run(batches):
        rows = (
            row
            for part in text_chunks(batches, "body")
            for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "body", "refers_to")))
        )
        row, number = next(rows, None), 0
        while row is not None:
            name, size, count = f"part-{TaskContext.get().partitionId():06d}-{number:05d}.warc.gz", 0, 0
            with whole_file(folder, name) as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as stream:
                while row is not None and size < archive_bytes:
                    page_id, url, body, refers_to = row
                    size += stream.write(record(page_id, url, body, refers_to, f"{folder}/{name}/{count}"))
                    count += 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "records"])
            number += 1

    return materialize(assigned(pages).mapInArrow(run, "archive string, records long"), "archives")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite ``archives`` of the folder ``source`` in ``target``, a member per record; the index rows (archive, offset, length, record_type, record_id).

    The same rows stand in the file ``<archive>.idx`` beside each archive, tab-separated.
    """
    spark = archives.sparkSession
    ship(spark)

    def run(batches):
        from_system, from_at = file_system(source)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, offset, lines = [], 0, io.StringIO()
                with from_system.open_input_stream(f"{from_at}/{name}", compression=None) as file, whole_file(target, name) as out:
                    for data in records(inflated(file)):
                        member = gzip.compress(data, 6, mtime=0)
                        out.write(member)
                        fields = fields_of(data[: data.index(b"\r\n\r\n")])
                        row = (offset, len(member), fields["warc-type"], fields["warc-record-id"])
                        rows.append(row)
                        lines.write("\t".join(map(str, row)) + "\n")
                        offset += len(member)
                with whole_file(target, name + ".idx") as out:
                    out.write(lines.getvalue().encode())
                columns = [pa.array(list(x)) for x in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows)), *columns], names=["archive", "offset", "length", "record_type", "record_id"]
                )

    tasks = max(1, archives.count())
    dealt = archives.select("archive").repartition(tasks, "archive")
    return materialize(dealt.mapInArrow(run, "archive string, offset long, length long, record_type string, record_id string"), "warc_index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder as rows."""
    rows = spark.read.schema("offset long, length long, record_type string, record_id string").option("sep", "\t").csv(f"{folder}/*.idx")
    return rows.withColumn("archive", F.regexp_extract(F.input_file_name(), r"([^/]+)\.idx$", 1))


def read_records(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Every record of the index, read from its member alone; ``payload`` adds what responses hold."""
    ship(index.sparkSession)
    kinds = {
        "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
    }
    if payload:
        kinds["payload"] = pa.binary()

    def run(batches):
        system, at = file_system(folder)
        file, opened = None, None
        for batch in batches:
            found, held = [], 0
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if name != opened:
                    if file:
                        file.close()
                    file, opened = system.open_input_file(f"{at}/{name}"), name
                found.append(parsed(gzip.decompress(file.read_at(length, offset))))
                held += len(found[-1]["payload"] or b"")
                if held > ARCHIVE_BYTES:
                    yield batch_of(found)
                    found, held = [], 0
            yield batch_of(found)
        if file:
            file.close()

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in kinds.items()], names=list(kinds))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return index.select("archive", "offset", "length").mapInArrow(run, schema)
