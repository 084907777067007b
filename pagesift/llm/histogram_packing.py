"""Packing by the histogram of lengths: shortest pack first.

Documents are tokenized, ended by a separator, and cut into pieces of at most one sequence. Only the histogram of the pieces' lengths goes to
the driver: as many rows as a sequence has tokens, whatever the size of the table. There, lengths are placed longest first. Pieces of one
length go into the shortest open packs with room for them, which turns (part of) a pattern with its count into a
longer pattern; what finds no room opens packs of its own. Each step either uses up a pattern, which gets replaced, or uses up a length, so
there are at most three patterns more per length. A pattern's count says how many pieces of each of its lengths it takes; pieces are numbered within
their length, and the range that a number falls into gives its sequence and offset.

Null and empty texts are one piece with the separator alone. Equal rows are packed each. Columns other than those named are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.byte_bpe import Specials, byte_bpe
from pagesift.llm.common import map_text, ranked
from pagesift.session import materialize

SIZE = 1024
SEPARATOR = 0


def cut(bodies: list[bytes], path: str, pattern: str, size: int, separator: int, specials: Specials = ()) -> dict[str, pa.Array]:
    """Pieces of all texts: which text, where in it, its ids as unsigned 32-bit little-endian numbers."""
    encoder = byte_bpe(path, pattern, specials)
    take, start, length, total, ids = [], [], [], [], []
    for i, body in enumerate(bodies):
        own = np.append(encoder.ids(body), np.uint32(separator)).astype("<u4")
        for at in range(0, len(own), size):
            piece = own[at : at + size]
            take.append(i)
            start.append(at)
            length.append(len(piece))
            total.append(len(own))
            ids.append(piece.tobytes())
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return {
        name: pa.array(values, kind)
        for name, values, kind in zip(("take", "start", "length", "doc_tokens", "ids"), (take, start, length, total, ids), kinds)
    }


def pieces(
    docs: DataFrame, keep: list[str], path: str, pattern: str, text: str = "text", size: int = SIZE, separator: int = SEPARATOR, specials: Specials = ()
) -> DataFrame:
    """A table in the shared folder with a row per piece: ``keep``, piece, start, length, doc_tokens, ids, ids_crc32."""
    made = map_text(
        docs,
        keep,
        text,
        lambda bodies: cut(bodies, path, pattern, size, separator, specials),
        "start long, length long, doc_tokens long, ids binary",
    )
    numbered = made.withColumn("piece", F.monotonically_increasing_id()).withColumn("ids_crc32", F.crc32("ids"))
    return materialize(numbered, "pieces")


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, packs of that kind) that hold all pieces of the histogram."""
    packs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in range(size, length - 1, -1):
            # a pack that gets longer has less room, so it is met again further down if it can take one more
            while left and packs[room]:
                pattern, count = packs[room].pop()
                used = min(left, count)
                if used < count:
                    packs[room].append((pattern, count - used))
                packs[room - length].append(((*pattern, length), used))
                left -= used
        if left:
            # as many pieces of this length as fit share a new pack
            fit = size // length
            for many, count in ((fit, left // fit), (left % fit, 1)):
                if many and count:
                    packs[size - many * length].append(((length,) * many, count))
    return [p for room in sorted(packs) for p in packs[room]]


def ranges(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset) of every place in every pattern."""
    out, used, sequence = [], defaultdict(int), 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out


def place(spark: SparkSession, cut_pieces: DataFrame, keep: list[str], size: int = SIZE) -> DataFrame:
    """``keep`` columns of the pieces with piece, length, sequence_id and offset; every piece once."""
    counted = cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = {r["length"]: r["n"] for r in counted}
    schema = "length long, low long, high long, first_sequence long, offset long"
    places = F.broadcast(spark.createDataFrame(ranges(patterns(histogram, size)), schema))
    narrow = cut_pieces.select("piece", "length", *[c for c in keep if c not in ("piece", "length")])
    numbered = ranked(narrow, ["length"], ["piece"], "rank", sum(histogram.values()))
    joined = numbered.join(places, "length").where("rank >= low and rank < high")
    return joined.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("low")).select(
        "piece", "length", *[c for c in keep if c not in ("piece", "length")], "sequence_id", "offset"
    )


def sequences(cut_pieces: DataFrame, placed: DataFrame, size: int = SIZE, pad: int = SEPARATOR) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence, padded to ``size`` unless their number is a power of two."""
    joined = cut_pieces.select("piece", "ids").join(placed.select("piece", "sequence_id", "offset", "length"), "piece")
    whole = joined.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    ids = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    even = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    filling = F.repeat(F.hex(F.lit(pad.to_bytes(4, "little"))), (size - F.col("length")).cast("int"))
    return whole.select("sequence_id", "length", F.when(even, ids).otherwise(F.concat(ids, F.unhex(filling))).alias("ids"))
