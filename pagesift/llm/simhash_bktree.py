"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit set if more than half of the 64-bit hashes of its word shingles have it. Fingerprints link at ``RADIUS`` or fewer differing
bits; a component is what links reach.

Distinct fingerprints are dealt to shards so that no link is lost: the bits are cut into ``blocks`` parts, and a shard holds those with equal
bits in all but ``RADIUS`` of the parts, for each such choice of parts. Two linked fingerprints agree on one choice at least. With more
fingerprints there are more parts, so that shards stay small. A shard is searched with a BK-tree, whose children are keyed
by their distance to the parent: from a node at distance d only edges from d - RADIUS to d + RADIUS are followed. Each fingerprint is looked up in the tree of
those before it, then added. A subtree whose members are all linked with each other is passed over once the fingerprint is linked with one of them,
so a dense group isn't compared pair by pair, and a shard returns a spanning forest of its links, not all of them.

A shard with more than ``SHARD`` fingerprints is cut into parts of that size, and each two parts make one unit of work: trees stay bounded, and no pair is
left out. Equal texts have equal fingerprints and meet as one. Null texts have no words and the fingerprint 0. A repeated id is one document for
``component_id``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagesift.llm.common import map_text, ship, text_of
from pagesift.llm.components import components
from pagesift.operators.skew import join_hot
from pagesift.session import materialize

WORDS = 3
SEED = 42
RADIUS = 3
#: fingerprints in one part of a shard
SHARD = 20_000
#: shards that are cut and may be broadcast (20 bytes each); more are joined by a shuffle
HOT_SHARDS = 1_000_000
#: fingerprints a shard may have on average before more bits are used to deal them
MEAN_SHARD = 256
#: bytes of a text that are split into words at a time, and hashes whose bits are counted at a time
BLOCK_BYTES, SLICE = 1 << 20, 1 << 16

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(body: bytes, most: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, in lists from about ``most`` bytes each."""
    at = 0
    while at < len(body):
        cut = _BLANK.search(body, at + most)
        end = cut.start() if cut else len(body)
        yield body[at:end].lower().split()
        at = end


def shingle_hashes(body: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; fewer words than a shingle has are one, no words none."""
    out, held = [], []
    for block in word_blocks(body):
        held += block
        if len(held) >= words:
            runs = map(b" ".join, zip(*(held[i:] for i in range(words))))
            out.append(np.fromiter(map(xxh64_intdigest, runs, repeat(seed)), np.uint64))
            del held[: len(held) - words + 1]
    if not out:
        return np.array([xxh64_intdigest(b" ".join(held), seed)] if held else [], np.uint64)
    return np.concatenate(out)


def prints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes; 0 for an empty one. Bits are counted in slices of ``SLICE`` hashes."""
    size = np.fromiter(map(len, hashes), np.int64, len(hashes))
    ends = np.cumsum(size)
    sums = np.zeros((len(hashes), 64), np.int64)
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    for at in range(0, len(flat), SLICE):
        part = flat[at : at + SLICE]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64)
        first, last = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
        owners = first + np.flatnonzero(size[first : last + 1])
        sums[owners] += np.add.reduceat(bits, np.maximum(ends[owners] - size[owners] - at, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * sums > size[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(bodies: list[bytes], words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    return prints_of([shingle_hashes(body, words) for body in bodies])


def linked(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints, by one BK-tree."""
    held: list[int] = []
    children: list[dict[int, int]] = []
    above: list[int] = []
    group: list[int] = []  # union-find over the nodes
    whole: list[int] = []  # a member of the one group that a subtree belongs to, or -1
    out = []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for value in values:
        me = new = len(held)
        group.append(new)
        todo = [0] if held else []
        while todo:
            node = todo.pop()
            if me != new and whole[node] >= 0 and root(whole[node]) == me:
                continue
            d = (value ^ held[node]).bit_count()
            if d <= radius and (other := root(node)) != me:
                out.append((value, held[node]))
                group[me] = me = other
            for distance, child in children[node].items():
                if -radius <= distance - d <= radius:
                    todo.append(child)
        node = 0
        while held and node != new:
            if whole[node] >= 0 and root(whole[node]) != me:
                whole[node] = -1
            up, node = node, children[node].setdefault((value ^ held[node]).bit_count(), new)
        above.append(up if held else 0)
        held.append(value)
        children.append({})
        whole.append(new)
        if len(held) & (len(held) - 1) == 0:  # groups may have met since a subtree got mixed
            whole = [root(i) for i in range(len(held))]
            for i in range(len(held) - 1, 0, -1):
                if whole[i] != root(above[i]):
                    whole[above[i]] = -1
    return out


def parts_of(blocks: int) -> list[int]:
    """Bit masks of the parts of a fingerprint."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def shard_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """For each choice of parts, the bits on which a shard's fingerprints agree."""
    blocks = radius + 1
    while blocks < 2 * radius and rows >> (64 * (blocks - radius) // blocks) > MEAN_SHARD:
        blocks += 1
    return [sum(chosen) for chosen in combinations(parts_of(blocks), blocks - radius)]


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def shard_links(prints: DataFrame, column: str, radius: int = RADIUS, shard: int = SHARD, rows: int | None = None) -> DataFrame:
    """(a, b): links between the distinct fingerprints in ``column`` that connect all that are within the radius."""
    ship(prints.sparkSession)
    masks = shard_masks(prints.count() if rows is None else rows, radius)
    keys = F.array(*[F.col(column).bitwiseAND(F.lit(_signed(m))) for m in masks])
    dealt = prints.select(F.col(column).alias("value"), F.posexplode(keys).alias("choice", "shared"))
    sizes = dealt.groupBy("choice", "shared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    large = materialize(sizes.select("choice", "shared", F.ceil(F.col("n") / shard).cast("int").alias("parts")), "large_shards")
    if large.count() <= HOT_SHARDS:
        large = F.broadcast(large)
    own = F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own"))
    pairs = F.transform(others, lambda x: F.least(x, "own") * F.col("parts") + F.greatest(x, "own"))
    units = (
        dealt.join(large, ["choice", "shared"], "left")
        .withColumn("own", own)
        .withColumn("unit", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs)))
        .select("choice", "shared", "unit", "value")
    )

    def run(batches):
        key, values = None, []

        def links(found):
            pairs = linked(found, radius) if len(found) > 1 else []
            a, b = (np.array([p[i] for p in pairs], np.uint64).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            numbers = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if start == end:
                    continue
                at = tuple(int(c[start]) for c in columns)
                if at != key:
                    if len(values) > 1:
                        yield links(values)
                    key, values = at, []
                values += numbers[start:end]
        if len(values) > 1:
            yield links(values)

    dealt_out = units.repartition("choice", "shared", "unit").sortWithinPartitions("choice", "shared", "unit", "value")
    return dealt_out.mapInArrow(run, "a long, b long")


def with_fingerprint(docs: DataFrame, keep: list[str], text: Column | None = None, words: int = WORDS) -> DataFrame:
    """``keep`` columns with ``print``, the fingerprint of the whole text as a signed 64-bit number."""
    return map_text(
        docs, keep, text_of() if text is None else text, lambda b: {"print": pa.array(fingerprints(b, words).view(np.int64))}, "print long"
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: Column | None = None, radius: int = RADIUS, shard: int = SHARD, words: int = WORDS
) -> DataFrame:
    """(doc_id, print, component_id) of every document; component_id is the smallest id in its component."""
    return near_prints(materialize(with_fingerprint(docs, [doc_id], text, words), "prints"), doc_id, radius, shard)


def near_prints(seen: DataFrame, doc_id: str, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(doc_id, print, component_id) of rows (doc_id, print)."""
    prints = materialize(seen.groupBy("print").agg(F.min(doc_id).alias("first")), "distinct_prints")
    links = shard_links(prints, "print", radius, shard)
    roots = materialize(components(links, "a", "b"), "roots")
    members = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    members = materialize(members, "members")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = materialize(join_hot(members, least, "root", "print").select("print", "component_id"), "components")
    return join_hot(seen, by_print, "print", doc_id).select(doc_id, "print", "component_id")
