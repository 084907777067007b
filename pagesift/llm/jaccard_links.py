"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of ``LEAST`` or more.

Candidates come together in two ways: by a five-word fingerprint within the radius of ``simhash_bktree``, and by MinHash: ``BANDS`` bands of ``ROWS`` minima, of
which a pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS, which at 0.8 is all but 5 in a million. Both are made in one pass over
the texts. Candidates are never listed as pairs: whatever they connect is one group, and in each group every pair is held against the limit by its exact sets, unless
the two are connected already. Rare shingles find the pairs: two such sets share one of the rarest fifth of either's shingles. Shingles are told apart by
64-bit hashes.

A group with more than ``PART_BYTES`` of text is cut into parts. First each part is decided alone, then the first text of everything that is connected by now stands for it, and these
are dealt into parts again, until a group's fit into one part or nothing more gets connected. Then the texts outside the largest connected set of a group meet all others of the
group, part by part. So a group of near copies, however large, is sent about once, no group has to fit in one task, and no pair is left out; only texts that
candidates connect without being similar meet in all pairs of parts.

Texts of up to five words are one shingle; texts without words are alike. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import ship, text_chunks, text_of
from pagesift.llm.components import components
from pagesift.llm.simhash_bktree import near_prints, prints_of, shingle_hashes
from pagesift.operators.skew import join_hot
from pagesift.session import materialize

WORDS = 5
#: least similarity, as a fraction
LEAST = (4, 5)
BANDS = 40
ROWS = 6
#: bytes of text in one part of a group
PART_BYTES = 1 << 20
#: common bands that a task remembers (about 150 bytes each)
COMMON_BANDS = 100_000
#: texts whose places in groups may be broadcast (about 40 bytes each); more are joined by a shuffle
BROADCAST_NODES = 1_000_000
#: kinds of ``features``
PRINT, SIZE, HEAD, LINK = range(4)

_draw = np.random.default_rng(11)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NO_WORDS = np.zeros(1, np.uint64)


def shingles(body: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, one at least."""
    found = shingle_hashes(body, words)
    return np.unique(found) if len(found) else _NO_WORDS


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS): one number for the minima of each band."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for i, (factor, added) in enumerate(zip(_FACTORS, _ADDED)):
        least = np.minimum.reduceat(flat * factor + added, starts)
        mixed = (out[:, i // ROWS] ^ least) * _MIX
        out[:, i // ROWS] = mixed ^ (mixed >> np.uint64(29))
    return out


def similar(sets: list[np.ndarray], labels: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with the least similarity or more; sets of one label are connected already."""
    up, over = LEAST
    sizes = [len(s) for s in sets]
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(counts), np.int64)
    order[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    shared = len(counts) - int(np.count_nonzero(counts > 1))  # numbers from here on stand in several sets
    ranks = [np.sort(r) for r in np.split(order[number], np.cumsum(sizes)[:-1])]
    first: dict[int, int] = {}
    group = [first.setdefault(label, i) for i, label in enumerate(range(len(sets)) if labels is None else labels)]
    holders: dict[int, list[int]] = {}
    whole: dict[int, int] = {}  # a member of the one group that all holders belong to, or -1
    out = []

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i, (mine, n) in enumerate(zip(ranks, sizes)):
        me, seen = root(i), set()
        prefix = [s for s in mine[: n + (-up * n) // over + 1].tolist() if s >= shared]
        for s in prefix:
            if s in holders and not (whole[s] >= 0 and root(whole[s]) == me):
                for j in holders[s]:
                    if j in seen or (other := root(j)) == me:
                        continue
                    seen.add(j)
                    m = sizes[j]
                    if over * min(n, m) < up * max(n, m):
                        continue
                    both = len(np.intersect1d(mine, ranks[j], assume_unique=True))
                    if over * both >= up * (n + m - both):
                        out.append((i, j))
                        group[me] = me = other
        for s in prefix:
            if s not in holders:
                whole[s] = i
            elif whole[s] >= 0 and root(whole[s]) != me:
                whole[s] = -1
            holders.setdefault(s, []).append(i)
    return out


def features(docs: DataFrame, node: str) -> DataFrame:
    """(kind, node, value) rows of every text: its fingerprint, its bytes, its bands, and (node, first) where a band was seen before in the same task.

    Bands are combined where they are made: of the texts of a chunk that share one, only the first is sent on, and a band that proved common is
    remembered, so that each task sends it about once.
    """
    ship(docs.sparkSession)
    narrow = docs.select(F.col(node).cast("long").alias("node"), text_of().cast("binary").alias("body"))

    def run(batches):
        common: dict[int, int] = {}
        for part in text_chunks(batches, "body"):
            nodes = part.column("node").to_numpy()
            bodies = part.column("body").to_pylist()
            hashes = [shingle_hashes(b, WORDS) for b in bodies]
            prints = prints_of(hashes).view(np.int64)
            flat = bands([np.unique(h) if len(h) else _NO_WORDS for h in hashes]).view(np.int64).reshape(-1)
            owner = np.repeat(nodes, BANDS)
            values, first, number, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            heads = owner[first]
            known = np.array([common.get(v, -1) for v in values.tolist()], np.int64) if common else np.full(len(values), -1, np.int64)
            fresh = known < 0
            for v, h in zip(values[fresh & (counts > 1)].tolist(), heads[fresh & (counts > 1)].tolist()):
                if len(common) < COMMON_BANDS:
                    common[v] = h
            to = np.where(fresh, heads, known)[number]
            links = np.unique(np.stack((owner[to != owner], to[to != owner]), axis=1), axis=0)
            sizes = pc.binary_length(part.column("body")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            kinds = np.repeat(np.array([PRINT, SIZE, HEAD, LINK], np.int8), [len(nodes), len(nodes), int(fresh.sum()), len(links)])
            columns = [
                kinds,
                np.concatenate((nodes, nodes, heads[fresh], links[:, 0])),
                np.concatenate((prints, sizes, values[fresh], links[:, 1])),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "node", "value"])
            pa.default_memory_pool().release_unused()

    return materialize(narrow.mapInArrow(run, "kind byte, node long, value long"), "features")


def candidates(seen: DataFrame) -> DataFrame:
    """(node, root): groups outside of which no text has a near copy."""
    prints = near_prints(seen.where(F.col("kind") == PRINT).select("node", F.col("value").alias("print")), "node")
    by_print = prints.select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    heads = seen.where(F.col("kind") == HEAD).select("node", F.col("value").alias("band"))
    by_band = heads.select(F.col("node").alias("a"), F.first("node").over(Window.partitionBy("band").orderBy("node")).alias("b"))
    local = seen.where(F.col("kind") == LINK).select(F.col("node").alias("a"), F.col("value").alias("b"))
    links = by_print.unionByName(by_band).unionByName(local).where("a <> b")
    found = components(links, "a", "b")
    return materialize(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "candidates")


def decided(docs: DataFrame, node: str, dealt: DataFrame) -> DataFrame:
    """(a, b): links of near copies within each unit of ``dealt`` (node, root, unit, label); what has one label is connected already.

    A text travels once per row of ``dealt``.
    """
    dealt = materialize(dealt.select(F.col("node").alias("_node"), "root", "unit", "label"), "dealt")
    if dealt.count() <= BROADCAST_NODES:
        dealt = F.broadcast(dealt)
    body = text_of().cast("binary")
    units = docs.select(F.col(node).cast("long").alias("node"), body.alias("body")).join(dealt, F.col("node") == F.col("_node"))

    def run(batches):
        key, nodes, labels, sets = None, [], [], []

        def links():
            found = [(nodes[i], nodes[j]) for i, j in similar(sets, labels)]
            a, b = (pa.array([p[i] for p in found], pa.int64()) for i in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            for root, unit, own, label, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, unit) != key:
                    if len(nodes) > 1:
                        yield links()
                    key, nodes, labels, sets = (root, unit), [], [], []
                nodes.append(own)
                labels.append(label)
                sets.append(shingles(body))
        if len(nodes) > 1:
            yield links()

    sent = units.select("root", "unit", "node", "label", "body").repartition("root", "unit").sortWithinPartitions("root", "unit", "node")
    return materialize(sent.mapInArrow(run, "a long, b long"), "similar")


def in_parts(members: DataFrame, part_bytes: int, turn: int) -> DataFrame:
    """``members`` (node, root, size, ...) with ``parts``, how many parts of their group make, and ``part``."""
    sizes = members.groupBy("root").agg(F.ceil(F.sum("size") / part_bytes).cast("int").alias("parts"))
    return join_hot(members, sizes, "root", "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int"))


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``label``, the smallest node that links connect each with."""
    found = components(links, "a", "b").withColumnRenamed("root", "label")
    return members.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_copies(docs: DataFrame, node: str = "node", part_bytes: int = PART_BYTES) -> DataFrame:
    """(node, root): the smallest node that each near copy is connected with; other nodes are left out. ``docs``: (node, text), ``node`` a unique number.

    ``docs`` is read several times, so its numbers have to be the same each time. How often doesn't depend on the number of turns: the texts that stand for
    others after the first are written, and later turns read these alone.
    """
    seen = features(docs, node)
    sizes = seen.where(F.col("kind") == SIZE).select("node", F.col("value").alias("size"))
    found = materialize(candidates(seen).join(sizes, "node").withColumn("label", F.col("node")), "sized")
    links, active, turn, cut, texts = None, found, 0, None, docs
    while True:
        dealt = materialize(in_parts(active, part_bytes, turn), "parts")
        own = decided(texts, node, dealt.withColumnRenamed("part", "unit"))
        links = own if links is None else links.unionByName(own)
        large = materialize(dealt.where("parts > 1").select("node", "root", "size"), "large_groups")
        cut = large.select("root").distinct() if cut is None else cut
        if large.isEmpty():
            break
        heads = materialize(labelled(large, links).where("node = label"), "heads")
        turn += 1
        left = heads.count()
        if left == large.count():
            break
        active = heads
        if texts is docs:
            few = heads.select(F.col("node").alias("_node"))
            few = F.broadcast(few) if left <= BROADCAST_NODES else few
            texts = materialize(docs.select(node, "text").join(few, F.col(node) == F.col("_node"), "left_semi"), "head_texts")
    if turn:
        links = links.unionByName(across(docs, node, labelled(join_hot(found, cut, "root", "node"), links), part_bytes))
    return components(links, "a", "b")


def across(docs: DataFrame, node: str, members: DataFrame, part_bytes: int) -> DataFrame:
    """(a, b): links between texts of different labels in groups that were cut; ``members`` (node, root, size, label).

    In each group, texts outside its largest label meet each other and those of that label. Nothing is to be done where one label holds all.
    """
    members = materialize(members, "labelled")
    totals = members.groupBy("root", "label").agg(F.sum("size").alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    sides = materialize(join_hot(members, totals, "root", "node").withColumn("rest", F.col("label") != F.col("most")), "sides")
    counts = sides.groupBy("root").agg(
        F.ceil(F.sum(F.when(F.col("rest"), F.col("size"))) / part_bytes).cast("int").alias("rests"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.when(~F.col("rest"), F.col("size"))) / part_bytes)).cast("int").alias("mosts"),
    )
    counts = materialize(counts.where("rests > 0"), "rests")
    dealt = join_hot(sides, counts, "root", "node")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mosts"))).cast("int")
    n = F.col("rests") + F.col("mosts")
    each = F.sequence(F.lit(0), n - 1)
    with_rest = F.transform(each, lambda x: F.least(x, F.col("own")).cast("long") * n + F.greatest(x, F.col("own")))
    with_most = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda x: x.cast("long") * n + F.col("own") + F.col("rests"))
    units = dealt.withColumn("own", own).withColumn("unit", F.explode(F.when(F.col("rest"), with_rest).otherwise(with_most)))
    return decided(docs, node, units)
