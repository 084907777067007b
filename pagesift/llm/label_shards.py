"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards, sizes stay even.

Links are given as memberships (doc, key): documents with a key in common are neighbours. They are never listed as pairs: what a document's neighbours
hold is the count per (key, shard), at most one row per key and shard. The law is ``rows``: shards differ by one document at most.

Documents start in a shard by their rank in hash order, so sizes are even from the start, and every move keeps them: in each round each document
finds the shard in which most of its neighbours are, among those that are open; and the documents that would gain by going
from shard i to shard j are exchanged with as many that go from j to i. First come those that gain themselves, in pairs of shards and then around longer
cycles of them, then documents without any link, for which all shards are alike. How many may go each way follows from a
table of shards times shards, the only thing the driver sees. Where more want to go than may, those that gain most go first, by exact ranks that are taken in
parts. Shards are open at first if they hold documents without links, and, once that lowers the cut no further, also if some of their documents would gain
elsewhere; so tables without unlinked documents are placed too. Each of the two ends when nothing moves any more or the cut no longer falls, however many rounds that takes. Each round is a table in the shared folder.

Documents are told apart by a number of their own, so repeated rows are placed each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import ranked
from pagesift.operators.skew import join_hot
from pagesift.session import materialize


def start(docs: DataFrame, doc: str, shards: int, rows: int) -> DataFrame:
    """(doc, shard): every document in a shard by its rank in hash order."""
    mixed = docs.select(doc).withColumn("_all", F.lit(0)).withColumn("_hash", F.xxhash64(F.lit("start"), doc))
    return ranked(mixed, ["_all"], ["_hash", doc], "_rank", rows).select(doc, (F.col("_rank") % shards).cast("int").alias("shard"))


def _counts(members: DataFrame) -> DataFrame:
    """(key, array of (shard, members)) from (doc, key, shard); at most one entry per shard."""
    seen = members.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("held"))


def cut_links(held: DataFrame) -> int:
    """Pairs of neighbours, over all keys, whose shards differ."""
    total = F.aggregate("held", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x["n"]).cast("decimal(38,0)"))
    inside = F.aggregate("held", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x["n"].cast("decimal(18,0)") * x["n"]).cast("decimal(38,0)"))
    row = held.agg(F.sum(total * total - inside).alias("cut")).first()
    return int(row["cut"] or 0) // 2


def sights(members: DataFrame, held: DataFrame) -> DataFrame:
    """(doc, shard, at, n, least): how many of its kind a document sees in each shard, itself included, and its least key."""
    near = join_hot(members, held, "key", "doc").select("doc", "shard", "key", F.explode("held").alias("h"))
    return near.groupBy("doc", "shard", F.col("h.shard").alias("at")).agg(F.sum("h.n").alias("n"), F.min("key").alias("least"))


def wishes(seen: DataFrame, open_shards: list[int], turn: int = 0) -> DataFrame:
    """(doc, shard, target, gain) of the documents that see more of their kind in another, open shard.

    A document counts itself where it is. So of two shards with equally many, all who share a key see the same two, and
    agree on the one that a hash of their least key and the round prefers; otherwise they would change places for ever.
    """
    sums = seen.where((F.col("at") == F.col("shard")) | F.col("at").isin(open_shards))
    best = F.max(F.struct("n", F.xxhash64("least", "at", F.lit(turn)).alias("taste"), "at")).alias("best")
    found = sums.groupBy("doc", "shard").agg(best, F.max(F.when(F.col("at") == F.col("shard"), F.col("n"))).alias("here"))
    found = found.select("doc", "shard", F.col("best.at").alias("target"), (F.col("best.n") - F.col("here")).alias("gain"))
    return found.where("target <> shard")


def _cycle(left: dict[tuple[int, int], int], start: int) -> list[tuple[int, int]]:
    """The shortest cycle of ways with movers left through ``start``; empty if there is none."""
    came, todo = {}, [start]
    for at in todo:
        for (i, j), n in left.items():
            if i == at and n and j not in came:
                came[j] = at
                todo.append(j)
    way, at = [], start
    while at in came and (not way or at != start):
        way.append((came[at], at))
        at = came[at]
    return way if start in came else []


def around(left: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """How many more may go each way around cycles of shards; taken from ``left``."""
    more = {}
    for start in range(shards):
        while way := _cycle(left, start):
            n = min(left[w] for w in way)
            for w in way:
                left[w] -= n
                more[w] = more.get(w, 0) + n
    return more


def exchanges(wanted: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict, dict]:
    """How many go from i to j, of those that gain and of those without links; as many enter each shard as leave it."""
    few = {(i, j): min(n, wanted.get((j, i), 0)) for (i, j), n in wanted.items()}
    more = around({way: n - few[way] for way, n in wanted.items()}, shards)
    left = dict(free)
    movers, fillers = {}, {}
    for i in range(shards):
        for j in range(i + 1, shards):
            there, back = (wanted.get(way, 0) - more.get(way, 0) for way in ((i, j), (j, i)))
            (extra, a, b) = (there - back, i, j) if there >= back else (back - there, j, i)
            extra = min(extra, left.get(b, 0))
            left[b] = left.get(b, 0) - extra
            movers[a, b], movers[b, a], fillers[b, a] = min(there, back) + extra + more.get((a, b), 0), min(there, back) + more.get((b, a), 0), extra
    return movers, fillers


def _tally(df: DataFrame, *by: str) -> dict:
    """Rows per combination of shards (and gains); as many entries as there are such combinations."""
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r[0] if len(by) == 1 else tuple(r)[:-1]: r["n"] for r in rows}


def propagate(docs: DataFrame, doc: str, links: DataFrame, shards: int) -> DataFrame:
    """(doc, shard) of every document. ``links``: (doc, key), keys of at least two documents, each pair once; ``doc`` is unique."""
    spark = docs.sparkSession
    rows = docs.count()
    linked = links.select(F.col(doc).alias("doc"), "key")
    held_by = linked.select("doc").distinct().withColumn("linked", F.lit(True))
    placed = start(docs, doc, shards, rows).withColumnRenamed(doc, "doc").join(held_by, "doc", "left")
    placed = materialize(placed.select("doc", "shard", F.coalesce("linked", F.lit(False)).alias("linked")), "shards")
    free = _tally(placed.where("not linked"), "shard")
    best, least, any_shard, turn = placed, None, not free, 0
    while True:
        members = materialize(linked.join(placed.where("linked").select("doc", "shard"), "doc"), "members")
        held = materialize(_counts(members), "held")
        cut = cut_links(held)
        stuck = least is not None and cut >= least
        if not stuck:
            best, least = placed, cut
        if stuck:
            if any_shard:
                break
            any_shard, placed, least = True, best, None
            continue
        turn += 1
        free = _tally(placed.where("not linked"), "shard")
        seen = materialize(sights(members, held), "sights")
        opened = set(free)
        if any_shard:
            opened |= set(_tally(wishes(seen, list(range(shards)), turn), "shard"))
        wish = materialize(wishes(seen, sorted(opened), turn), "wishes")
        movers, fillers = exchanges(_tally(wish, "shard", "target"), free, shards)
        if not any(movers.values()):
            if any_shard:
                break
            any_shard, placed, least = True, best, None
            continue
        ahead = before_gain([(*way, n) for way, n in _tally(wish, "shard", "target", "gain").items()])
        most = [(i, j, gain, max(0, movers[i, j] - before)) for i, j, gain, before in ahead]
        limit = F.broadcast(spark.createDataFrame(most, "shard int, target int, gain long, most long"))
        order = ranked(wish, ["shard", "target", "gain"], ["doc"], "within", rows)
        moved = order.join(limit, ["shard", "target", "gain"]).where("within < most").select("doc", F.col("target").alias("moved"))
        filling = [(i, j, n) for (i, j), n in fillers.items() if n]
        if filling:
            moved = moved.unionByName(fill(placed, filling, rows))
        placed = materialize(
            placed.join(moved, "doc", "left").select("doc", F.coalesce("moved", "shard").alias("shard"), "linked"), "shards"
        )
    return best.select(F.col("doc").alias(doc), "shard")


def before_gain(counts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(shard, target, gain, how many of the same way gain more)."""
    out, total = [], {}
    for shard, target, gain, n in sorted(counts, key=lambda r: -r[2]):
        out.append((shard, target, gain, total.get((shard, target), 0)))
        total[shard, target] = total.get((shard, target), 0) + n
    return out


def fill(placed: DataFrame, filling: list[tuple[int, int, int]], rows: int) -> DataFrame:
    """(doc, moved): documents without links, as many for each way as asked for."""
    spans, used = [], {}
    for i, j, n in filling:
        spans.append((i, j, used.get(i, 0), used.get(i, 0) + n))
        used[i] = used.get(i, 0) + n
    ways = F.broadcast(placed.sparkSession.createDataFrame(spans, "shard int, moved int, low long, high long"))
    free = ranked(placed.where("not linked").select("doc", "shard"), ["shard"], ["doc"], "rank", rows)
    return free.join(ways, "shard").where("rank >= low and rank < high").select("doc", "moved")


def equal_links(keyed: DataFrame, doc: str, key: str) -> DataFrame:
    """(doc, key) of the documents whose key another one has too."""
    shared = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("key"))
    return join_hot(keyed.select(doc, F.col(key).alias("key")), shared, "key", doc)


def slots(placed: DataFrame, doc: str, rows: int) -> DataFrame:
    """``placed`` with ``slot``, numbered from 0 in each shard without gaps."""
    return ranked(placed, ["shard"], [doc], "slot", rows)
