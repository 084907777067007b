"""Connected components of links between numbered nodes, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.operators.skew import join_hot
from pagesift.session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """For each node ``u`` of links (u, v): ``m``, the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach. Nodes without a link to another are left out.

    Alternates between two steps until nothing changes: every node links its larger neighbours to the least node it sees, then
    its smaller neighbours and itself. Links become stars around the least nodes in a number of rounds that grows with the logarithm of the
    longest chain. Minima are taken before the shuffle, and the joins salt nodes with very many links, so such a node is no hot group; each
    round is written as a table in the shared folder.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = materialize(pairs, "links"), None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sums
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = join_hot(both, _least(both), "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        larger = materialize(larger, "links")
        least = _least(larger)
        smaller = join_hot(larger, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(smaller.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
