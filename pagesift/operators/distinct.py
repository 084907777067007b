"""Distinct rows with an explicit order, since partitions have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import casefold_order


def distinct_keep_first(df: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    """Rows distinct by ``keys``; each keeps its smallest position. Repeats are merged map-side."""
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def sort_casefold(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*casefold_order(F.col(column)))


def deterministic_shuffle(df: DataFrame, column: str = "url", seed: int = 0) -> DataFrame:
    """A repeatable random order: neighbours no longer belong to one site."""
    return df.orderBy(F.xxhash64(F.col(column), F.lit(seed)), column)
