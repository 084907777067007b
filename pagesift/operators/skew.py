"""Join of many rows per key with few rows per key, when some keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of one key that stay together
SALT_ROWS = 500_000

#: Only the largest keys are salted, so that their list may be broadcast whatever the size of the
#: data. Any other key then has less than one of HOT_KEYS rows.
HOT_KEYS = 20_000


def hot_keys(df: DataFrame, key: str, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(key, salts): the keys with more than ``salt_rows`` rows and the groups to cut them into."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > salt_rows)
    largest = counts.orderBy(F.desc("n"), key).limit(HOT_KEYS)
    return largest.select(key, F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))


def join_hot(
    many: DataFrame, few: DataFrame, key: str, salt_by: str, how: str = "inner", salt_rows: int = SALT_ROWS
) -> DataFrame:
    """``many`` joined with ``few`` on ``key``, where one key may hold a third of ``many``.

    The rows of a hot key are spread over groups by the hash of ``salt_by``, as many as its size
    asks for, and the matching rows of ``few`` are repeated once per group. All other keys are
    joined as they are.
    """
    if how not in ("inner", "left"):
        raise ValueError("the salted side is kept: inner or left join only")
    hot = F.broadcast(hot_keys(many, key, salt_rows))
    salts = F.coalesce("salts", F.lit(1))
    spread = many.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(salt_by), salts).cast("int"))
    repeated = few.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.drop("salts").join(repeated.drop("salts"), [key, "salt"], how).drop("salt")
