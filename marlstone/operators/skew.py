"""Hot keys: found by a pre-aggregated count, bounded in number, salted in joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 256
#: Below this many rows one task holds any key.
HOT_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS, rows: int | None = None) -> list:
    """Keys that hold at least a share of df's rows; at most 1/share values reach the driver.

    Where the number of rows is known and below ``least``, nothing is counted.
    """
    if rows is not None and rows < least:
        return []
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n")).limit(int(1 / share)).collect()
    if not top or top[0]["_n"] < least:
        return []
    total = df.count() if rows is None else rows
    return [r[key] for r in top if r["_n"] >= max(least, share * total)]


def salted(df: DataFrame, key: str, hot: list, salts: int, spread: Column) -> DataFrame:
    """Add ``_salt``: spread over ``salts`` values for hot keys, 0 for others."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    return df.withColumn("_salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))


def replicated(df: DataFrame, key: str, hot: list, salts: int) -> DataFrame:
    """The other side of a salted join: rows of hot keys once per salt."""
    if not hot:
        return df.withColumn("_salt", F.lit(0))
    every = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_salt", F.explode(every))
