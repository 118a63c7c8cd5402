"""Cross-cutting result contract: bounded results that disclose their bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_top(df: DataFrame, top: int, order: list[Column]) -> DataFrame:
    """Order df by a total order and keep top rows; 0 keeps all, negative is an error."""
    if top < 0:
        raise ValueError("top must not be negative")
    ordered = df.orderBy(*order)
    return ordered.limit(top) if top else ordered


def truncation(df: DataFrame, field: str, shown: int, reason: str) -> DataFrame:
    """One row (field, shown, total, reason) for a result cut to shown rows."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(field).alias("field"), F.least(F.lit(shown).cast("long"), "total").alias("shown"), "total", F.lit(reason).alias("reason")
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Keep k rows per group and add the group's size as ``group_total``."""
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("group_total"))
    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")  # limited before the shuffle
    return first.join(totals, group)
