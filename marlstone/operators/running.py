"""Running sums over long ordered groups without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import materialize


def prefix_sums(df: DataFrame, group: str, order: str, sums: dict[str, str], slices: int = 64) -> DataFrame:
    """Add running sums (name -> column) of each group in the order of a unique column.

    Rows are range-partitioned by group and order, so a long group lies in
    many slices; each slice sums on its own, and the sums of the slices before
    it, one row per slice, are added.
    """
    cut = materialize(df.repartitionByRange(slices, group, order).withColumn("_slice", F.spark_partition_id()))
    totals = cut.groupBy(group, "_slice").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy(group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.withColumns({f"_r_{n}": F.sum(c).over(within) for n, c in sums.items()})
    return run.join(offsets, [group, "_slice"]).select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])
