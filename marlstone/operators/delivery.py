"""Messages delivered more than once: exactly one row of each message stays.

Rows of one message are ranked by arrival time, ties by row id; the first
stays. The keeper of a message is a pre-aggregated minimum, so a message that
holds a large share of all rows never meets in one task, and the surplus rows
are those that don't match a keeper.

Defined cases: a row with a NULL or blank identifier belongs to no message and
is never surplus; two NULL (or unreadable) timestamps are equal; a NULL arrival
time ranks after all others; rows that repeat a row id exactly are surplus but
for one; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.identity import digest_key, instant


def message_columns(ids: list[str], timestamp: str) -> list[Column]:
    """The columns that make up a message's identity."""
    return [digest_key(F.col(c)).alias(f"_k{i}") for i, c in enumerate(ids)] + [F.unix_micros(instant(F.col(timestamp))).alias("_at")]


def _rows(df: DataFrame, ids: list[str], timestamp: str, row_id: str, arrival: str) -> DataFrame:
    rows = df.select(*message_columns(ids, timestamp), F.col(row_id).alias("_id"), F.unix_micros(F.col(arrival).cast("timestamp")).alias("_arrival"))
    for i in range(len(ids)):
        rows = rows.filter(F.col(f"_k{i}").isNotNull())
    return rows.withColumn("_order", F.struct(F.coalesce("_arrival", F.lit(2**63 - 1)).alias("a"), F.col("_id").alias("i")))


def keepers(df: DataFrame, ids: list[str], timestamp: str, row_id: str, arrival: str) -> DataFrame:
    """One row (keys, _order) per message: the first by arrival, then row id."""
    keys = [f"_k{i}" for i in range(len(ids))] + ["_at"]
    return _rows(df, ids, timestamp, row_id, arrival).groupBy(*keys).agg(F.min("_order").alias("_order"))


def surplus(df: DataFrame, ids: list[str], timestamp: str, row_id: str, arrival: str) -> DataFrame:
    """Row ids of all rows but the keeper of each message."""
    rows = _rows(df, ids, timestamp, row_id, arrival).select("_id")
    kept = keepers(df, ids, timestamp, row_id, arrival).select(F.col("_order.i").alias("_id"), F.lit(True).alias("_kept"))
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("_id"))
    marked = rows.join(kept, "_id", "left").withColumn("_nth", nth)
    return marked.filter(F.col("_kept").isNull() | (F.col("_nth") > 1)).select(F.col("_id").alias(row_id))


def kept_rows(df: DataFrame, ids: list[str], timestamp: str, row_id: str, arrival: str) -> DataFrame:
    """The rows that belong to no message, and one row of each message: its first by arrival, then row id.

    Of rows that repeat the keeper's id at the same time, one stays, by a hash of its columns. The whole row is
    taken along with the minimum, so a message of many rows is reduced before it is gathered.
    """
    keys = [f"_k{i}" for i in range(len(ids))] + ["_at"]
    when = F.coalesce(F.unix_micros(F.col(arrival).cast("timestamp")), F.lit(2**63 - 1))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), *message_columns(ids, timestamp), F.struct(when.alias("a"), F.col(row_id).alias("i"), F.xxhash64(*df.columns).alias("h")).alias("_order"))
    known = F.lit(True)
    for k in keys[:-1]:
        known = known & F.col(k).isNotNull()
    first = rows.filter(known).groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row"))
    return rows.filter(~known).select("_row.*").unionByName(first.select("_row.*"))


def admit(stored: DataFrame, batch: DataFrame, ids: list[str], timestamp: str, row_id: str, arrival: str) -> DataFrame:
    """Rows of a new batch to store: no surplus within it, and no message that is stored already.

    Rows that belong to no message are admitted. ``stored`` is the table as it
    is after earlier calls; the join drops messages by their identifiers, null-safe on the timestamp.
    """
    keys = [f"_k{i}" for i in range(len(ids))] + ["_at"]
    fresh = kept_rows(batch, ids, timestamp, row_id, arrival).select("*", *message_columns(ids, timestamp))
    known = stored.select(*message_columns(ids, timestamp)).distinct()
    same = [F.col(f"b.{k}") == F.col(f"s.{k}") for k in keys[:-1]] + [F.col("b._at").eqNullSafe(F.col("s._at"))]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return fresh.alias("b").join(known.alias("s"), cond, "left_anti").drop(*keys)
