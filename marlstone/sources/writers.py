"""Sinks: envelopes, ledgers, packed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.running import prefix_sums

SCHEMA = "marlstone/v1"


def envelope(df: DataFrame, kind: str) -> DataFrame:
    """One JSON text per row: schema name, kind and the row as data."""
    return df.select(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(kind).alias("kind"), F.struct(*df.columns).alias("data"))).alias("value"))


def append_ledger(df: DataFrame, folder: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(folder)


def observations(runs: DataFrame, since, limit: int = 0) -> DataFrame:
    """Runs from a time on, oldest first, as JSON texts."""
    kept = runs.filter(F.col("ts") >= since).orderBy("seq")
    return envelope(kept.limit(limit) if limit else kept, "observation")


def dictionary(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, shared): contents that cost less as a shared entry become references.

    A content is shared if references and its one entry take fewer bytes than
    its copies; entries are numbered by the first path that has them, in range slices.
    """
    hashed = files.select("path", "content", F.sha2("content", 256).alias("h"))
    size = F.octet_length(F.to_json(F.struct(F.col("content").alias("c")))) - 6
    groups = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.first("content").alias("content"))
    repeated = groups.filter("n > 1").withColumn("encoded", size).filter(F.col("n") * (F.lit(6) + 4) + F.col("encoded") + 1 < F.col("n") * (F.lit(10) + F.col("encoded")))
    numbered = prefix_sums(repeated.select(F.lit(0).alias("g"), "h", "first", "content", "n", F.lit(1).alias("one")), "g", "first", {"ref": "one"})
    shared = numbered.withColumn("ref", F.col("ref") - 1)
    out = hashed.join(shared.select("h", "ref"), "h", "left").select("path", F.when(F.col("ref").isNull(), F.col("content")).alias("content"), "ref")
    return out, shared.select("ref", "content", "n")
