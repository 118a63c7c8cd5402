"""Snapshot views of the stored tables: files, source lines, declarations, calls, commits and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths, text
from marlstone.session import load


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured files: path, language of the path, size, generated flag, class, content."""
    raw = load(spark, sf_dir, "source_files").select("file_id", "repo", "path", "size", "content")
    return (
        raw.withColumn("language", paths.language(F.col("path")))
        .withColumn("generated", paths.generated(F.col("path")))
        .withColumn("class", paths.file_class(F.col("path"), F.col("language"), F.col("generated")))
    )


def source_lines(files_: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Lines of each file: path, number from 1, raw and trimmed text; all of them unless ``max_lines`` is given."""
    split = files_.select("path", "repo", "language", "class", F.posexplode(F.split("content", "\n")).alias("pos", "raw"))
    if max_lines is not None:
        split = split.filter(F.col("pos") < max_lines)
    return split.select("path", "repo", "language", "class", (F.col("pos") + 1).alias("number"), "raw", text.trimmed(F.col("raw")).alias("text"))


def commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(commits, commit files): orders as commits, their parts as touched paths, quantities as churn."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("subject"))
    touched = (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("churn"))
    )
    return orders, touched


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history: events in their order as runs."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("repo"),
        F.col("event_type").alias("outcome"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("net_reduction"),
    )
