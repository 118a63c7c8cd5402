"""Commit history: churn, hotspots, co-change, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def churn(commits: DataFrame, touched: DataFrame, since: Column | None = None, fix: str = r"(?i)\bfix(?:es|ed)?\b") -> DataFrame:
    """Commits and fix touches per path; commits without a time always count."""
    kept = commits if since is None else commits.filter(F.col("ts").isNull() | (F.col("ts") >= since))
    joined = touched.join(kept.select("hash", F.col("subject").rlike(fix).alias("fixing")), "hash")
    return joined.groupBy("path").agg(F.count_distinct("hash").alias("commits"), F.count_if(F.col("fixing")).alias("fix_touches"))


def hotspots(commits: DataFrame, touched: DataFrame) -> DataFrame:
    """Churn, touches and last touch per path."""
    return touched.join(commits.select("hash", "ts"), "hash").groupBy("path").agg(F.sum("churn").alias("churn"), F.count(F.lit(1)).alias("touches"), F.max("ts").alias("last"))


def couplings(touched: DataFrame, most_files: int = 20, least_commits: int = 3, least_confidence: float = 0.5, partners: int = 4) -> DataFrame:
    """(path, partner, commits, confidence): the files most often changed together.

    Commits that touch more than ``most_files`` files are left out by rule, so
    the pairs of a commit are bounded by that number, not by the data.
    """
    sizes = touched.groupBy("hash").agg(F.count_distinct("path").alias("n")).filter(F.col("n") <= most_files).select("hash")
    scoped = touched.select("hash", "path").distinct().join(sizes, "hash", "left_semi")
    touches = scoped.groupBy("path").agg(F.count(F.lit(1)).alias("touches"))
    together = scoped.groupBy("hash").agg(F.collect_list("path").alias("paths"))
    pairs = together.select(F.explode("paths").alias("path"), "paths").select("path", F.explode("paths").alias("partner")).filter("path <> partner")
    counted = pairs.groupBy("path", "partner").agg(F.count(F.lit(1)).alias("commits")).filter(F.col("commits") >= least_commits)
    rated = counted.join(touches, "path").withColumn("confidence", F.col("commits") / F.col("touches")).filter(F.col("confidence") >= least_confidence)
    order = Window.partitionBy("path").orderBy(F.desc("commits"), "partner")
    return rated.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= partners).select("path", "partner", "commits", "confidence")


def staleness(last: DataFrame, now: Column) -> DataFrame:
    """Severity of the days since a path's last touch: over 90 info, over 180 warn, over 365 error."""
    days = F.datediff(now, F.col("last"))
    return last.select("path", days.alias("days"), F.when(days > 365, "error").when(days > 180, "warn").when(days > 90, "info").otherwise("fresh").alias("severity"))
