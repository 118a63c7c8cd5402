"""Cleanup findings, scores and repository health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a rule at info, warn and error.
WEIGHTS = {
    "untracked": (20, 20, 20), "stale": (15, 25, 35), "large-file": (0, 10, 20), "generated": (15, 15, 15), "scratch": (20, 20, 20),
    "todo-only": (20, 20, 20), "log-dump": (10, 10, 10), "orphaned": (25, 25, 25), "duplicate": (20, 20, 20), "empty": (30, 30, 30),
}


def findings_score(findings: DataFrame) -> DataFrame:
    """Score of each path from (path, rule, severity 0..2), 100 at most; severities beyond count as the nearest, unknown rules as 0."""
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x]) for pair in WEIGHTS.items() for x in pair])
    level = F.least(F.greatest(F.col("severity"), F.lit(0)), F.lit(2))
    points = F.coalesce(F.get(table[F.col("rule")], level), F.lit(0))
    return findings.groupBy("path").agg(F.least(F.lit(100), F.sum(points)).cast("long").alias("score"), F.count(F.lit(1)).alias("findings"))


def health(plan: DataFrame) -> DataFrame:
    """Health 0..100 per repository from (repo, status, size_kb), in truncating integer arithmetic."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = plan.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), n("clean").alias("clean"), n("large_file").alias("large"), n("untrack").alias("untrack"), n("delete").alias("deletes"), n("broken_link").alias("broken"),
        F.coalesce(F.sum(F.when(F.col("status").isin("delete", "archive"), F.col("size_kb"))), F.lit(0)).alias("junk_kb"),
    )
    base = F.expr("((clean * 100) div files) * 40 div 100 + 60")
    loss = F.least(F.lit(40), 5 * F.col("broken") + 3 * F.col("large") + 2 * F.col("untrack") + F.col("deletes"))
    return sums.select("repo", "files", "clean", F.greatest(F.lit(0), base - loss - F.least(F.lit(20), F.expr("junk_kb div 51200"))).cast("long").alias("health"))


def completeness(files: DataFrame, expected: list[tuple[str, str, int]]) -> DataFrame:
    """(repo, missing, score): expected (name, base name pattern, points) that no file of a repository matches; 100 less their points, 0 at least."""
    spark = files.sparkSession
    repos = files.select("repo").distinct()
    rules = spark.createDataFrame(expected, "rule string, pattern string, points int")
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    options = F.array(*[F.when(base.rlike(p), F.lit(r)) for r, p, _ in expected])
    present = files.select("repo", F.explode(F.array_compact(options)).alias("rule")).distinct()
    missing = repos.crossJoin(F.broadcast(rules)).join(present, ["repo", "rule"], "left_anti")
    lost = missing.groupBy("repo").agg(F.count(F.lit(1)).alias("missing"), F.sum("points").alias("points"))
    return repos.join(lost, "repo", "left").select("repo", F.coalesce("missing", F.lit(0)).alias("missing"), F.greatest(F.lit(0), 100 - F.coalesce("points", F.lit(0))).cast("long").alias("score"))
