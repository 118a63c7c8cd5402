"""Read queues: composition, order, selection, culling, identities, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import paths

MOST_ROWS = 100


def compose(signals: DataFrame) -> DataFrame:
    """One candidate per path from (path, points, churn, reason): summed points, highest churn, distinct reasons."""
    return signals.groupBy("path").agg(F.sum("points").cast("long").alias("score"), F.max("churn").alias("churn"), F.array_sort(F.collect_set("reason")).alias("why"))


def read_queue(candidates: DataFrame, top: int = MOST_ROWS) -> DataFrame:
    """Ranks 1.. of the candidates by score, churn and path; at most a hundred rows."""
    limit = MOST_ROWS if top <= 0 else min(top, MOST_ROWS)
    first = candidates.orderBy(F.desc("score"), F.desc("churn"), "path").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("churn"), "path")))


def cull_lane(path, score, reasons):
    """Lane of a queue row: generated, test and docs paths first, then strength of the evidence."""
    lower = F.lower(path)
    segments = F.split(lower, "/")

    def has(*names: str):
        return F.arrays_overlap(segments, F.array(*[F.lit(n) for n in names]))

    generated = lower.rlike(r"(?:\.gen\.go|_generated\.go|\.pb\.go|\.min\.js|\.min\.css)$") | has("generated", "dist", "vendor", "node_modules")
    test = lower.rlike(r"_test\.[a-z]+$|\.(?:test|spec)\.[a-z]+$") | has("test", "tests", "testdata", "fixtures")
    docs = lower.rlike(r"\.(?:md|rst|txt)$") | has("docs")
    return (
        F.when(generated, "generated").when(test, "test").when(docs, "docs").when((score >= 20) & (reasons >= 2), "kept").when(score >= 8, "alternate").otherwise("low-signal")
    )


def selection(queue: DataFrame, include: list[str], exclude: list[str], top: int) -> DataFrame:
    """Decision of every row: filtered with the first reason, selected up to ``top`` in rank order, else deprioritized."""
    reason = F.when(paths.glob_match(F.col("path"), exclude), "excluded").when(~paths.glob_match(F.col("path"), include), "not-included")
    marked = queue.withColumn("reason", reason)
    nth = F.sum(F.col("reason").isNull().cast("int")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    decision = F.when(F.col("reason").isNotNull(), "filtered").when(nth <= top, "selected").otherwise("deprioritized")
    return marked.select("rank", "path", decision.alias("decision"), "reason")


def evidence_identity(path, why):
    """Content hash of a row's canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(path.alias("path"), why.alias("why"))), 256))


def receipt_gaps(selected: DataFrame, executed: DataFrame) -> DataFrame:
    """(id, gap): selected rows without a receipt and receipts without a selected row."""
    a = selected.select("id").distinct().withColumn("s", F.lit(True))
    b = executed.select("id").distinct().withColumn("e", F.lit(True))
    return a.join(b, "id", "full_outer").filter("s is null or e is null").select("id", F.when(F.col("s").isNull(), "not selected").otherwise("not executed").alias("gap"))
