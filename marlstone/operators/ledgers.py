"""Ledgers of outcomes, runs and savings, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.identity import digest_key
from marlstone.functions.text import ratio

TOP_K = 15


def matched_outcomes(outcomes: DataFrame, rows: DataFrame) -> DataFrame:
    """Outcomes with their report row (report and evidence id), the first by row id; ``row_id`` is NULL for an unmatched one.

    ``intact`` says whether rank, score and lane agree with the row.
    """
    keyed = outcomes.withColumn("_r", digest_key(F.col("report_id"))).withColumn("_e", digest_key(F.col("evidence_id")))
    firsts = (
        rows.select(digest_key(F.col("report_id")).alias("_r"), digest_key(F.col("evidence_id")).alias("_e"), F.struct("row_id", F.col("rank").alias("r_rank"), F.col("score").alias("r_score"), F.col("lane").alias("r_lane")).alias("s"))
        .filter(F.col("_r").isNotNull() & F.col("_e").isNotNull())
        .groupBy("_r", "_e")
        .agg(F.min("s").alias("s"))
    )
    joined = keyed.join(firsts, ["_r", "_e"], "left")
    intact = F.col("rank").eqNullSafe(F.col("s.r_rank")) & F.col("score").eqNullSafe(F.col("s.r_score")) & F.col("lane").eqNullSafe(F.col("s.r_lane"))
    return joined.select(*outcomes.columns, F.col("s.row_id").alias("row_id"), F.when(F.col("s").isNotNull(), intact).alias("intact"))


def calibration(matched: DataFrame, rows: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """One row of counts and ratios over a ledger."""
    found = F.col("row_id").isNotNull()
    confirmed, refuted = F.col("verdict") == "confirmed", F.col("verdict") == "refuted"
    at_top = F.col("rank") <= top_k
    counts = matched.agg(
        F.count_if(found & confirmed).alias("confirmed"),
        F.count_if(found & refuted).alias("refuted"),
        F.count_if(found & (F.col("verdict") == "unknown")).alias("unknown"),
        F.count_if(found & (F.col("verdict") == "skipped")).alias("skipped"),
        F.count_if(found & confirmed & at_top).alias("confirmed_in_top"),
        F.count_if(found & refuted & at_top).alias("noise_in_top"),
        F.count_if(confirmed | refuted).alias("labeled"),
        F.count_if(~found & confirmed).alias("missing_confirmed"),
        F.count_if(~found).alias("unmatched"),
        F.count_if(~F.col("intact")).alias("stale"),
    )
    slots = rows.groupBy(digest_key(F.col("report_id")).alias("_r")).agg(F.least(F.lit(top_k), F.count(F.lit(1))).alias("slots")).agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("top_slots"))
    every = counts.crossJoin(F.broadcast(slots))
    goal = F.col("confirmed") + F.col("missing_confirmed")
    return every.select(
        "*",
        ratio(F.col("noise_in_top"), F.col("top_slots")).alias("noise_top_rate"),
        ratio(F.col("confirmed_in_top"), goal).alias("confirmed_top_recall"),
        ratio(F.col("confirmed"), goal).alias("confirmed_found_recall"),
        ratio(F.col("confirmed") + F.col("refuted"), F.col("labeled")).alias("labeled_coverage"),
    )


def run_stats(runs: DataFrame, window: int = 10) -> DataFrame:
    """Runs, success rates and net reductions per repository, overall and over the last runs."""
    recent = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("seq")))
    last = runs.withColumn("_rn", recent).filter(F.col("_rn") <= window).groupBy("repo").agg(F.count(F.lit(1)).alias("recent_runs"), F.count_if("success").alias("recent_successes"))
    won = F.when(F.col("success"), F.col("net_reduction"))
    whole = runs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes"), F.avg(won).alias("avg_reduction"), F.median(won).alias("median_reduction"), F.max(won).alias("best_reduction")
    )
    return whole.join(last, "repo").select("*", ratio(F.col("successes"), F.col("runs")).alias("success_rate"), ratio(F.col("recent_successes"), F.col("recent_runs")).alias("recent_success_rate"))


def reduction_confidence(runs: DataFrame) -> DataFrame:
    """|best - first| over the median absolute deviation of a repository's successful reductions; NULL below three, without a gain, or without spread."""
    won = runs.filter("success and net_reduction is not null")
    base = won.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.min_by("net_reduction", "seq").alias("first"), F.max("net_reduction").alias("best"), F.median("net_reduction").alias("middle"))
    spread = won.join(base.select("repo", "middle"), "repo").groupBy("repo").agg(F.median(F.abs(F.col("net_reduction") - F.col("middle"))).alias("mad"))
    value = F.when((F.col("n") >= 3) & (F.col("best") != F.col("first")) & (F.col("mad") != 0), F.abs(F.col("best") - F.col("first")) / F.col("mad"))
    return base.join(spread, "repo").select("repo", "n", value.alias("confidence"))


def trend(runs: DataFrame, window: int = 5, epsilon: float = 1.0) -> DataFrame:
    """Slope of the last successful reductions of each repository, and whether it is flat."""
    won = runs.filter("success and net_reduction is not null")
    last = won.withColumn("_rn", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("seq")))).filter(F.col("_rn") <= window)
    sums = last.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("net_reduction", -F.col("_rn")).alias("slope"))
    full = F.col("n") == window
    return sums.select("repo", F.when(full, F.col("slope")).otherwise(0.0).alias("slope"), (full & (F.abs("slope") < epsilon)).alias("plateau"))


def top_failure(runs: DataFrame) -> DataFrame:
    """Most frequent outcome of failed runs per repository, ties by name, with its share."""
    failed = runs.filter(~F.col("success") & (F.col("outcome") != ""))
    n = failed.groupBy("repo", "outcome").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("repo").agg(F.min(F.struct((-F.col("n")).alias("m"), "outcome")).alias("b"), F.sum("n").alias("failures"))
    return best.select("repo", F.col("b.outcome").alias("outcome"), (-F.col("b.m")).alias("n"), ratio(-F.col("b.m"), F.col("failures")).alias("share"))


def savings(records: DataFrame, now: Column) -> DataFrame:
    """Calls and saved characters today, in the last seven days and ever; records has ts, packet_chars, file_chars."""
    day, today = F.to_date("ts"), F.to_date(now)
    saved = F.greatest(F.lit(0), F.col("file_chars") - F.col("packet_chars"))
    buckets = F.array(
        F.when(day == today, F.lit("today")), F.when(day > F.date_sub(today, 7), F.lit("last_week")), F.lit("all_time")
    )
    each = records.select(saved.alias("saved"), "packet_chars", "file_chars", F.explode(F.array_compact(buckets)).alias("bucket"))
    return each.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("packet_chars").cast("long").alias("packet_chars"), F.sum("file_chars").cast("long").alias("file_chars"), F.sum("saved").cast("long").alias("saved_chars")
    ).withColumn("saved_tokens", F.expr("saved_chars div 4"))


def coverage_census(blocks: DataFrame) -> DataFrame:
    """Statement coverage per package; blocks has package, file, statements, hits."""
    sums = blocks.groupBy("package").agg(
        F.count_distinct("file").alias("files"), F.sum("statements").cast("long").alias("statements"), F.sum(F.when(F.col("hits") > 0, F.col("statements")).otherwise(0)).cast("long").alias("covered")
    )
    return sums.withColumn("percent", F.round(100 * ratio(F.col("covered"), F.col("statements")), 2))


def prep_worklist(census: DataFrame, target: float = 90.0, top: int = 20) -> DataFrame:
    """Packages below the target by deficit times uncovered statements."""
    need = F.round((target - F.col("percent")) * (F.col("statements") - F.col("covered")), 2)
    return census.filter(F.col("percent") < target).select("package", "percent", need.alias("priority")).orderBy(F.desc("priority"), "package").limit(top)
