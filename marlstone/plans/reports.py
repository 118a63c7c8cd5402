"""Queries of history, ledgers, review queues and cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths, text
from marlstone.operators import cleanup, history, ledgers, review
from marlstone.plans.data_quality import _KEY
from marlstone.plans.files import FILES
from marlstone.session import load
from marlstone.sources import adapters

EXPECTED = [("readme", r"^readme(?:\..*)?$", 20), ("licence", r"^licen[cs]e(?:\..*)?$", 10), ("init", r"^__init__\.py$", 5), ("tests", r"_test\.go$", 5)]


def churn_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most often touched paths of the last year."""
    commits, touched = adapters.commits(spark, sf_dir)
    last = commits.agg(F.max("ts").alias("last"))
    recent = commits.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 365 DAYS"))
    return history.churn(recent, touched, fix="(?i)urgent").orderBy(F.desc("commits"), F.desc("fix_touches"), "path").limit(50)


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve paths with most churn."""
    commits, touched = adapters.commits(spark, sf_dir)
    return history.hotspots(commits, touched).orderBy(F.desc("churn"), F.desc("touches"), F.desc("last"), "path").limit(12).select("path", "churn", "touches")


def couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that change together at least twice."""
    return history.couplings(adapters.commits(spark, sf_dir)[1], least_commits=2, least_confidence=0.05)


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by severity of the time since their last touch."""
    commits, touched = adapters.commits(spark, sf_dir)
    stale = history.staleness(history.hotspots(commits, touched), F.lit("2001-12-31").cast("date"))
    return stale.groupBy("severity").agg(F.count(F.lit(1)).alias("paths"), F.max("days").cast("long").alias("days"))


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "report_rows")
    return ledgers.matched_outcomes(load(spark, sf_dir, "outcomes"), rows), rows


def outcome_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes per verdict with a report row, and those that still agree with it."""
    m, _ = _matched(spark, sf_dir)
    return m.groupBy("verdict").agg(F.count(F.lit(1)).alias("outcomes"), F.count("row_id").alias("matched"), F.count_if("intact").alias("intact"))


def outcome_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ratios of the outcome ledger."""
    return ledgers.calibration(*_matched(spark, sf_dir))


def outcome_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files opened, tool calls and time per lane."""
    o = load(spark, sf_dir, "outcomes")
    return o.groupBy("lane").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("files_opened", "tool_calls", "review_ms")], F.median("review_ms").alias("median_ms"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run statistics per repository."""
    return ledgers.run_stats(adapters.runs(spark, sf_dir))


def reduction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of the best reduction per repository."""
    return ledgers.reduction_confidence(adapters.runs(spark, sf_dir))


def run_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of the last five successful reductions."""
    return ledgers.trend(adapters.runs(spark, sf_dir))


def top_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent failed event type per user, all but purchases counting as failed."""
    runs = adapters.runs(spark, sf_dir).withColumn("success", F.col("outcome") == "purchase")
    return ledgers.top_failure(runs)


def savings_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters saved by documents' first paragraphs against whole texts, by time."""
    d = load(spark, sf_dir, "documents").select(F.col("created_at").cast("timestamp").alias("ts"), F.length(F.split("text", "\n\n", 2)[0]).alias("packet_chars"), F.length("text").alias("file_chars"))
    return ledgers.savings(d, F.lit("2025-10-01 12:00:00").cast("timestamp"))


def _census(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = adapters.files(spark, sf_dir)
    tested = f.filter(F.col("class") == "test").select(paths.base(F.col("path")).alias("base")).distinct().withColumn("hits", F.lit(1))
    blocks = f.filter(F.col("class") != "test").select(F.col("repo").alias("package"), F.col("path").alias("file"), F.size(F.split("content", "\n")).alias("statements"), paths.base(F.col("path")).alias("base"))
    return ledgers.coverage_census(blocks.join(tested, "base", "left").withColumn("hits", F.coalesce("hits", F.lit(0))))


def coverage_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files with a test file of the same name, per repository."""
    return _census(spark, sf_dir)


def prep_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories by missing coverage."""
    return ledgers.prep_worklist(_census(spark, sf_dir))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "report_rows")
    reasons = rows.select("path", F.col("score").cast("long").alias("points"), F.lit(0).cast("long").alias("churn"), F.lit("report").alias("reason"))
    plan = load(spark, sf_dir, "clean_plan").filter("status <> 'clean'").select(F.regexp_replace("file", r"^\./", "").alias("path"), F.when(F.col("status") == "delete", 1000).otherwise(500).cast("long").alias("points"), F.lit(0).cast("long").alias("churn"), F.concat(F.lit("hygiene:"), "status").alias("reason"))
    seen = load(spark, sf_dir, "evidence").filter("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("churn")).select("path", F.col("churn").alias("points"), "churn", F.lit("evidence").alias("reason"))
    return reasons.unionByName(plan).unionByName(seen)


def read_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred paths to read first."""
    return review.read_queue(review.compose(_signals(spark, sf_dir))).select("rank", "path", "score", "churn", F.concat_ws(",", "why").alias("why"))


def cull_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows per culling lane."""
    rows = load(spark, sf_dir, "report_rows")
    lane = review.cull_lane(F.col("path"), F.col("score"), F.coalesce(F.size("why"), F.lit(0)))
    return rows.groupBy(lane.alias("cull_lane")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("score").cast("long")).alias("score"))


def queue_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision of each queue row."""
    queue = review.read_queue(review.compose(_signals(spark, sf_dir)))
    return review.selection(queue, ["**/*.go", "**/*.py"], ["internal/vendors/**"], 20)


def receipt_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without outcomes and outcomes without a report."""
    key = F.hex(F.col("k"))
    from marlstone.functions.identity import digest_key

    a = load(spark, sf_dir, "review_reports").select(digest_key(F.col("report_id")).alias("k")).select(key.alias("id"))
    b = load(spark, sf_dir, "outcomes").select(digest_key(F.col("report_id")).alias("k")).filter("k is not null").select(key.alias("id"))
    return review.receipt_gaps(a, b)


def clean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleanup score per path from statuses and file facts."""
    rules = F.create_map(*[F.lit(x) for pair in {"untrack": "untracked", "large_file": "large-file", "archive": "stale", "delete": "orphaned", "dev_artifact": "generated", "misplaced_script": "scratch"}.items() for x in pair])
    plan = load(spark, sf_dir, "clean_plan").select(F.regexp_replace("file", r"^\./", "").alias("path"), rules[F.col("status")].alias("rule"), F.when(F.col("reason").isNull(), 0).when(F.col("size_kb") > 1, 2).otherwise(1).alias("severity")).filter("rule is not null")
    empty = adapters.files(spark, sf_dir).filter(F.col("content") == "").select("path", F.lit("empty").alias("rule"), F.lit(0).alias("severity"))
    return cleanup.findings_score(plan.unionByName(empty))


def repo_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of each repository's plan."""
    return cleanup.health(load(spark, sf_dir, "clean_plan"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected files that a repository lacks."""
    return cleanup.completeness(adapters.files(spark, sf_dir), EXPECTED)


def hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned, unplanned and unknown files per repository."""
    plan = load(spark, sf_dir, "clean_plan").groupBy("file_id").agg(F.max(F.lit(1)).alias("planned"), F.max((F.col("status") == "untrack").cast("int")).alias("untrack"))
    f = adapters.files(spark, sf_dir).join(plan, "file_id", "left")
    return f.groupBy("repo").agg(F.count("planned").alias("planned"), F.count_if(F.col("planned").isNull()).alias("unplanned"), F.count_if((F.col("untrack") == 1) & (F.col("class") == "production")).alias("high"))


QUERIES = {
    q.__name__: q
    for q in (
        churn_top, hotspots, couplings, staleness, outcome_matches, outcome_calibration, outcome_costs, run_stats, reduction_confidence, run_trend, top_failures,
        savings_buckets, coverage_census, prep_worklist, read_queue, cull_lanes, queue_selection, receipt_gaps, clean_scores, repo_health, completeness, hygiene,
    )
}
_ = text

_C = """c AS (SELECT o_orderkey AS hash, o_orderdate AS ts, o_orderpriority AS subject FROM orders), t AS (SELECT l_orderkey AS hash, l_partkey AS path, sum(l_quantity::BIGINT)::BIGINT AS churn FROM lineitem GROUP BY 1, 2)"""
_H = f"{_C}, h AS (SELECT path, sum(churn)::BIGINT AS churn, count(*)::BIGINT AS touches, max(ts) AS last FROM t JOIN c USING (hash) GROUP BY path)"
_M = f"""o AS (SELECT *, {_KEY.format(c='report_id')} AS r, {_KEY.format(c='evidence_id')} AS e FROM outcomes),
w AS (SELECT r, e, min(row_id) AS row_id FROM (SELECT {_KEY.format(c='report_id')} AS r, {_KEY.format(c='evidence_id')} AS e, row_id FROM report_rows) WHERE r IS NOT NULL AND e IS NOT NULL GROUP BY r, e),
m AS (SELECT o.*, w.row_id, CASE WHEN w.row_id IS NOT NULL THEN o.rank IS NOT DISTINCT FROM q.rank AND o.score IS NOT DISTINCT FROM q.score AND o.lane IS NOT DISTINCT FROM q.lane END AS intact FROM o LEFT JOIN w USING (r, e) LEFT JOIN report_rows q ON q.row_id = w.row_id)"""
_RUNS = "x AS (SELECT event_id AS seq, user_id AS repo, event_type AS outcome, event_type <> 'error' AS success, value AS net FROM events)"
_SIG = r"""sig AS (SELECT path, score::BIGINT AS points, 0 AS churn, 'report' AS reason FROM report_rows
 UNION ALL SELECT regexp_replace(file, '^\./', ''), CASE WHEN status = 'delete' THEN 1000 ELSE 500 END, 0, 'hygiene:' || status FROM clean_plan WHERE status <> 'clean'
 UNION ALL SELECT path, count(*), count(*), 'evidence' FROM evidence WHERE path IS NOT NULL GROUP BY path),
cand AS (SELECT path, sum(points)::BIGINT AS score, max(churn)::BIGINT AS churn, string_agg(DISTINCT reason, ',' ORDER BY reason) AS why FROM sig GROUP BY path),
queue AS (SELECT row_number() OVER (ORDER BY score DESC, churn DESC, path)::INT AS rank, * FROM cand ORDER BY rank LIMIT 100)"""
_CENSUS = f"""{FILES}, tb AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS base FROM f WHERE class = 'test'),
b AS (SELECT repo AS package, path, len(string_split(content, chr(10))) AS statements, regexp_extract(path, '[^/]*$') IN (SELECT base FROM tb) AS hit FROM f WHERE class <> 'test'),
z0 AS (SELECT package, count(DISTINCT path)::BIGINT AS files, sum(statements)::BIGINT AS statements, sum(CASE WHEN hit THEN statements ELSE 0 END)::BIGINT AS covered FROM b GROUP BY package), z AS (SELECT *, round(100 * covered / statements, 2)::DOUBLE AS percent FROM z0)"""
ORACLES = {
    "churn_top": f"WITH {_C}, k AS (SELECT * FROM c WHERE ts >= (SELECT max(ts) FROM c) - INTERVAL 365 DAY) SELECT path, count(DISTINCT hash)::BIGINT AS commits, count_if(regexp_matches(subject, '(?i)urgent'))::BIGINT AS fix_touches FROM t JOIN k USING (hash) GROUP BY path ORDER BY commits DESC, fix_touches DESC, path LIMIT 50",
    "hotspots": f"WITH {_H} SELECT path, churn, touches FROM h ORDER BY churn DESC, touches DESC, last DESC, path LIMIT 12",
    "couplings": f"WITH {_C}, s AS (SELECT hash FROM t GROUP BY hash HAVING count(*) <= 20), g AS (SELECT t.* FROM t JOIN s USING (hash)), n AS (SELECT path, count(*) AS touches FROM g GROUP BY path), p AS (SELECT a.path, b.path AS partner, count(*)::BIGINT AS commits FROM g a JOIN g b ON a.hash = b.hash AND a.path <> b.path GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT path, partner, commits, commits / touches AS confidence FROM p JOIN n USING (path) WHERE commits / touches >= 0.05) SELECT path, partner, commits, confidence FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY commits DESC, partner) AS rn FROM r) WHERE rn <= 4",
    "staleness": f"WITH {_H}, d AS (SELECT path, date_diff('day', last::DATE, DATE '2001-12-31') AS days FROM h) SELECT CASE WHEN days > 365 THEN 'error' WHEN days > 180 THEN 'warn' WHEN days > 90 THEN 'info' ELSE 'fresh' END AS severity, count(*)::BIGINT AS paths, max(days)::BIGINT AS days FROM d GROUP BY 1",
    "outcome_matches": f"WITH {_M} SELECT verdict, count(*)::BIGINT AS outcomes, count(row_id)::BIGINT AS matched, count_if(intact)::BIGINT AS intact FROM m GROUP BY verdict",
    "outcome_calibration": f"""WITH {_M}, k AS (SELECT count_if(row_id IS NOT NULL AND verdict = 'confirmed')::BIGINT AS confirmed, count_if(row_id IS NOT NULL AND verdict = 'refuted')::BIGINT AS refuted, count_if(row_id IS NOT NULL AND verdict = 'unknown')::BIGINT AS unknown, count_if(row_id IS NOT NULL AND verdict = 'skipped')::BIGINT AS skipped,
 count_if(row_id IS NOT NULL AND verdict = 'confirmed' AND rank <= 15)::BIGINT AS confirmed_in_top, count_if(row_id IS NOT NULL AND verdict = 'refuted' AND rank <= 15)::BIGINT AS noise_in_top, count_if(verdict IN ('confirmed', 'refuted'))::BIGINT AS labeled, count_if(row_id IS NULL AND verdict = 'confirmed')::BIGINT AS missing_confirmed, count_if(row_id IS NULL)::BIGINT AS unmatched, count_if(NOT intact)::BIGINT AS stale FROM m),
 s AS (SELECT sum(least(15, n))::BIGINT AS top_slots FROM (SELECT {_KEY.format(c='report_id')} AS r, count(*) AS n FROM report_rows GROUP BY 1))
 SELECT *, noise_in_top / top_slots AS noise_top_rate, confirmed_in_top / (confirmed + missing_confirmed) AS confirmed_top_recall, confirmed / (confirmed + missing_confirmed) AS confirmed_found_recall, (confirmed + refuted) / labeled AS labeled_coverage FROM k, s""",
    "outcome_costs": "SELECT lane, sum(files_opened)::BIGINT AS files_opened, sum(tool_calls)::BIGINT AS tool_calls, sum(review_ms)::BIGINT AS review_ms, median(review_ms)::DOUBLE AS median_ms FROM outcomes GROUP BY lane",
    "run_stats": f"WITH {_RUNS}, r AS (SELECT repo, count(*)::BIGINT AS recent_runs, count_if(success)::BIGINT AS recent_successes FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq DESC) AS rn FROM x) WHERE rn <= 10 GROUP BY repo), a AS (SELECT repo, count(*)::BIGINT AS runs, count_if(success)::BIGINT AS successes, avg(net) FILTER (WHERE success) AS avg_reduction, median(net) FILTER (WHERE success) AS median_reduction, max(net) FILTER (WHERE success) AS best_reduction FROM x GROUP BY repo) SELECT *, successes / runs AS success_rate, recent_successes / recent_runs AS recent_success_rate FROM a JOIN r USING (repo)",
    "reduction_confidence": f"WITH {_RUNS}, w AS (SELECT * FROM x WHERE success AND net IS NOT NULL), b AS (SELECT repo, count(*)::BIGINT AS n, arg_min(net, seq) AS first, max(net) AS best, median(net) AS middle FROM w GROUP BY repo), d AS (SELECT repo, median(abs(net - middle)) AS mad FROM w JOIN b USING (repo) GROUP BY repo) SELECT repo, n, CASE WHEN n >= 3 AND best <> first AND mad <> 0 THEN abs(best - first) / mad END AS confidence FROM b JOIN d USING (repo)",
    "run_trend": f"WITH {_RUNS}, l AS (SELECT repo, net, -row_number() OVER (PARTITION BY repo ORDER BY seq DESC) AS i FROM x WHERE success AND net IS NOT NULL), g AS (SELECT repo, count(*) AS n, regr_slope(net, i) AS s FROM l WHERE i >= -5 GROUP BY repo) SELECT repo, CASE WHEN n = 5 THEN s ELSE 0.0 END AS slope, n = 5 AND abs(s) < 1.0 AS plateau FROM g",
    "top_failures": f"WITH {_RUNS}, n AS (SELECT repo, outcome, count(*)::BIGINT AS n, sum(count(*)) OVER (PARTITION BY repo) AS failures FROM x WHERE outcome <> 'purchase' GROUP BY repo, outcome) SELECT repo, outcome, n, (n / failures)::DOUBLE AS share FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, outcome) AS rn FROM n) WHERE rn = 1",
    "savings_buckets": "WITH s AS (SELECT created_at::DATE AS day, length(split_part(text, chr(10) || chr(10), 1)) AS p, length(text) AS f FROM documents), b AS (SELECT 'all_time' AS bucket, * FROM s UNION ALL SELECT 'last_week', * FROM s WHERE day > DATE '2025-10-01' - 7 UNION ALL SELECT 'today', * FROM s WHERE day = DATE '2025-10-01') SELECT bucket, count(*)::BIGINT AS calls, sum(p)::BIGINT AS packet_chars, sum(f)::BIGINT AS file_chars, sum(greatest(0, f - p))::BIGINT AS saved_chars, (sum(greatest(0, f - p)) // 4)::BIGINT AS saved_tokens FROM b GROUP BY bucket",
    "coverage_census": f"WITH {_CENSUS} SELECT * FROM z",
    "prep_worklist": f"WITH {_CENSUS} SELECT package, percent, round((90.0 - percent) * (statements - covered), 2)::DOUBLE AS priority FROM z WHERE percent < 90.0 ORDER BY priority DESC, package LIMIT 20",
    "read_queue": f"WITH {_SIG} SELECT rank, path, score, churn, why FROM queue",
    "cull_lanes": r"""WITH s AS (SELECT lower(path) AS p, string_split(lower(path), '/') AS g, score, coalesce(len(why), 0) AS n FROM report_rows) SELECT CASE WHEN regexp_matches(p, '(\.gen\.go|_generated\.go|\.pb\.go|\.min\.js|\.min\.css)$') OR list_has_any(g, ['generated', 'dist', 'vendor', 'node_modules']) THEN 'generated' WHEN regexp_matches(p, '_test\.[a-z]+$|\.(test|spec)\.[a-z]+$') OR list_has_any(g, ['test', 'tests', 'testdata', 'fixtures']) THEN 'test' WHEN regexp_matches(p, '\.(md|rst|txt)$') OR list_contains(g, 'docs') THEN 'docs' WHEN score >= 20 AND n >= 2 THEN 'kept' WHEN score >= 8 THEN 'alternate' ELSE 'low-signal' END AS cull_lane, count(*)::BIGINT AS rows, sum(score)::BIGINT AS score FROM s GROUP BY 1""",
    "queue_selection": rf"WITH {_SIG}, d AS (SELECT rank, path, CASE WHEN path LIKE 'internal/vendors/%' THEN 'excluded' WHEN NOT regexp_matches(path, '\.(go|py)$') THEN 'not-included' END AS reason FROM queue), n AS (SELECT *, count_if(reason IS NULL) OVER (ORDER BY rank) AS nth FROM d) SELECT rank, path, CASE WHEN reason IS NOT NULL THEN 'filtered' WHEN nth <= 20 THEN 'selected' ELSE 'deprioritized' END AS decision, reason FROM n",
    "receipt_gaps": f"WITH a AS (SELECT DISTINCT upper({_KEY.format(c='report_id')}) AS id FROM review_reports), b AS (SELECT DISTINCT upper({_KEY.format(c='report_id')}) AS id FROM outcomes WHERE {_KEY.format(c='report_id')} IS NOT NULL) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'not selected' ELSE 'not executed' END AS gap FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL",
    "clean_scores": r"""WITH p AS (SELECT regexp_replace(file, '^\./', '') AS path, CASE status WHEN 'untrack' THEN 'untracked' WHEN 'large_file' THEN 'large-file' WHEN 'archive' THEN 'stale' WHEN 'delete' THEN 'orphaned' WHEN 'dev_artifact' THEN 'generated' WHEN 'misplaced_script' THEN 'scratch' END AS rule, CASE WHEN reason IS NULL THEN 0 WHEN size_kb > 1 THEN 2 ELSE 1 END AS severity FROM clean_plan UNION ALL SELECT path, 'empty', 0 FROM source_files WHERE content = ''),
w AS (SELECT path, CASE rule WHEN 'untracked' THEN 20 WHEN 'stale' THEN [15, 25, 35][severity + 1] WHEN 'large-file' THEN [0, 10, 20][severity + 1] WHEN 'generated' THEN 15 WHEN 'scratch' THEN 20 WHEN 'orphaned' THEN 25 WHEN 'empty' THEN 30 END AS points FROM p WHERE rule IS NOT NULL) SELECT path, least(100, sum(points))::BIGINT AS score, count(*)::BIGINT AS findings FROM w GROUP BY path""",
    "repo_health": "WITH s AS (SELECT repo, count(*)::BIGINT AS files, count_if(status = 'clean')::BIGINT AS clean, count_if(status = 'large_file') AS l, count_if(status = 'untrack') AS u, count_if(status = 'delete') AS d, coalesce(sum(size_kb) FILTER (WHERE status IN ('delete', 'archive')), 0) AS j FROM clean_plan GROUP BY repo) SELECT repo, files, clean, greatest(0, ((clean * 100) // files) * 40 // 100 + 60 - least(40, 3 * l + 2 * u + d) - least(20, j // 51200))::BIGINT AS health FROM s",
    "completeness": r"WITH r AS (SELECT DISTINCT repo FROM source_files), e AS (SELECT * FROM (VALUES ('readme', '^readme(\..*)?$', 20), ('licence', '^licen[cs]e(\..*)?$', 10), ('init', '^__init__\.py$', 5), ('tests', '_test\.go$', 5)) v(rule, pattern, points)), m AS (SELECT repo, points FROM r, e WHERE NOT EXISTS (SELECT 1 FROM source_files s WHERE s.repo = r.repo AND regexp_matches(lower(regexp_extract(s.path, '[^/]*$')), e.pattern))) SELECT repo, count(points)::BIGINT AS missing, greatest(0, 100 - coalesce(sum(points), 0))::BIGINT AS score FROM r LEFT JOIN m USING (repo) GROUP BY repo",
    "hygiene": f"WITH {FILES}, p AS (SELECT file_id, max(CASE WHEN status = 'untrack' THEN 1 WHEN status IS NOT NULL THEN 0 END) AS untrack FROM clean_plan GROUP BY file_id) SELECT repo, count(p.file_id)::BIGINT AS planned, count_if(p.file_id IS NULL)::BIGINT AS unplanned, count_if(untrack = 1 AND class = 'production')::BIGINT AS high FROM f LEFT JOIN p USING (file_id) GROUP BY repo",
}
