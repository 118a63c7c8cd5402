"""Queries of the general data problems: dangling references and repeated messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.identity import instant
from marlstone.operators import delivery, orphans
from marlstone.session import load

MESSAGE = (["report_id", "evidence_id"], "timestamp", "outcome_id", "received_at")


#: Records that the fields refer to.
KIND = {"report_id": "report", "evidence_id": "evidence"}
#: Periods of arrival that the orphan queries take one after another.
BATCHES = 3


def _state(spark: SparkSession, sf_dir: str, batches: int = BATCHES) -> orphans.OrphanState:
    """The orphan state after all rows have come in batches by the time they arrived: loads and deletions are facts of their own time."""
    outcomes, rows = load(spark, sf_dir, "outcomes"), load(spark, sf_dir, "report_rows")
    made = F.coalesce(instant(F.col("timestamp")), F.col("received_at").cast("timestamp"))
    facts = orphans.parent_facts(load(spark, sf_dir, "review_reports"), "report_id", "report").unionByName(
        orphans.parent_facts(load(spark, sf_dir, "evidence"), "evidence_id", "evidence")
    )
    first, last, n = outcomes.select(F.unix_micros(F.col("received_at").cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    n = 2 * n + rows.count()
    cuts = [first + (last - first) * i // batches for i in range(1, batches)] if first is not None else []
    state = None
    for low, high in zip([None, *cuts], [*cuts, None]):

        def arrived(when: Column, low=low, high=high) -> Column:
            """Within the period; the first one has all that came before or at no known time."""
            within = (F.coalesce(when, F.lit(-orphans.FOREVER)) < high) if high is not None else F.lit(True)
            return within if low is None else within & (when >= low)

        came = outcomes.filter(arrived(F.unix_micros(F.col("received_at").cast("timestamp"))))
        noted = rows.filter(arrived(F.unix_micros(F.col("created_at").cast("timestamp"))))
        refs = (
            orphans.reference_rows(came, "outcomes", "report_id", "outcome_id", made)
            .unionByName(orphans.reference_rows(came, "outcomes", "evidence_id", "outcome_id", made))
            .unionByName(orphans.reference_rows(noted, "report_rows", "evidence_id", "row_id", F.col("created_at")))
        )
        state = orphans.advance(state, refs, facts.filter(arrived(F.col("known"))), KIND, rows=n)
    return state


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference whose record doesn't exist at the time it is made: what is pending after the last batch."""
    return orphans.orphans_at_birth(_state(spark, sf_dir)).select("ref_table", "ref_field", "ref_id")


def p1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, field and month: orphans opened, reopened, resolved, and waiting at its end."""
    return orphans.snapshot_counts(orphans.spells(orphans.probe(_state(spark, sf_dir))), "month")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus rows of messages delivered more than once."""
    return delivery.surplus(load(spark, sf_dir, "outcomes"), *MESSAGE)


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per lane and verdict after exactly one row of each is kept."""
    outcomes = load(spark, sf_dir, "outcomes").select(*MESSAGE[0], *MESSAGE[1:], "lane", "verdict", "review_ms")
    return (
        delivery.kept_rows(outcomes, *MESSAGE)
        .groupBy("lane", "verdict")
        .agg(F.count(F.lit(1)).alias("messages"), F.sum(F.col("review_ms").cast("long")).alias("review_ms"))
    )


QUERIES = {"p1_found": p1_found, "p1_snapshots": p1_snapshots, "p4_found": p4_found, "p4_kept": p4_kept}

_KEY = "CASE WHEN trim({c}, ' \t\r\n') = '' THEN NULL ELSE regexp_replace(lower(trim({c}, ' \t\r\n')), '^sha256:', '') END"
_OUT = """o AS (SELECT outcome_id, received_at, {r} AS r, {e} AS e, CAST(CAST("timestamp" AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts, lane, verdict, review_ms FROM outcomes)""".format(
    r=_KEY.format(c="report_id"), e=_KEY.format(c="evidence_id")
)
_REFS = f"""{_OUT},
rr AS (SELECT row_id, created_at, {_KEY.format(c="evidence_id")} AS e FROM report_rows),
refs AS (
  SELECT 'outcomes' AS ref_table, 'report_id' AS ref_field, outcome_id AS ref_id, r AS k, coalesce(ts, received_at) AS t FROM o
  UNION ALL SELECT 'outcomes', 'evidence_id', outcome_id, e, coalesce(ts, received_at) FROM o
  UNION ALL SELECT 'report_rows', 'evidence_id', row_id, e, created_at FROM rr),
par AS (
  SELECT 'report_id' AS ref_field, {_KEY.format(c="report_id")} AS k, loaded_at, deleted_at FROM review_reports
  UNION ALL SELECT 'evidence_id', {_KEY.format(c="evidence_id")}, loaded_at, deleted_at FROM evidence)"""
_RANKED = f"""{_OUT},
ranked AS (SELECT *, CASE WHEN r IS NULL OR e IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY r, e, ts ORDER BY received_at, outcome_id) END AS rn FROM o)"""

ORACLES = {
    "p1_found": f"""WITH {_REFS}
SELECT ref_table, ref_field, ref_id FROM refs WHERE k IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM par WHERE par.ref_field = refs.ref_field AND par.k = refs.k AND par.loaded_at <= refs.t AND (par.deleted_at IS NULL OR refs.t < par.deleted_at))""",
    "p1_snapshots": f"""WITH {_REFS},
sp AS (SELECT ref_field, k, loaded_at AS a, coalesce(deleted_at, TIMESTAMP '9999-01-01') AS b FROM par WHERE k IS NOT NULL AND loaded_at IS NOT NULL AND (deleted_at IS NULL OR loaded_at < deleted_at)),
nw AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY ref_field, k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sp),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY ref_field, k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM nw),
isl AS (SELECT ref_field, k, min(a) AS a, max(b) AS b FROM gr GROUP BY ref_field, k, g),
ev AS (
  SELECT ref_table, refs.ref_field, t AS at_time, 1 AS opened, 0 AS reopened, 0 AS resolved FROM refs WHERE refs.k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM isl WHERE isl.ref_field = refs.ref_field AND isl.k = refs.k AND isl.a <= refs.t AND refs.t < isl.b)
  UNION ALL SELECT ref_table, refs.ref_field, isl.b, 1, 1, 0 FROM refs JOIN isl ON isl.ref_field = refs.ref_field AND isl.k = refs.k WHERE isl.b > refs.t AND isl.b < TIMESTAMP '9999-01-01'
  UNION ALL SELECT ref_table, refs.ref_field, isl.a, 0, 0, 1 FROM refs JOIN isl ON isl.ref_field = refs.ref_field AND isl.k = refs.k WHERE isl.a > refs.t),
pe AS (SELECT ref_table, ref_field, date_trunc('month', at_time)::TIMESTAMP AS period, sum(opened)::BIGINT AS opened, sum(reopened)::BIGINT AS reopened, sum(resolved)::BIGINT AS resolved FROM ev GROUP BY 1, 2, 3)
SELECT *, (sum(opened - resolved) OVER (PARTITION BY ref_table, ref_field ORDER BY period))::BIGINT AS waiting FROM pe""",
    "p4_found": f"WITH {_RANKED} SELECT outcome_id FROM ranked WHERE rn > 1",
    "p4_kept": f"WITH {_RANKED} SELECT lane, verdict, count(*)::BIGINT AS messages, sum(review_ms)::BIGINT AS review_ms FROM ranked WHERE rn = 1 GROUP BY lane, verdict",
}
