"""Deletions of reloads that overlap or touch an earlier span."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import orphans

KIND = {"evidence_id": "evidence"}


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def _refs(spark, rows):
    return orphans.reference_rows(spark.createDataFrame([(i, "k", day(t)) for i, t in rows], "row_id long, evidence_id string, at timestamp"), "t", "evidence_id", "row_id", F.col("at"))


def _parents(spark, rows):
    return orphans.parent_facts(spark.createDataFrame([("k", day(a), day(b)) for a, b in rows], "evidence_id string, loaded_at timestamp, deleted_at timestamp"), "evidence_id", "evidence")


@pytest.mark.parametrize("again", [5, 10])
def test_reload_deleted_in_a_later_batch(spark, again):
    batches = [([(1, 3), (2, 12)], [(1, 10)]), ([(3, 25)], [(again, None)]), ([(4, 15)], [(again, 20)]), ([(5, 30)], [(28, None)])]
    state = None
    for n, (refs, parents) in enumerate(batches):
        facts = _parents(spark, parents)
        # the third batch deletes the record of the second
        state = orphans.advance(state, _refs(spark, refs), facts.filter(F.col("to") < orphans.FOREVER) if n == 2 else facts, KIND)
    probed = orphans.probe(state)
    assert {r.ref_id for r in orphans.orphans_at_birth(state).collect()} == {3}
    reopened = sorted((r.ref_id, r["from"]) for r in orphans.spells(probed).filter("reopened").collect())
    end = int((day(20) - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
    assert reopened == [(1, end), (2, end), (4, end)]
