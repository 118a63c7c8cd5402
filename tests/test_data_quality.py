"""Dangling references and repeated messages against brute force and by hand."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marlstone.functions.identity import digest_key, instant
from marlstone.operators import delivery, orphans, skew

H = {c: c * 64 for c in "abcdef"}
T0 = dt.datetime(2025, 1, 1)
MESSAGE = (["report_id", "evidence_id"], "timestamp", "outcome_id", "received_at")
OUT = "outcome_id long, report_id string, evidence_id string, timestamp string, received_at timestamp, _id string"


def day(n):
    return T0 + dt.timedelta(days=n)


def test_digest_key_forms_are_equal(spark):
    forms = [f"sha256:{H['a']}", H["a"], H["a"].upper(), f"SHA256:{H['a']} ", f"  {H['a']}\t"]
    rows = spark.createDataFrame([(f,) for f in forms], "x string").select(digest_key(F.col("x")).alias("k"))
    assert rows.distinct().count() == 1
    odd = spark.createDataFrame([(None,), ("",), ("  ",), ("sha256:12",)], "x string").select(digest_key(F.col("x")).alias("k")).collect()
    assert [r.k is None for r in odd] == [True, True, True, False]


def test_instants_with_offsets(spark):
    rows = spark.createDataFrame([("2025-01-01T12:00:00+02:00",), ("2025-01-01T10:00:00Z",), ("2025-01-01T10:00:00.000000Z",), ("bad",), (None,)], "x string")
    got = [r.t for r in rows.select(instant(F.col("x")).alias("t")).collect()]
    assert got[0] == got[1] == got[2] and got[3] is None and got[4] is None


def _refs(spark, rows):
    return orphans.reference_rows(spark.createDataFrame(rows, "row_id long, evidence_id string, at timestamp, key string, spans int"), "t", "evidence_id", "row_id", F.col("at"))


def _parents(spark, rows):
    return orphans.parent_facts(spark.createDataFrame(rows, "evidence_id string, loaded_at timestamp, deleted_at timestamp, kind int"), "evidence_id", "evidence")


KIND = {"evidence_id": "evidence"}


def test_orphans_point_in_time(spark):
    refs = [(1, H["a"], day(5), "", 0), (2, H["a"], day(1), "", 0), (3, H["a"], day(10), "", 0), (4, H["b"], day(5), "", 0), (5, None, day(5), "", 0), (6, " ", day(5), "", 0), (7, H["a"].upper(), day(20), "", 0)]
    parents = [(f"sha256:{H['a']}", day(2), day(10), 0), (H["a"], day(15), None, 0), (H["a"], day(15), None, 0)]
    state = orphans.advance(None, _refs(spark, refs), _parents(spark, parents), KIND)
    got = {r.ref_id for r in orphans.orphans_at_birth(state).collect()}
    assert got == {2, 3, 4}


def test_batches_give_the_same_as_one(spark):
    rng = random.Random(3)
    ids = list(H.values())
    refs = [(i, rng.choice(ids), day(rng.randint(0, 40)), "", 0) for i in range(120)]
    parents = []
    for k in ids[:5]:
        t = rng.randint(0, 5)
        for _ in range(3):
            end = t + rng.randint(1, 8)
            parents.append((k, day(t), day(end), 0))
            t = end + rng.randint(0, 5)
    brute = {i for i, k, t, _, _ in refs if not any(p == k and a <= t < b for p, a, b, _ in parents)}
    loads = [(k, a, None, 0) for k, a, _, _ in parents]
    end = orphans.FOREVER
    for salts in (32,):
        whole = orphans.advance(None, _refs(spark, refs), _parents(spark, parents), KIND, salts)
        # loads without their ends first, then the ends alone, with references between them
        step = orphans.advance(None, _refs(spark, refs[:50]), _parents(spark, loads), KIND, salts)
        step = orphans.advance(step, _refs(spark, refs[50:90]), _parents(spark, parents[:7]).filter(F.col("to") < end), KIND, salts)
        step = orphans.advance(step, _refs(spark, refs[90:]), _parents(spark, parents[7:]).filter(F.col("to") < end), KIND, salts)
        for state in (whole, step):
            assert sorted(r.ref_id for r in orphans.orphans_at_birth(state).collect()) == sorted(brute)
            assert sorted(r.ref_id for r in orphans.references_of(state).collect()) == list(range(120))


def test_overlapping_records_in_batches_of_any_order(spark):
    """Overlapping, touching and repeated records of one id, each load and each deletion a batch of its own."""
    rng = random.Random(8)
    parents = [(H["a"], day(1), day(5), 0), (H["a"], day(2), None, 0), (H["a"], day(5), day(9), 0), (H["a"], day(2), day(7), 0), (H["b"], day(3), day(3), 0), (H["b"], day(9), day(4), 0)]
    refs = [(t * 10 + n, k, day(t), "", 0) for t in range(12) for n, k in enumerate([H["a"], H["a"].upper(), H["b"]])]
    brute = {i for i, k, t, _, _ in refs if not any(p == k.lower() and a <= t and (b is None or t < b) for p, a, b, _ in parents)}
    facts = [(i, w) for i in range(len(parents)) for w in ("load", "end")]
    for _ in range(1):
        rng.shuffle(facts)
        shuffled = rng.sample(refs, len(refs))
        state = None
        for n in range(3):
            new = [parents[i] for i, w in facts[n::3] if w == "load"], [parents[i] for i, w in facts[n::3] if w == "end"]
            batch = _parents(spark, [(k, a, None, 0) for k, a, _, _ in new[0]]).unionByName(_parents(spark, new[1]).filter(F.col("to") < orphans.FOREVER))
            state = orphans.advance(state, _refs(spark, shuffled[n::3]), batch, KIND)
        assert {r.ref_id for r in orphans.orphans_at_birth(state).collect()} == brute


def test_repeated_references_without_id_are_reopened_each(spark):
    refs = [(None, H["a"], day(5), "", 0), (None, H["a"], day(5), "", 0), (1, H["a"], day(5), "", 0)]
    state = orphans.advance(None, _refs(spark, refs), _parents(spark, [(H["a"], day(1), None, 0)]), KIND)
    assert orphans.orphans_at_birth(state).count() == 0
    for end in (day(3), day(4)):  # the second deletion finds them pending already
        state = orphans.advance(state, _refs(spark, []), _parents(spark, [(H["a"], day(1), end, 0)]).filter(F.col("to") < orphans.FOREVER), KIND)
        assert orphans.orphans_at_birth(state).count() == 3
    state = orphans.advance(state, _refs(spark, []), _parents(spark, [(H["a"], day(4), None, 0)]), KIND)
    assert orphans.orphans_at_birth(state).count() == 0 and orphans.references_of(state).count() == 3


def test_spells_and_snapshots(spark):
    state = orphans.advance(None, _refs(spark, [(1, H["a"], day(0), "", 0)]), _parents(spark, [(H["a"], day(40), day(80), 0)]), KIND)
    pending = orphans.spells(orphans.probe(state))
    got = sorted((r["from"], r.to, r.reopened) for r in pending.collect())
    assert len(got) == 2 and [g[2] for g in got] == [False, True]
    counts = {r.period.month: (r.opened, r.reopened, r.resolved, r.waiting) for r in orphans.snapshot_counts(pending).collect()}
    assert counts == {1: (1, 0, 0, 1), 2: (0, 0, 1, 0), 3: (1, 1, 0, 1)}


def test_hot_keys_are_found_and_salting_keeps_rows(spark):
    df = spark.createDataFrame([("h" if i % 3 else str(i), i) for i in range(3000)], "k string, v int")
    hot = skew.hot_keys(df, "k", least=100)
    assert hot == ["h"] and skew.hot_keys(df, "k", rows=3000) == []
    left = skew.salted(df, "k", hot, 8, F.col("v"))
    right = skew.replicated(df.select("k").distinct(), "k", hot, 8)
    assert left.join(right, ["k", "_salt"]).count() == 3000
    assert left.filter("k = 'h'").select("_salt").distinct().count() == 8


def test_surplus_against_brute_force(spark):
    rng = random.Random(5)
    stamps = ["2025-01-01T10:00:00Z", "2025-01-01T12:00:00+02:00", "2025-01-01T10:00:01Z", None]
    rows = []
    for i in range(300):
        rows.append((i, rng.choice([H["a"], f"SHA256:{H['a']}", H["b"], None, ""]), rng.choice([H["c"], H["d"].upper(), H["d"]]), rng.choice(stamps), rng.choice([day(0), day(1), None]), "x"))
    key = lambda r: (r[1].lower().replace("sha256:", ""), r[2].lower(), {stamps[1]: stamps[0]}.get(r[3], r[3]))
    keep = {}
    for r in rows:
        if r[1]:
            keep[key(r)] = min(keep.get(key(r), ((dt.datetime.max, 10**9),)), ((r[4] or dt.datetime.max, r[0]),))
    brute = {r[0] for r in rows if r[1] and keep[key(r)][0][1] != r[0]}
    got = [r.outcome_id for r in delivery.surplus(spark.createDataFrame(rows, OUT), *MESSAGE).collect()]
    assert set(got) == brute and len(got) == len(brute)


def test_surplus_of_exact_repeats_and_empty(spark):
    row = (7, H["a"], H["b"], None, day(0), "x")
    assert [r.outcome_id for r in delivery.surplus(spark.createDataFrame([row, row, row], OUT), *MESSAGE).collect()] == [7, 7]
    assert delivery.surplus(spark.createDataFrame([], OUT), *MESSAGE).count() == 0


def test_admit_drops_stored_messages(spark):
    stored = spark.createDataFrame([(1, H["a"], H["b"], None, day(0), "x")], OUT)
    batch = spark.createDataFrame([(2, H["a"].upper(), H["b"], None, day(1), "x"), (3, H["a"], H["c"], None, day(1), "x"), (4, H["a"], H["c"], None, day(2), "x"), (5, None, H["c"], None, day(2), "x")], OUT)
    got = delivery.admit(stored, batch, *MESSAGE)
    assert sorted(r.outcome_id for r in got.collect()) == [3, 5] and got.columns == batch.columns


def test_orphans_of_empty_tables(spark):
    state = orphans.advance(None, _refs(spark, []), _parents(spark, []), KIND)
    assert orphans.orphans_at_birth(state).count() == 0
    state = orphans.advance(None, _refs(spark, [(1, H["a"], None, "", 0)]), _parents(spark, [(H["a"], None, None, 0)]), KIND)
    assert orphans.orphans_at_birth(state).count() == 1
