"""References to records that do not exist at the time they are made.

State is keyed by the referenced identifier and consists of three kinds of table:

* facts about the parents, ``(kind, key, from, to, n)``: ``n`` records loaded at ``from``
  (an open ``to``), or ``n`` records loaded at ``from`` and deleted at ``to``. Facts are
  added up and never overwritten, so their order doesn't matter and a deletion ends
  exactly one of several records that were loaded at the same time;
* the pending orphans: references without a record at their time;
* the sound references, in parts that are only added to, one per batch, each in
  the order of its keys. They are read only where a batch ends a record.

``advance`` takes the next batch: its references and the pending orphans probe
the parent index, so that loads resolve those that wait for them (a late
record that was loaded before the reference was made makes it a sound one); its
deletions probe the sound references of the same keys and reopen them. Sound
references that no deletion of the batch concerns are not joined again. Batches
may come in any order: the state is that of one batch with the same rows.

``spells`` turns the state into the spans in which a reference is pending, and
``snapshot_counts`` counts those at the end of each period.

Defined cases: a NULL or blank identifier refers to nothing and is no
reference; a reference without a time is pending from the start of time and
a parent without ``loaded_at`` never existed; empty tables give empty results;
repeated parents count once; every reference row counts, also a repeated one;
other columns of the inputs are never read, so their names may clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.identity import digest_key
from marlstone.operators.skew import hot_keys, replicated, salted
from marlstone.session import materialize

FOREVER = 2**63 - 1
SALTS = 32


def _micros(column: Column) -> Column:
    return F.unix_micros(column)


def reference_rows(df: DataFrame, table: str, field: str, row_id: str, at: Column) -> DataFrame:
    """References of one field as (ref_table, ref_field, ref_id, key, at)."""
    return df.select(
        F.lit(table).alias("ref_table"),
        F.lit(field).alias("ref_field"),
        F.col(row_id).cast("long").alias("ref_id"),
        digest_key(F.col(field)).alias("key"),
        F.coalesce(_micros(at.cast("timestamp")), F.lit(-FOREVER - 1)).alias("at"),
    ).filter(F.col("key").isNotNull())


def parent_facts(df: DataFrame, field: str, kind: str) -> DataFrame:
    """Facts (kind, key, from, to, n, known) of records: one of each load, and one of each deletion; known is when it happened."""
    start, end = _micros(F.col("loaded_at").cast("timestamp")), _micros(F.col("deleted_at").cast("timestamp"))
    load = F.struct(F.lit(FOREVER).alias("to"), start.alias("known"))
    deletion = F.struct(end.alias("to"), end.alias("known"))
    rows = df.select(F.lit(kind).alias("kind"), digest_key(F.col(field)).alias("key"), start.alias("from"), F.explode(F.when(end.isNull(), F.array(load)).otherwise(F.array(load, deletion))).alias("f"))
    return rows.filter(F.col("key").isNotNull() & F.col("from").isNotNull()).select("kind", "key", "from", "f.to", F.lit(1).cast("long").alias("n"), "f.known")


def _union_spans(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones made one."""

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))
        return (
            F.when(F.size(acc) == 0, F.array(s))
            .when(s["from"] <= last["to"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
            .otherwise(F.concat(acc, F.array(s)))
        )

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def parent_index(facts: DataFrame) -> DataFrame:
    """(kind, key, spans) of facts: disjoint sorted spans in which some record exists.

    Records of one start are counted before the starts of a key are gathered; a start stays open while it has more loads than deletions.
    """
    open_end = F.col("to") == FOREVER
    loads, ends = F.sum(F.when(open_end, F.col("n")).otherwise(0)), F.sum(F.when(open_end, 0).otherwise(F.col("n")))
    to = F.when(loads > ends, FOREVER).otherwise(F.max(F.when(~open_end, F.col("to"))))
    once = facts.groupBy("kind", "key", "from").agg(to.alias("to")).filter(F.col("from") < F.col("to"))
    return once.groupBy("kind", "key").agg(_union_spans(F.collect_list(F.struct("from", "to"))).alias("spans"))


@dataclass
class OrphanState:
    """Keyed state between batches; every table is written in the shared folder."""

    facts: list[DataFrame]  # a part per batch
    pending: DataFrame  # with ``known``: it is in a sound part too
    sound: list[DataFrame] = field(default_factory=list)  # a part per batch
    hot: frozenset = frozenset()  # identifiers that were hot in a batch, at most 256 of each


_REF = ["ref_table", "ref_field", "ref_id", "kind", "key", "at"]


def _covered(spans: Column, at: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda s: (s["from"] <= at) & (at < s["to"])), F.lit(False))


def _lookup(refs: DataFrame, index: DataFrame, hot: list, salts: int) -> DataFrame:
    """refs with the spans of their parent (NULL: no such record in the index).

    A hot identifier is spread over ``salts`` tasks and its one index row is repeated for each.
    """
    left = salted(refs, "key", hot, salts, F.struct("ref_table", "ref_id"))
    return left.join(replicated(index, "key", hot, salts), ["kind", "key", "_salt"], "left").drop("_salt")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def advance(state: OrphanState | None, references: DataFrame, facts: DataFrame, kind_of: dict[str, str], salts: int = SALTS, rows: int | None = None) -> OrphanState:
    """The state after a batch of references and of facts about parents.

    kind_of names the kind of record that each field refers to. Where at most ``rows`` references
    are known to come, few enough for one task, hot identifiers are not counted.
    """
    kind = F.create_map(*[F.lit(x) for pair in kind_of.items() for x in pair])
    fresh = references.select("ref_table", "ref_field", "ref_id", kind[F.col("ref_field")].alias("kind"), "key", "at")
    hot = frozenset(bytes(k) for k in hot_keys(fresh, "key", rows=rows)) | (state.hot if state else frozenset())
    came = materialize(facts.select("kind", "key", "from", "to", "n"))
    parts = [*(state.facts if state else []), came]
    to_probe = fresh.withColumn("known", F.lit(False))
    if state is not None:
        ended = came.filter(F.col("to") < FOREVER).select("kind", "key").distinct()
        # references of one key and time are sound or pending together
        waiting = state.pending.filter("known").select("kind", "key", "at").distinct()
        reopened = _all(state.sound).join(ended, ["kind", "key"], "left_semi").join(waiting, ["kind", "key", "at"], "left_anti")
        to_probe = to_probe.unionByName(state.pending).unionByName(reopened.withColumn("known", F.lit(True)))
    probed = _lookup(to_probe, parent_index(_all(parts)), sorted(hot), salts)
    done = materialize(probed.select(*_REF, "known", _covered(F.col("spans"), F.col("at")).alias("covered")).sortWithinPartitions("covered", "kind", "key"), ["covered"])
    settled = done.filter("covered and not known").select(*_REF)
    return OrphanState(parts, done.filter("not covered").select(*_REF, "known"), [*(state.sound if state else []), settled], hot)


def references_of(state: OrphanState) -> DataFrame:
    """Every reference of the state once."""
    return _all([*state.sound, state.pending.filter("not known").select(*_REF)])


def probe(state: OrphanState, salts: int = SALTS) -> DataFrame:
    """Every reference with the spans of its parent, for the history of all periods."""
    return _lookup(references_of(state), parent_index(_all(state.facts)), sorted(state.hot), salts)


def orphans_at_birth(state: OrphanState) -> DataFrame:
    """References whose record doesn't exist at the time they are made: the pending ones."""
    return state.pending.select("ref_table", "ref_field", "ref_id", "at", "key")


def spells(probed: DataFrame) -> DataFrame:
    """Pending spans [from, to) of each reference from the time it is made on.

    The first one that starts at ``at`` is an orphan at birth; later ones are
    reopened by a deletion. The end is the largest time while it is pending.
    """
    at = F.col("at")
    alive = F.coalesce(F.filter(F.col("spans"), lambda s: s["to"] > at), F.array().cast("array<struct<from:bigint,to:bigint>>"))
    starts = F.concat(F.array(at), F.transform(alive, lambda s: s["to"]))
    ends = F.concat(F.transform(alive, lambda s: s["from"]), F.array(F.lit(FOREVER)))
    pairs = F.filter(F.arrays_zip(starts.alias("from"), ends.alias("to")), lambda p: p["from"] < p["to"])
    return probed.select("ref_table", "ref_field", "ref_id", F.explode(pairs).alias("p"), at.alias("_at")).select(
        "ref_table", "ref_field", "ref_id", F.col("p.from").alias("from"), F.col("p.to").alias("to"), (F.col("p.from") > F.col("_at")).alias("reopened")
    )


def snapshot_counts(pending: DataFrame, period: str = "month") -> DataFrame:
    """Per table, field and period: orphans that opened, were reopened, were resolved, and wait at the period's end.

    Changes are pre-aggregated to one row per period before the running sum,
    so a window holds at most the periods of one field.
    """

    def changes(time: str, opened: int, reopened: Column, resolved: int) -> DataFrame:
        return pending.filter((F.col(time) > -(2**63)) & (F.col(time) < FOREVER)).select(
            "ref_table",
            "ref_field",
            F.date_trunc(period, F.timestamp_micros(time)).alias("period"),
            F.lit(opened).alias("opened"),
            reopened.alias("reopened"),
            F.lit(resolved).alias("resolved"),
        )

    from pyspark.sql import Window

    both = changes("from", 1, F.col("reopened").cast("int"), 0).unionByName(changes("to", 0, F.lit(0), 1))
    sums = both.groupBy("ref_table", "ref_field", "period").agg(*[F.sum(c).alias(c) for c in ("opened", "reopened", "resolved")])
    run = Window.partitionBy("ref_table", "ref_field").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("waiting", F.sum(F.col("opened") - F.col("resolved")).over(run))
