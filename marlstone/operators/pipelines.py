"""Pipelines of phases and stores: kinds, blast radius, drift against the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Name fragment and kind of a phase, first match wins.
KINDS = [
    ("main", "Boot"), ("cmd", "Boot"), ("cli", "Boot"), ("boot", "Boot"), ("commands", "Route"), ("command", "Route"), ("dispatch", "Route"), ("route", "Route"),
    ("spec", "Parse"), ("schema", "Parse"), ("model", "Parse"), ("parse", "Parse"), ("load", "Parse"), ("validate", "Check"), ("valid", "Check"), ("check", "Check"), ("lint", "Check"),
    ("render", "Render"), ("template", "Render"), ("templates", "Render"), ("view", "Render"), ("html", "Render"), ("watch", "Watch"), ("watcher", "Watch"), ("fsnotify", "Watch"), ("notify", "Watch"),
    ("serve", "Serve"), ("server", "Serve"), ("http", "Serve"), ("handler", "Serve"), ("route", "Serve"), ("routes", "Serve"), ("emit", "Emit"), ("output", "Emit"),
    ("review", "Analyze"), ("scan", "Analyze"), ("analyze", "Analyze"), ("inspect", "Analyze"),
]


def phase_kind(base, table: list[tuple[str, str]] | None = None):
    """Kind of a package by the first fragment its base name starts with."""
    lower = F.lower(base)
    return F.coalesce(*[F.when(lower.startswith(m), F.lit(k)) for m, k in table or KINDS], F.lit("Unknown"))


def explode_spec(spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phases, stores) of nested documents with commands[name, phases[name, stages[label, file], reads[], writes[]]]."""
    commands = spec.select(F.explode("commands").alias("c"))
    phases = commands.select(F.col("c.name").alias("command"), F.posexplode("c.phases").alias("ordinal", "p"))
    flat = phases.select("command", "ordinal", F.col("p.name").alias("phase"), F.col("p.stages.file").alias("files"), F.col("p.reads").alias("reads"), F.col("p.writes").alias("writes"))
    stores = flat.select("command", "ordinal", "phase", F.explode(F.array_distinct(F.concat("reads", "writes"))).alias("store"), "reads", "writes")
    return flat, stores.select("command", "ordinal", "phase", "store", F.array_contains("reads", F.col("store")).alias("reads"), F.array_contains("writes", F.col("store")).alias("writes"))


def blast(phases: DataFrame, stores: DataFrame, files: list[str]) -> tuple[DataFrame, str]:
    """(affected phases with reason, severity) of changed files.

    Direct phases have a changed file; downstream ones follow a direct phase in
    its command or read a store that an affected phase writes, one step. The
    table of phases is a document, so the severity is worked out from its counts.
    """
    changed = F.array(*[F.lit(f) for f in files])
    direct = phases.filter(F.arrays_overlap("files", changed)).select("command", "ordinal", "phase")
    first = direct.groupBy("command").agg(F.min("ordinal").alias("from"))
    later = phases.join(first, "command").filter(F.col("ordinal") > F.col("from")).select("command", "ordinal", "phase").join(direct, ["command", "ordinal"], "left_anti")
    touched = direct.unionByName(later)
    written = stores.filter("writes").join(direct, ["command", "ordinal", "phase"], "left_semi").select("store").distinct()
    readers = stores.filter("reads").join(written, "store", "left_semi").select("command", "ordinal", "phase").distinct().join(touched, ["command", "ordinal"], "left_anti")
    every = direct.withColumn("reason", F.lit("direct")).unionByName(later.withColumn("reason", F.lit("downstream-flow"))).unionByName(readers.withColumn("reason", F.lit("store-reader")))
    n, commands, total, kept = every.count(), every.select("command").distinct().count(), phases.count(), written.count()
    severity = "none" if not n else "isolated" if n == 1 else "critical" if n / total >= 0.75 else "high" if commands > 1 or kept else "moderate"
    return every.withColumn("position", F.row_number().over(Window.partitionBy("command").orderBy("ordinal"))), severity


def spec_drift(phases: DataFrame, files: DataFrame) -> DataFrame:
    """(issue, severity, subject): stage files that don't exist, phases without any, files no phase has."""
    named = phases.select("phase", F.explode("files").alias("path"))
    missing = named.join(files.select("path"), "path", "left_anti").select(F.lit("missing-file").alias("issue"), F.lit("high").alias("severity"), F.col("path").alias("subject"))
    alive = named.join(files.select("path"), "path", "left_semi").select("phase").distinct()
    orphan = phases.select("phase").distinct().join(alive, "phase", "left_anti").select(F.lit("orphan-phase").alias("issue"), F.lit("medium").alias("severity"), F.col("phase").alias("subject"))
    gap = files.select("path").join(named.select("path"), "path", "left_anti").select(F.lit("uncovered-file").alias("issue"), F.lit("low").alias("severity"), F.col("path").alias("subject"))
    return missing.unionByName(orphan).unionByName(gap)
