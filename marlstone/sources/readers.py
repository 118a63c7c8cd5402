"""Readers of repositories, logs, diffs, ledgers and tool reports into the engine's tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.session import ship_package


def repository(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """Files below root: path relative to it, size, mtime, content and its hash."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = f"^(?:file:)?/*{re.escape(root.rstrip('/').lstrip('/'))}/"
    out = raw.select(F.regexp_replace("path", prefix, "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", F.sha2("content", 256).alias("sha256"))
    return out.filter(~paths.excluded(F.col("path"), excludes or [".git", "vendor", "node_modules"]))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two stamps tables with path, size, mtime."""
    a, b = before.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1")), after.select("path", F.col("size").alias("s2"), F.col("mtime").alias("m2"))
    both = a.join(b, "path", "full_outer")
    kind = F.when(F.col("s1").isNull(), "added").when(F.col("s2").isNull(), "removed").when((F.col("s1") != F.col("s2")) | (F.col("m1") != F.col("m2")), "changed")
    return both.select("path", kind.alias("change")).filter("change is not null")


def instructions(files: DataFrame) -> DataFrame:
    """Guidance files by their base name."""
    return files.filter(paths.base(F.col("path")).isin("AGENTS.md", "CLAUDE.md")).select("path").orderBy("path")


def change_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, touched) of a log whose records start with a line of hash, time and subject split by 0x1F; files follow.

    Records are split by the reader at 0x1E, so a large log is read in parts.
    """
    records = spark.read.option("lineSep", "\x1e").text(path).filter(F.trim("value") != "")
    lines = records.select(F.filter(F.transform(F.split("value", "\n"), lambda s: F.trim(s)), lambda s: s != "").alias("l"))
    head = F.split(F.get("l", F.lit(0)), "\x1f")
    commits = lines.select(F.get(head, F.lit(0)).alias("hash"), F.try_to_timestamp(F.get(head, F.lit(1))).alias("ts"), F.get(head, F.lit(2)).alias("subject"), F.slice("l", 2, 1_000_000).alias("rows"))
    stat = F.explode("rows").alias("row")
    parts = F.split("row", "\t")
    plain = commits.select("hash", stat)
    touched = plain.select(
        "hash",
        F.element_at(parts, -1).alias("path"),
        F.when(F.size(parts) == 3, F.coalesce(F.get(parts, F.lit(0)).try_cast("int"), F.lit(0)) + F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))).otherwise(0).alias("churn"),
    )
    return commits.drop("rows"), touched


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def unquote(path: str) -> str:
    """Path of a diff header; a quoted one has C escapes and octal bytes."""
    if not (len(path) >= 2 and path[0] == path[-1] == '"'):
        return path
    out, i, body = bytearray(), 0, path[1:-1]
    simple = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, '"': 34}
    while i < len(body):
        if body[i] != "\\" or i + 1 >= len(body):
            out += body[i].encode()
            i += 1
        elif body[i + 1 : i + 4].isdigit() and len(body[i + 1 : i + 4]) == 3:
            out.append(int(body[i + 1 : i + 4], 8) & 255)
            i += 4
        else:
            out.append(simple.get(body[i + 1], ord(body[i + 1]) & 255))
            i += 2
    return out.decode("utf-8", "replace")


def parse_diff(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(path, status, side, start, end) of every hunk side of a unified diff, lines half-open; a file without hunks has one row of zeros."""
    old = new = ""
    rows: list[tuple[str, str, str, int, int]] = []
    seen = False

    def path_of(header: str, prefix: str) -> str:
        name = unquote(header.split("\t")[0].strip())
        return "" if name == "/dev/null" else name.removeprefix(prefix)

    def flush() -> Iterator[tuple[str, str, str, int, int]]:
        if old or new:
            status = "added" if not old else "removed" if not new else "renamed" if old != new else "modified"
            for _, _, side, a, b in rows or [("", "", "new", 0, 0)]:
                yield (new or old), status, side, a, b

    for line in text.split("\n"):
        if line.startswith("diff --git "):
            yield from flush()
            old = new = ""
            rows, seen = [], False
        elif line.startswith("--- ") and not seen:
            old = path_of(line[4:], "a/")
        elif line.startswith("+++ ") and not seen:
            new = path_of(line[4:], "b/")
        elif m := _HUNK.match(line):
            seen = True
            a, n, b, k = int(m[1]), int(m[2] if m[2] is not None else 1), int(m[3]), int(m[4] if m[4] is not None else 1)
            if n:
                rows.append(("", "", "old", a, a + n))
            if k:
                rows.append(("", "", "new", b, b + k))
    yield from flush()


def hunks(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, status, side, start, end) of a column of unified diffs."""
    ship_package(diffs.sparkSession)
    kind = dict(diffs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *h) for k, t in zip(b["key"].tolist(), b["text"]) if t for h in parse_diff(t)]
            yield pd.DataFrame(rows, columns=["key", "path", "status", "side", "start", "end"])

    return diffs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, path string, status string, side string, start int, end int").withColumnRenamed("key", key)


def gold_paths(patch: Column) -> Column:
    """Sorted paths that a patch writes, or deletes."""
    added = F.filter(F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1)), lambda p: p != "")
    gone = F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(.+)\n\+\+\+ /dev/null"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(added, gone)))


INSTANCE = "instance_id string, repo string, base_commit string, problem_statement string, patch string"


def instances(spark: SparkSession, path: str, repo: str | None = None, limit: int = 0) -> DataFrame:
    """Benchmark instances with ``error``: malformed, unknown field or empty field; the limit counts after the repository filter."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    wanted = [c.split()[0] for c in INSTANCE.split(", ")]
    keys = F.json_object_keys("value")
    parsed = F.from_json("value", INSTANCE)
    empty = F.lit(False)
    for c in wanted:
        empty = empty | (F.coalesce(F.trim(parsed[c]), F.lit("")) == "")
    error = F.when(keys.isNull(), "malformed").when(F.size(F.array_except(keys, F.array(*[F.lit(w) for w in wanted]))) > 0, "unknown field").when(empty, "empty field")
    out = raw.select(parsed.alias("r"), error.alias("error")).select("r.*", "error")
    out = out if repo is None else out.filter(F.col("repo") == repo)
    return out.orderBy("instance_id").limit(limit) if limit else out


def eval_case_errors(cases: DataFrame) -> DataFrame:
    """cases with ``errors``: the rules a held-out case breaks; of several with one id all are repeated."""
    ids = cases.filter(F.col("case_id").isNotNull()).groupBy(F.col("case_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    cases = cases.join(ids, F.col("case_id") == F.col("_id"), "left").drop("_id")
    repeated = F.col("_n") > 1
    checks = [
        F.when(F.coalesce(F.trim("case_id"), F.lit("")) == "", "case id is empty"),
        F.when(F.coalesce(F.trim("request"), F.lit("")) == "", "request is empty"),
        F.when(F.coalesce("token_budget", F.lit(0)) <= 0, "token budget is not positive"),
        F.when(F.coalesce(F.size("expected_paths"), F.lit(0)) <= 0, "nothing is expected"),
        F.when(~F.coalesce("classification", F.lit("")).isin("lexical", "non-lexical"), "unknown classification"),
        F.when(F.exists("expected_paths", lambda p: p.startswith("/") | p.contains("..")), "path leaves the repository"),
        F.when(repeated, "repeated"),
    ]
    return cases.withColumn("errors", F.array_compact(F.array(*checks))).drop("_n")


def ledger(spark: SparkSession, path: str, schema: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Records of a JSON-lines ledger with ``line`` (file order) and ``error``.

    A malformed or oversized line is an error; only the last line of a file may
    be cut short, which is the warning ``truncated``.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"), F.size(F.split("value", "\n")).alias("n"), F.input_file_name().alias("file"))
    last = F.col("line") == F.col("n") - 1
    bad = F.json_object_keys("value").isNull()
    error = F.when(F.octet_length("value") > most_bytes, "oversized").when(bad & last, "truncated").when(bad, "malformed")
    return lines.filter(F.trim("value") != "").select("file", "line", F.from_json("value", schema).alias("r"), error.alias("error")).select("file", "line", "r.*", "error")


RUN = (
    "schema string, timestamp timestamp, run_type string, repo_path string, repo_head string, strategy_id string, branch string, provider string, model string, fee_earned double, success boolean, outcome string, reason string, "
    "dry_run boolean, lines_added int, lines_deleted int, net_line_reduction int, symbols_added int, symbols_deleted int, symbols_modified int, net_symbol_reduction int, structural_metrics boolean, changed_files array<string>, "
    "baseline_coverage double, final_coverage double, already_sufficient boolean"
)
SAVINGS = "ts bigint, root string, goal string, targets int, packet_chars int, file_chars int"


def run_history(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """Recorded runs in file order with ``seq`` within their file; lines that are no record are left out, a repository selects its own."""
    runs = ledger(spark, path, RUN).filter("error is null").drop("error").withColumnRenamed("line", "seq")
    return runs.filter(F.col("repo_path") == repo) if repo is not None else runs


def savings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded packet sizes with the characters and tokens each saved against whole files; a saving below 0 counts as 0."""
    rows = ledger(spark, path, SAVINGS).filter("error is null").drop("error")
    saved = F.greatest(F.lit(0), F.coalesce("file_chars", F.lit(0)) - F.coalesce("packet_chars", F.lit(0)))
    return rows.withColumn("saved_chars", saved).withColumn("saved_tokens", F.floor(saved / 4).cast("int"))


def coverage_profile(spark: SparkSession, path: str, module: str = "") -> DataFrame:
    """Blocks of a coverage profile: file without the module, package, lines, statements, hits; lines of another form have ``error``."""
    pattern = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter((F.col("value") != "") & ~F.col("value").startswith("mode:"))
    name = F.regexp_replace(F.regexp_extract("value", pattern, 1), f"^{re.escape(module)}/" if module else "^$", "")
    number = lambda i: F.regexp_extract("value", pattern, i).try_cast("int")
    return lines.select(
        name.alias("file"), paths.directory(name).alias("package"), number(2).alias("start_line"), number(4).alias("end_line"), number(6).alias("statements"), number(7).alias("hits"), F.when(~F.col("value").rlike(pattern), "malformed").alias("error")
    )


def repomix(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a packed repository in JSON (object of files) or XML (file elements); contents stay text."""
    if path.endswith(".xml"):
        return spark.read.format("xml").option("rowTag", "file").schema("_path string, _VALUE string").load(path).select(F.col("_path").alias("path"), F.coalesce("_VALUE", F.lit("")).alias("content"))
    whole = spark.read.text(path, wholetext=True)
    files = F.from_json(F.get_json_object("value", "$.files"), "map<string,string>")
    return whole.select(F.explode(files).alias("path", "content"))


def clone_report(spark: SparkSession, path: str) -> DataFrame:
    """Duplicates of a clone detector's JSON report in their order."""
    side = "struct<name:string,start:int,end:int>"
    schema = f"duplicates array<struct<format:string,kind:string,lines:int,tokens:int,isNew:boolean,firstFile:{side},secondFile:{side}>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    return whole.select(F.posexplode("r.duplicates").alias("ordinal", "d")).select(
        "ordinal", "d.format", "d.kind", "d.lines", "d.tokens", F.col("d.isNew").alias("is_new"), F.col("d.firstFile.name").alias("first_file_name"), F.col("d.firstFile.start").alias("first_file_start"), F.col("d.firstFile.end").alias("first_file_end"),
        F.col("d.secondFile.name").alias("second_file_name"), F.col("d.secondFile.start").alias("second_file_start"), F.col("d.secondFile.end").alias("second_file_end"),
    )


def match_report(spark: SparkSession, path: str) -> DataFrame:
    """Matches of a structural search's JSON array in their order."""
    spot = "struct<line:int,column:int>"
    schema = f"array<struct<file:string,text:string,ruleId:string,severity:string,range:struct<start:{spot},end:{spot}>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    return whole.select(F.posexplode("r").alias("ordinal", "m")).select("ordinal", F.col("m.file").alias("path"), F.col("m.ruleId").alias("rule"), "m.severity", F.col("m.range.start.line").alias("start_line"), F.col("m.range.end.line").alias("end_line"), "m.text")
