"""Readers and writers on small files; diffs, resolution, tasks, pipelines and guards by hand."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import diffs, guards, pipelines, resolution, tasks
from marlstone.sources import readers, writers

DIFF = """diff --git a/old.py b/new.py
--- a/old.py
+++ b/new.py
@@ -1,2 +1,3 @@
-a
+b
@@ -9 +10,0 @@
-z
diff --git a/gone.go b/gone.go
--- a/gone.go
+++ /dev/null
@@ -1,4 +0,0 @@
diff --git "a/\\303\\251.go" "b/\\303\\251.go"
--- /dev/null
+++ "b/\\303\\251.go"
@@ -0,0 +1,2 @@
"""


def test_parse_diff(spark):
    got = list(readers.parse_diff(DIFF))
    assert got == [
        ("new.py", "renamed", "old", 1, 3), ("new.py", "renamed", "new", 1, 4), ("new.py", "renamed", "old", 9, 10),
        ("gone.go", "removed", "old", 1, 5), ("é.go", "added", "new", 1, 3),
    ]
    df = readers.hunks(spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "id int, t string"), "id", "t")
    assert df.count() == 5 and df.columns[0] == "id"


def test_gold_paths(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@\n--- a/y.py\n+++ /dev/null\n--- /dev/null\n+++ b/a.py\n"
    assert spark.createDataFrame([(patch,)], "p string").select(readers.gold_paths(F.col("p")).alias("g")).first().g == ["a.py", "x.py", "y.py"]


def test_repository_and_changes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "src" / "a.go").write_text("package a\n")
    (tmp_path / "vendor" / "b.go").write_text("x")
    (tmp_path / "AGENTS.md").write_text("hi")
    files = readers.repository(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"src/a.go", "AGENTS.md"}
    assert [r.path for r in readers.instructions(files).collect()] == ["AGENTS.md"]
    after = files.filter("path <> 'AGENTS.md'").withColumn("size", F.col("size") + 1)
    assert {(r.path, r.change) for r in readers.changed(files, after).collect()} == {("src/a.go", "changed"), ("AGENTS.md", "removed")}


def test_change_log(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("\x1eh1\x1f2025-01-01T00:00:00Z\x1ffix it\n\n3\t4\ta.go\n-\t-\tb.bin\n\x1eh2\x1f\x1fother\nc.go\n")
    commits, touched = readers.change_log(spark, str(log))
    assert {(r.hash, r.subject, r.ts is None) for r in commits.collect()} == {("h1", "fix it", False), ("h2", "other", True)}
    assert {(r.hash, r.path, r.churn) for r in touched.collect()} == {("h1", "a.go", 7), ("h1", "b.bin", 0), ("h2", "c.go", 0)}


def test_ledger_errors(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    path.write_text('{"a": 1}\nnope\n\n{"a": 2}\n{"a": 3')
    got = {r.line: (r.a, r.error) for r in readers.ledger(spark, str(path), "a int").collect()}
    assert got[0] == (1, None) and got[1][1] == "malformed" and got[3] == (2, None) and got[4][1] == "truncated" and 2 not in got


def test_instances(spark, tmp_path):
    path = tmp_path / "i.jsonl"
    base = {"instance_id": "1", "repo": "r", "base_commit": "c", "problem_statement": "p", "patch": "x"}
    path.write_text("\n".join([json.dumps(base), json.dumps(base | {"instance_id": "2", "extra": 1}), json.dumps(base | {"instance_id": "3", "patch": " "}), "{"]))
    assert [r.error for r in readers.instances(spark, str(path)).orderBy(F.col("instance_id").asc_nulls_last()).collect()] == [None, "unknown field", "empty field", "malformed"]
    assert readers.instances(spark, str(path), "r", 1).count() == 1


def test_coverage_profile(spark, tmp_path):
    path = tmp_path / "c.out"
    path.write_text("mode: set\nm/x/pkg/a.go:1.2,3.4 5 1\nm/x/main.go:1.1,2.2 2 0\nbad line\n")
    got = {r.file: r for r in readers.coverage_profile(spark, str(path), "m/x").collect()}
    assert (got["pkg/a.go"].package, got["pkg/a.go"].statements, got["pkg/a.go"].hits) == ("pkg", 5, 1) and got["main.go"].package == "." and got[""].error == "malformed"


def test_tool_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"files": {"a": "1e400 1234567890123456", "b": ""}}))
    assert {(r.path, r.content) for r in readers.repomix(spark, str(tmp_path / "r.json")).collect()} == {("a", "1e400 1234567890123456"), ("b", "")}
    (tmp_path / "r.xml").write_text('<repo><file path="a">x &lt; y</file><file path="b"></file></repo>')
    assert {(r.path, r.content) for r in readers.repomix(spark, str(tmp_path / "r.xml")).collect()} == {("a", "x < y"), ("b", "")}
    (tmp_path / "c.json").write_text(json.dumps({"duplicates": [{"format": "go", "lines": 3, "firstFile": {"name": "a", "start": 1, "end": 4}, "secondFile": {"name": "b", "start": 2, "end": 5}}]}))
    assert readers.clone_report(spark, str(tmp_path / "c.json")).first().second_file_name == "b"
    (tmp_path / "m.json").write_text(json.dumps([{"file": "a", "text": "t", "ruleId": "r", "range": {"start": {"line": 1, "column": 0}, "end": {"line": 2, "column": 3}}}]))
    assert readers.match_report(spark, str(tmp_path / "m.json")).first().end_line == 2


def test_eval_case_errors(spark):
    rows = [("c", "r", 1, ["a"], "lexical"), (" ", None, 0, [], "odd"), ("d", "r", 1, ["/a"], "lexical")]
    df = spark.createDataFrame(rows, "case_id string, request string, token_budget int, expected_paths array<string>, classification string")
    assert [len(r.errors) for r in readers.eval_case_errors(df).collect()] == [0, 5, 1]


def test_writers(spark, tmp_path):
    big = "x" * 50
    files = spark.createDataFrame([("a", big), ("b", big), ("c", "y"), ("d", "y"), ("e", "z")], "path string, content string")
    packed, shared = writers.dictionary(files)
    rows = {r.path: r for r in packed.collect()}
    entries = {r.ref: r.content for r in shared.collect()}
    assert entries == {0: big, 1: "y"} and {p: (r.content if r.ref is None else entries[r.ref]) for p, r in rows.items()} == dict(files.collect())
    assert json.loads(writers.envelope(files.limit(1), "file").first().value)["schema"] == writers.SCHEMA
    for _ in range(2):
        writers.append_ledger(files, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 10


SYM = "path string, line int, end int, name string, kind string, signature string"


def test_diff_overlay_and_moves(spark):
    before = spark.createDataFrame([("a.go", 1, 5, "F", "f", "s1"), ("a.go", 5, 9, "G", "f", "s"), ("a.go", 9, 12, "H", "f", "s"), ("a.go", 20, 22, "Same", "f", "s")], SYM)
    after = spark.createDataFrame([("a.go", 1, 5, "F", "f", "s2"), ("a.go", 5, 9, "G", "f", "s"), ("b.go", 1, 4, "H", "f", "s"), ("a.go", 20, 22, "Same", "f", "s")], SYM)
    hunks = spark.createDataFrame([("a.go", "new", 2, 6), ("a.go", "old", 2, 12), ("b.go", "new", 1, 2)], "path string, side string, start int, end int")
    changes = diffs.classify(before, after, hunks)
    assert {(r.path, r.name, r.change) for r in changes.collect()} == {("a.go", "F", "signature"), ("a.go", "G", "body"), ("a.go", "H", "removed"), ("b.go", "H", "added")}
    assert {(r.path, r.name, r.change, r.moved_from) for r in diffs.moves(changes).filter("name = 'H'").collect()} == {("b.go", "H", "moved", "a.go")}


def test_drift_and_upsert(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, None)], "k int, v string")
    assert {(r.k, r.side) for r in diffs.drift(a, b, ["k"]).collect()} == {(1, "left"), (3, "right")}
    assert {r.k: r.v for r in diffs.upsert(a, b, "k", ["v"]).collect()} == {1: "x", 2: "y", 3: None}
    assert {r.k: r.v for r in diffs.upsert(a, b, "k", []).collect()} == {1: "x", 2: "z", 3: None}


@pytest.mark.parametrize(("path", "want"), [("a/./b", "a/b"), ("a/../b", "b"), ("a/b/../../c", "c"), ("../x", None), ("a/../../x", None)])
def test_normal_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(resolution.normal_path(F.col("p")).alias("n")).first().n == want


def test_import_resolution(spark):
    lines = spark.createDataFrame([("src/a.ts", 1, "typescript", 'import { f, g as h } from "./b";'), ("src/a.ts", 2, "typescript", 'import { q } from "../lib/c.js";'), ("src/a.ts", 3, "typescript", 'import { r } from "pkg";')], "path string, number int, language string, text string")
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("lib/c.js",)], "path string")
    symbols = spark.createDataFrame([("src/b.ts", "f"), ("src/b.ts", "g"), ("lib/c.js", "q")], "path string, name string")
    got = {r.symbol: (r.target, r.reason) for r in resolution.resolve(resolution.bindings(lines), files, symbols).collect()}
    assert got == {"f": ("src/b.ts", None), "g": ("src/b.ts", None), "q": ("lib/c.js", None), "r": (None, "unresolved_target")}


def test_task_candidates_and_packing(spark):
    files = spark.createDataFrame([("src/parse_config.go", "unknown", ""), ("src/other.go", "unknown", "")], "path string, language string, content string")
    symbols = spark.createDataFrame([("src/other.go", "ConfigParser", "func ConfigParser()")], "path string, name string, signature string")
    requests = spark.createDataFrame([("q", "find parseConfig")], "key string, request string")
    edges = spark.createDataFrame([], "path string, language string, module string")
    hit = tasks.evidence(tasks.goal_terms(requests, "key", "request"), tasks.evidence_parts(files, symbols, edges))
    scores = files.selectExpr("path", "0L as score")
    found = tasks.candidates(hit, spark.createDataFrame([], "key string, path string, exact long"), scores, requests)
    got = {r.path: r.relevance for r in found.collect()}
    assert got["src/parse_config.go"] == 8 * 3 + 0 and got["src/other.go"] > 0
    costs = spark.createDataFrame([("src/parse_config.go", 50), ("src/other.go", 60)], "path string, tokens long")
    budget = spark.createDataFrame([("q", 100)], "key string, budget long")
    assert [(r.path, r.used) for r in tasks.pack(found, costs, budget).collect()] == [("src/parse_config.go", 50)]


SPEC = {"commands": [
    {"name": "run", "phases": [{"name": "load", "stages": [{"label": "l", "file": "a.go"}], "reads": [], "writes": ["db"]}, {"name": "show", "stages": [{"label": "s", "file": "b.go"}], "reads": ["db"], "writes": []}]},
    {"name": "serve", "phases": [{"name": "http", "stages": [{"label": "h", "file": "gone.go"}], "reads": ["db"], "writes": []}, {"name": "log", "stages": [], "reads": [], "writes": []}, {"name": "end", "stages": [], "reads": [], "writes": []}]},
]}


def test_blast_and_drift(spark):
    schema = "commands array<struct<name:string,phases:array<struct<name:string,stages:array<struct<label:string,file:string>>,reads:array<string>,writes:array<string>>>>>"
    spec = spark.createDataFrame([(json.dumps(SPEC),)], "v string").select(F.from_json("v", schema).alias("s")).select("s.*")
    phases, stores = pipelines.explode_spec(spec)
    hit, severity = pipelines.blast(phases, stores, ["a.go"])
    assert {(r.phase, r.reason) for r in hit.collect()} == {("load", "direct"), ("show", "downstream-flow"), ("http", "store-reader")} and severity == "high"
    assert pipelines.blast(phases, stores, ["zzz"])[1] == "none" and pipelines.blast(phases, stores, ["b.go"])[1] == "isolated"
    issues = {(r.issue, r.subject) for r in pipelines.spec_drift(phases, spark.createDataFrame([("a.go",), ("b.go",), ("new.go",)], "path string")).collect()}
    assert issues == {("missing-file", "gone.go"), ("orphan-phase", "http"), ("orphan-phase", "log"), ("orphan-phase", "end"), ("uncovered-file", "new.go")}


def test_guards(spark):
    rows = [("c", "x/.env.local", 1, b"a"), ("c", ".env.example", 1, b"a"), ("c", "bin/x", 10, b"\x7fELF1234"), ("c", "w", 99, b"a"), ("c", "a/.work/b", 1, None)]
    got = guards.outgoing(spark.createDataFrame(rows, "commit string, path string, size long, content binary"), 50)
    assert {(r.path, r.rule) for r in got.collect()} == {("x/.env.local", "environment-file"), ("bin/x", "executable-blob"), ("w", "oversized-blob"), ("a/.work/b", "private-work-directory")}


def test_phase_kinds(spark):
    df = spark.createDataFrame([("cmdline",), ("Renderer",), ("zzz",)], "b string").select(pipelines.phase_kind(F.col("b")).alias("k"))
    assert [r.k for r in df.collect()] == ["Boot", "Render", "Unknown"]
