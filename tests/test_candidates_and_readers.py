"""Requests, their candidates and owners; find queries; bodies; reference graph; recorded runs and savings."""

import json
import shlex

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import declarations, duplicates, graphs, resolution, tasks
from marlstone.sources import readers


def test_identifiers_that_a_request_names(spark):
    rows = [("a", "Fix `run` in parseHTTP and Loader, not the Code"), ("b", "Loader"), ("c", "pkg.Name(x) is snake_case"), ("d", None), ("e", "")]
    got = {}
    for r in tasks.goal_identifiers(spark.createDataFrame(rows, "key string, request string"), "key", "request").collect():
        got.setdefault(r.key, set()).add(r.name)
    assert got == {"a": {"parsehttp"}, "b": {"loader"}, "c": {"snake_case"}}


def test_evidence_owners_order_and_fallback(spark):
    files = spark.createDataFrame([("pkg/cache/cache.go", "go", "package cache\n"), ("cmd/main.go", "go", "package main\n"), ("x_test.go", "go", "package x\n"), ("z.py", "python", "")], "path string, language string, content string")
    symbols = spark.createDataFrame([("pkg/cache/cache.go", 1, "EvictAll", "func EvictAll(n int)")], "path string, line int, name string, signature string")
    edges = spark.createDataFrame([("cmd/main.go", "go", "m/pkg/store")], "path string, language string, module string")
    requests = spark.createDataFrame([("words", "evict the cache"), ("bare", "EvictAll"), ("lost", "zzzz")], "key string, request string")
    hit = tasks.evidence(tasks.goal_terms(requests, "key", "request"), tasks.evidence_parts(files, symbols, edges))
    got = {(r.key, r.path): r.relevance for r in hit.collect()}
    # evict: symbol 8, signature by its parts 4; cache: path twice as one value 8, package 5
    assert got[("words", "pkg/cache/cache.go")] == 8 + 4 // 2 + 8 + 5
    assert ("words", "cmd/main.go") not in got
    importing = spark.createDataFrame([("cmd/main.go", "pkg/cache/cache.go"), ("x_test.go", "pkg/cache/cache.go")], "path string, seed string")
    calling = spark.createDataFrame([("cmd/main.go", "pkg/cache/cache.go"), ("z.py", "pkg/cache/cache.go")], "path string, seed string")
    owned = tasks.with_owners(hit, importing, calling)
    rel = {(r.key, r.path): r.relevance for r in owned.collect()}
    assert rel[("words", "cmd/main.go")] == 6 and rel[("words", "z.py")] == 4 and ("words", "x_test.go") not in rel
    scores = spark.createDataFrame([("pkg/cache/cache.go", 1), ("cmd/main.go", 9), ("x_test.go", 0), ("z.py", 5)], "path string, score long")
    exact = spark.createDataFrame([("bare", "z.py", 1)], "key string, path string, exact long")
    out = {}
    for r in tasks.candidates(owned, exact, scores, requests, 2).orderBy("rank").collect():
        out.setdefault(r.key, []).append(r.path)
    assert out["words"] == ["pkg/cache/cache.go", "cmd/main.go"] and out["bare"] == ["z.py", "pkg/cache/cache.go"] and out["lost"] == ["cmd/main.go", "z.py"]
    found = owned.filter("key = 'words'").select("path", F.lit(0).alias("exact"), "relevance")
    assert [r.path for r in tasks.order_for_goal(scores, found).collect()] == ["pkg/cache/cache.go", "cmd/main.go", "z.py", "x_test.go"]


def test_find_query_grammar(spark):
    assert declarations.parse_query("kind:func:file:cmd/main.go:main") == ("main", "func", "cmd/main.go")
    assert declarations.parse_query("file:a:b::c") == ("b::c", "", "a") and declarations.parse_query("symbol:a:b") == ("symbol:a:b", "", "")
    assert declarations.parse_query("  ") == ("", "", "") and declarations.parse_query("kind:func") == ("", "func", "")
    df = spark.createDataFrame([("a/x.go", 1, "Run", "function"), ("b/x.go", 2, "run", "method"), ("b/y.go", 3, "Runner", "function")], "path string, line int, name string, kind string")
    assert [(r.name, r.score) for r in declarations.find(df, "run").collect()] == [("run", 100), ("Run", 75), ("Runner", 25)]
    assert [r.name for r in declarations.find(df, "kind:FUNCTION:run", file="b/").collect()] == ["Runner"] and declarations.find(df, "kind:function").count() == 0


def test_go_bodies_leave_out_short_ones_tests_and_layout(spark):
    body = "".join(f"\ta{i} := b{i}(x)\n\tuse(a{i})\n" for i in range(5))
    rows = [("a/a.go", f"package a\n\nfunc F(x int) {{\n{body}}}\n"), ("b/b.go", f"package b\nfunc (t T) G(x int) {{\n\n{body.replace('(x)', '(x) ')}}}\n\nfunc s() {{\n\tx()\n}}\n"), ("a/a_test.go", f"func F() {{\n{body}}}\n"), ("n.go", None)]
    files = spark.createDataFrame([(p, "go", False, c) for p, c in rows], "path string, language string, generated boolean, content string")
    got = sorted((r.path, r.line, r.kind, r.body_hash) for r in duplicates.go_bodies(files).collect())
    assert [g[:3] for g in got] == [("a/a.go", 3, "function"), ("b/b.go", 2, "method")] and got[0][3] == got[1][3]


def test_reference_ranks_follow_resolved_imports(spark):
    resolved = spark.createDataFrame([("a.ts", "f", "c.ts"), ("b.ts", "f", "c.ts"), ("b.ts", "g", "c.ts"), ("c.ts", "h", "d.ts"), ("a.ts", "x", None), ("a.ts", "s", "a.ts")], "path string, symbol string, target string")
    symbols = spark.createDataFrame([("f",), ("f",), ("g",), ("h",)], "name string")
    edges = {(r.src, r.dst): round(r.weight, 6) for r in resolution.reference_edges(resolved, symbols).collect()}
    assert edges == {("a.ts", "c.ts"): round(0.5**0.5, 6), ("b.ts", "c.ts"): 1.0, ("c.ts", "d.ts"): 1.0}
    df = resolution.reference_edges(resolved, symbols)
    bonus = {r.node: r.bonus for r in graphs.rank_bonus(df, graphs.pagerank(df)).collect()}
    assert max(bonus.values()) == 30 and set(bonus) == {"c.ts", "d.ts"}
    empty = df.filter("src = ''")
    assert graphs.rank_bonus(empty, graphs.pagerank(empty)).count() == 0


def test_recorded_runs_and_savings(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text("\n".join([json.dumps({"repo_path": "r", "success": True, "outcome": "ok", "lines_deleted": 3}), "{broken", "", json.dumps({"repo_path": "s", "outcome": "no"}), '{"repo_pa']))
    assert [(r.seq, r.outcome) for r in readers.run_history(spark, str(tmp_path / "runs.jsonl")).orderBy("seq").collect()] == [(0, "ok"), (3, "no")]
    assert [r.lines_deleted for r in readers.run_history(spark, str(tmp_path / "runs.jsonl"), "r").collect()] == [3]
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"ts": i, "root": "r", "goal": "g", "targets": 1, "packet_chars": p, "file_chars": f}) for i, (p, f) in enumerate([(400, 1000), (900, 500)])))
    assert [(r.saved_chars, r.saved_tokens) for r in readers.savings(spark, str(tmp_path / "s.jsonl")).orderBy("ts").collect()] == [(600, 150), (0, 0)]


def test_shell_words(spark):
    words = ["plain", "a b", "it's", "", "$x", "a/b.c", "x\ny"]
    got = [r.q for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(text.shell_quoted(F.col("w")).alias("q")).collect()]
    assert [shlex.split(q) for q in got] == [[w] for w in words] and got[0] == "plain"
