"""Reference operators on small fixtures worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from marlstone import contract
from marlstone.functions import paths, text
from marlstone.operators import cleanup, declarations, duplicates, graphs, history, ledgers, linescan, ranking, retrieval, running


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_split_identifier(spark):
    assert one(spark, text.split_identifier, "parseHTTPConfig") == ["parsehttpconfig", "parse", "http", "config"]
    assert one(spark, text.split_identifier, "max_file_bytes") == ["max_file_bytes", "max", "file", "bytes"]
    assert one(spark, text.split_identifier, "run") == ["run"]


def test_terms_and_tokens(spark):
    assert one(spark, text.bm25_tokens, "für Parse_2") == ["f", "r", "parse_2"]
    assert one(spark, text.expand_terms, "fix the parseConfig and parse") == ["parseconfig", "parse", "config"]
    assert one(spark, text.token_estimate, "für") == 1
    assert one(spark, text.path_terms, "./src/fooBar/max_len.go") == ["src", "foobar", "foo", "bar", "max_len", "max", "len"]
    assert one(spark, text.excerpt, " a \n b ") == "a b"


@pytest.mark.parametrize(("path", "expected"), [
    ("a/b_test.go", "test"), ("vendor/x.go", "vendor"), ("a/x.gen.go", "generated"), ("docs/x.py", "docs"), ("testdata/x.py", "fixture"),
    ("examples/x.py", "example"), ("a/x.jsonl", "receipt/data"), ("a/x.py", "production"), ("a/x.bin", "unknown"), ("a/generated/vendor/x.py", "generated"),
])
def test_file_class(spark, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.file_class(F.col("p"), paths.language(F.col("p")), paths.generated(F.col("p"))).alias("c")).first().c == expected


def test_globs(spark):
    df = spark.createDataFrame([("src/a/b.ts",), ("src/b.ts",), ("x/src/b.ts",)], "p string")
    assert [r.m for r in df.select(paths.glob_match(F.col("p"), ["src/**/*.ts"]).alias("m")).collect()] == [True, True, False]


def test_match_part(spark):
    df = spark.createDataFrame([(["parse_config", "auth"],)], "p array<string>")
    score = lambda t: df.select(text.match_part(F.col("p"), F.lit(t), F.lit(4), F.lit(2)).alias("s")).first().s
    assert [score("parseconfig"), score("author"), score("au"), score("zzz")] == [4, 2, 0, 0]


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate("acb")] + [("m", 1, "x")], "query string, rank int, doc string")
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("m", "z")], "query string, doc string")
    got = {r.query: r for r in retrieval.metrics(ranked, gold).collect()}
    assert (got["q"].recall_at_1, got["q"].recall_at_5, got["q"].mrr) == (0.5, 1.0, 1.0)
    assert got["q"].ndcg_at_10 == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert (got["m"].mrr, got["m"].ndcg_at_10, got["m"].recall_at_20) == (0, 0, 0)


def test_bm25_keeps_documents_without_a_term(spark):
    docs = spark.createDataFrame([("b.go", "b"), ("a.go", "other words"), ("c.go", "more")], "doc string, text string")
    queries = spark.createDataFrame([("q", "b b")], "query string, request string")
    got = retrieval.bm25(docs, "doc", "text", queries, "query", "request", 3).orderBy("rank").collect()
    assert [r.doc for r in got] == ["b.go", "a.go", "c.go"] and got[0].score > 0 and got[1].score == 0


def test_graph_cases(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a"), ("a", "b")], "src string, dst string")
    parts = graphs.strong_components(e)
    assert {r.node: r.component for r in parts.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert {(r.component, r.nodes) for r in graphs.cycles(e, parts).collect()} == {("a", 3), ("d", 1)}
    hubs = graphs.hubs(e).collect()
    assert hubs[0].node == "a" and {r.node: (r.in_degree, r.out_degree) for r in hubs}["d"] == (1, 1)
    reach = graphs.reachable(e, spark.createDataFrame([("e",)], "node string"))
    assert {r.node: r.steps for r in reach.collect()} == {"e": 0, "a": 1, "b": 2, "c": 3}


def test_pagerank_against_plain_python(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("d", "c", 1.0), ("a", "e", 3.0)]
    nodes = sorted({x for e in edges for x in e[:2]})
    out = {n: sum(w for s, _, w in edges if s == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(40):
        loose = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (sum(rank[s] * w / out[s] for s, d, w in edges if d == n) + loose / len(nodes)) for n in nodes}
    got = {r.node: r.rank for r in graphs.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert got == pytest.approx(rank, abs=1e-6)


def test_importer_knee_and_suffix_join(spark):
    df = spark.createDataFrame([(8,), (9,), (20,)], "n int").select(graphs.import_score(F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == [80, 81, 92]
    names = spark.createDataFrame([("m/internal/a",), ("a",), ("xa",)], "name string")
    dirs = spark.createDataFrame([("a",), ("internal/a",)], "dir string")
    assert {r.name: r.target for r in graphs.suffix_join(names, "name", dirs, "dir").collect()} == {"m/internal/a": "internal/a", "a": "a"}


def _lines(spark, rows):
    return spark.createDataFrame(rows, "path string, repo string, language string, class string, number int, raw string").withColumn("text", text.trimmed(F.col("raw")))


def test_risk_decay_and_cap(spark):
    files = spark.createDataFrame([("password/credential.go",), ("b.go",)], "path string")
    lines = _lines(spark, [("b.go", "r", "go", "production", i, "panic(1)") for i in range(1, 6)])
    points = linescan.risk_points(files, lines)
    assert {(r.path, r.score) for r in linescan.risk_files(points).collect()} == {("password/credential.go", 18), ("b.go", 7)}


def test_bounded_reads_are_no_risk(spark):
    rows = ["b, err := io.ReadAll(io.LimitReader(r, 9))", "b, err := io.ReadAll(r)", "x(io.ReadAll(io.LimitReader(r, 9)), io.ReadAll(q))"]
    found = linescan.hits(_lines(spark, [("a.go", "r", "go", "production", i, t) for i, t in enumerate(rows)]), linescan.RISK)
    assert sorted(r.number for r in found.filter("kind = 'unbounded-read'").collect()) == [1, 2]


def test_symbols_and_orphans(spark):
    lines = _lines(spark, [
        ("a.go", "r", "go", "production", 1, "func Used(x int) int {"), ("a.go", "r", "go", "production", 2, "func Lost() {"), ("a.go", "r", "go", "production", 3, "func (t *T) Tested() {"),
        ("b.go", "r", "go", "production", 1, "x := Used(1)"), ("b_test.go", "r", "go", "test", 1, "t.Tested()"),
    ])
    symbols = declarations.symbols(lines)
    assert {(r.name, r.kind) for r in symbols.collect()} == {("Used", "function"), ("Lost", "function"), ("Tested", "method")}
    usage = {r.name: r.usage for r in declarations.orphan_classes(symbols, declarations.occurrences(lines)).collect()}
    assert usage == {"Used": "used", "Lost": "zero", "Tested": "test-only"}
    assert {(r.src, r.dst) for r in declarations.call_edges(symbols, declarations.calls(lines)).collect()} == {("b.go", "a.go"), ("b_test.go", "a.go")}


def test_couplings_skip_wide_commits(spark):
    rows = [(h, p, 1) for h in range(3) for p in "ab"] + [(9, "a", 1)] + [(10, str(i), 1) for i in range(21)]
    got = history.couplings(spark.createDataFrame(rows, "hash int, path string, churn int")).collect()
    assert {(r.path, r.partner, r.commits, r.confidence) for r in got} == {("a", "b", 3, 0.75), ("b", "a", 3, 1.0)}


def test_ledger_statistics(spark):
    runs = spark.createDataFrame([(i, "r", v, True, "ok") for i, v in enumerate([1.0, 2.0, 9.0])] + [(9, "s", 0.0, False, "bad")], "seq int, repo string, net_reduction double, success boolean, outcome string")
    assert ledgers.reduction_confidence(runs).filter("repo = 'r'").first().confidence == 8
    five = spark.createDataFrame([(i, "r", float(i + 1), True, "") for i in range(5)] + [(i, "f", 3.0, True, "") for i in range(5)], "seq int, repo string, net_reduction double, success boolean, outcome string")
    assert {r.repo: (round(r.slope, 9), r.plateau) for r in ledgers.trend(five).collect()} == {"r": (1.0, False), "f": (0.0, True)}
    assert ledgers.top_failure(runs).first().outcome == "bad"


def test_savings_clamp(spark):
    rows = spark.createDataFrame([(400, 1000), (900, 500)], "packet_chars int, file_chars int").withColumn("ts", F.lit("2025-01-02 00:00:00").cast("timestamp"))
    got = {r.bucket: r for r in ledgers.savings(rows, F.lit("2025-01-02 12:00:00").cast("timestamp")).collect()}
    assert (got["today"].saved_chars, got["all_time"].saved_tokens) == (600, 150)


def test_health(spark):
    plan = spark.createDataFrame([("r", "clean", 1)] * 8 + [("r", "delete", 0), ("r", "large_file", 5)], "repo string, status string, size_kb long")
    assert cleanup.health(plan).first().health == 88


def test_duplicate_files(spark):
    big = "x" * 5000
    rows = [("a/b.go", big), ("a/longer/b.go", big), ("c.go", big), ("d.go.bak", "1"), ("d.go", "2"), ("s1", "same"), ("s2", "same")]
    df = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, size long, content string")
    got = {r.path: (r.signal, r.original) for r in duplicates.duplicate_files(df).collect()}
    assert got == {"a/longer/b.go": ("name-size", "a/b.go"), "a/b.go": ("content", "c.go"), "d.go.bak": ("backup-suffix", "d.go")}


def test_prefix_sums(spark):
    rows = [("g", i, i) for i in range(1, 200)] + [("h", 1, 5)]
    df = running.prefix_sums(spark.createDataFrame(rows, "g string, o int, v long"), "g", "o", {"s": "v"}, 8)
    assert all(r.s == (r.o * (r.o + 1) // 2 if r.g == "g" else 5) for r in df.collect()) and df.count() == 200


def test_contract(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(10)], "g int, v int")
    top = contract.top_per_group(df, ["g"], [F.col("v")], 2)
    assert sorted((r.g, r.v, r.group_total) for r in top.collect()) == [(0, 0, 5), (0, 2, 5), (1, 1, 5), (1, 3, 5)]
    assert contract.apply_top(df, 0, [F.col("v")]).count() == 10 and contract.apply_top(df, 3, [F.col("v")]).count() == 3
    with pytest.raises(ValueError):
        contract.apply_top(df, -1, [F.col("v")])
    assert contract.truncation(df, "rows", 3, "cap").first().asDict() == {"field": "rows", "shown": 3, "total": 10, "reason": "cap"}


def test_detail_levels():
    assert ranking.detail_levels([(10, 0, 0), (10, 5, 50)], 0) == [2, 2]
    assert ranking.detail_levels([(35, 30, 300), (35, 30, 40), (35, 0, 0)], 100) == [1, 2, 0]
    assert ranking.detail_levels([(35, 5, 9)], 4) == [-1]


def test_content_and_empty_tables(spark):
    empty = spark.createDataFrame([], "src string, dst string, weight double")
    assert graphs.strong_components(empty).count() == 0 and graphs.pagerank(empty).count() == 0
