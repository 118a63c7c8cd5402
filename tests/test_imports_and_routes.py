"""Imports, structure signals, ranking parts and routes on hand-made files."""

from marlstone.operators import declarations, diffs, imports, linescan, ranking, routes
from marlstone.sources import adapters

COLUMNS = "path string, repo string, language string, class string, content string, module string"


def _files(spark, rows):
    return spark.createDataFrame([(p, "r", lang, cls, c, "clash") for p, lang, cls, c in rows], COLUMNS)


GO = [
    ("main.go", "go", "production", 'package main\n\nimport (\n\t"fmt"\n\tx "m.org/a/pkg/one"\n\t"m.org/a"\n)\n'),
    ("pkg/one/one.go", "go", "production", 'package one\nimport "m.org/a/pkg/two"\nimport "m.org/a/pkg/two"\n'),
    ("pkg/two/two.go", "go", "production", "package two\n"),
    ("pkg/two/two_test.go", "go", "test", 'package two\nimport "m.org/a/pkg/one"\n'),
    ("two/other.go", "go", "production", "package two\n"),
    ("web/a.ts", "typescript", "production", "import {\n  a,\n  b,\n} from './b';\nexport * from \"./c\"\nimport type { T } from 't';\nconst z = require( 'z' );\n// import { q } from q\n"),
    ("p.py", "python", "production", "import os.path as p, sys\nfrom ..a import b\nimportant = 1\n"),
    ("none.go", "go", "production", None),
    (None, "go", "production", 'import "x"\n'),
]


def test_edges_of_every_language_and_missing_values(spark):
    got = {(r.path, r.module) for r in imports.import_edges(_files(spark, GO)).collect()}
    assert {m for p, m in got if p == "main.go"} == {"fmt", "m.org/a/pkg/one", "m.org/a"}
    assert {m for p, m in got if p == "web/a.ts"} == {"./b", "./c", "t", "z"}
    assert {m for p, m in got if p == "p.py"} == {"os.path", "sys", "..a"}
    assert not any(p in (None, "none.go") for p, _ in got)
    assert imports.import_edges(_files(spark, [])).count() == 0


def test_folders_by_module_and_by_longest_suffix(spark):
    files = _files(spark, GO)
    edges = imports.import_edges(files)
    known = {(r.path, r.folder) for r in imports.internal_imports(edges, files, "m.org/a").collect()}
    assert known == {("main.go", "pkg/one"), ("main.go", "."), ("pkg/one/one.go", "pkg/two"), ("pkg/two/two_test.go", "pkg/one")}
    guessed = imports.internal_imports(edges, files)
    assert {(r.path, r.folder) for r in guessed.collect()} == {("main.go", "pkg/one"), ("pkg/one/one.go", "pkg/two"), ("pkg/two/two_test.go", "pkg/one")}
    scores = {r.path: (r.importers, r.score) for r in imports.imported_files(guessed, files).collect()}
    assert scores == {"pkg/one/one.go": (2, 20), "pkg/two/two.go": (1, 10), "pkg/two/two_test.go": (1, 10)}


def test_structure_signals_and_points(spark):
    many = "package a\n" + "".join(f'import "x{i}"\n' for i in range(8)) + "".join(f"func f{i}() {{\n}}\n" for i in range(24)) + "func F(" + "a" * 80 + " int) {\n}\n"
    rows = [("a.go", "go", "production", many), ("b/b.go", "go", "production", "package b\n"), ("t_test.go", "go", "test", many)] + [(f"u{i}.go", "go", "production", 'package a\nimport "m/b"\n') for i in range(5)]
    files = _files(spark, rows)
    signals = imports.structure_signals(files, declarations.symbols(adapters.source_lines(files)), imports.import_edges(files), "m")
    got = {r.path: r for r in signals.collect()}
    assert (got["a.go"].depends_on, got["a.go"].symbols, got["a.go"].signatures, got["a.go"].imported_by) == (8, 25, 1, 0)
    assert got["b/b.go"].imported_by == 5 and "t_test.go" not in got
    points = {(r.path, r.reason): r.weight for r in linescan.structure_points(signals).collect()}
    assert points == {
        ("a.go", "imports 8 dependencies"): 10, ("a.go", "25 symbols in one file"): 8, ("a.go", "1 complex public signature(s)"): 6, ("b/b.go", "package imported by 5 files"): 15,
    }


def test_rank_parts_of_tests_imports_and_consumed(spark):
    files = _files(spark, GO).filter("path is not null").select("path", "language", "class")
    nothing = spark.createDataFrame([], "path string, line int, name string, kind string, exported boolean")
    callers = spark.createDataFrame([], "symbol string, dst string, callers long, score long")
    imported = spark.createDataFrame([("pkg/one/one.go", 2, 20)], "path string, importers int, score int")
    reference = spark.createDataFrame([("two/other.go", 0.5, 30)], "node string, rank double, bonus int")
    got = {(r.path, r.component): r.points for r in ranking.components(files, nothing, callers, "", imported, ["p.py"], reference).collect()}
    assert got[("pkg/two/two.go", "tests")] == 4 and got[("pkg/two/two_test.go", "test_demote")] == -15 and ("pkg/two/two_test.go", "tests") not in got
    assert got[("pkg/one/one.go", "imports")] == 20 and got[("p.py", "consumed")] == 15 and got[("two/other.go", "reference_graph")] == 30
    assert ("two/other.go", "tests") not in got


ROUTES = """package web

func Items(w W, r *R) {
	store.Load(r)
	render(w)
}

func mount(mux M) {
	mux.HandleFunc("GET /items", Items)
	mux.Handle("/items", other.Items)
	mux.Get("/items/{id}", func(w W, r *R) {})
	mux.Get("items", Items)
}
"""


def test_routes_and_their_slice(spark):
    files = _files(spark, [("web/b.go", "go", "production", ROUTES), ("web/a.go", "go", "production", "package web\n\nfunc Items() {\n\tnever()\n}\n"), ("web/b_test.go", "go", "test", ROUTES), ("n.go", "go", "production", None)])
    lines = adapters.source_lines(files)
    found = routes.routes(lines)
    assert {(r.framework, r.method, r.pattern, r.handler, r.line) for r in found.collect()} == {
        ("net/http", "GET", "/items", "Items", 9), ("net/http", "ANY", "/items", "other.Items", 10), ("chi", "GET", "/items/{id}", "<inline>", 11),
    }
    pick = lambda q: {(r.method, r.pattern) for r in routes.matching(found, q).collect()}
    assert pick("GET /items") == {("GET", "/items"), ("ANY", "/items")} and pick("POST /items") == {("ANY", "/items")}
    assert pick("{id}") == {("GET", "/items/{id}")} and pick("nothing") == set() and pick("") == set()
    spans = diffs.spans(declarations.symbols(lines).select("path", "line", "name", "kind"), spark.createDataFrame([("web/b.go", 13), ("web/a.go", 5), ("web/b_test.go", 13)], "path string, lines int"))
    slices = {r.method: r for r in routes.endpoint(found, "GET /items", spans, declarations.calls(lines)).collect()}
    assert slices["GET"].handler_path == "web/b.go" and slices["GET"].callees == ["Load", "render"]
