"""Small tables that hold what the test tables lack (routes, boundaries, secrets, internal imports, copies, blocked paths).

``<query>_sample`` runs the query of that name over them, and its SQL over the same rows as values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans import code_graph, files, retrieval, scans, structure
from marlstone.session import scratch

_LONG = "\n".join(f"// line {i} of a file that is long enough to count as a copy of another one" for i in range(70)) + "\n"
_STEPS = "".join(f"\tv{i} := step{i}(x)\n\tuse(v{i})\n" for i in range(5))
FILES = {
    "cmd/tool/main.go": """package main

import (
	"flag"
	"net/http"
	"os"

	"example.org/tool/internal/store"
	web "example.org/tool/internal/web"
)

type config struct {
	Port int `yaml:"port" json:"port,omitempty"`
}

func main() {
	name := flag.String("name", "", "a name")
	home := os.Getenv("TOOL_HOME")
	db := store.Open(home)
	http.HandleFunc("GET /items", web.ListItems)
	http.Handle("/health", func(w http.ResponseWriter, r *http.Request) {})
	go func() { panic(db) }()
	os.Exit(serve(*name))
}
""",
    "internal/store/store.go": """package store

import "database/sql"

import "os"

// Open opens the database.
func Open(path string) *sql.DB {
	db, _ := sql.Open("pgx", path)
	password := "hunter2"
	data, _ := os.ReadFile(path)
	rows, _ := db.Query(string(data), password)
	_ = os.WriteFile(path, nil, 0o600)
	// TODO close the rows
	return db
}

func Transfer(fromAccount string, toAccount string, amountInCents int64, currencyCode string, note string) error {
	NotifyAll(note)
	return nil
}
""",
    "internal/store/store_test.go": 'package store\n\nimport "testing"\n\nfunc TestOpen(t *testing.T) {\n\tOpen("x")\n}\n',
    "internal/web/web.go": """package web

import (
	"io"
	"net/http"
	"example.org/tool/internal/store"
)

func ListItems(w http.ResponseWriter, r *http.Request) {
	body, _ := io.ReadAll(r.Body)
	limited, _ := io.ReadAll(io.LimitReader(r.Body, 9))
	store.Transfer(string(body), string(limited), 1, "EUR", "")
}

func NotifyAll(note string) {
}

func mount(r Router) {
	r.Get("/items/{id}", ListItems)
	r.Post("/items", func(w http.ResponseWriter, r *http.Request) {})
	r.Get("items", ListItems)
}
""",
    "internal/auth/token_handler.go": 'package auth\n\nimport "example.org/tool/internal/store"\n\nvar api_key = "k-1"\n\nfunc Check() { store.Open("") }\n',
    "pkg/a/steps.go": "package a\n\nfunc First(x int) {\n" + _STEPS + "}\n\nfunc (t *T) Third(x int) {\n" + _STEPS + "}\n",
    "pkg/b/steps.go": "package b\r\n\nfunc Second(x int)  {\n\n" + _STEPS.replace("(x)", "(x)  ") + "}\n",
    "web/router.ts": "import { Route, match } from './route';\nimport './style.css';\nexport function routerStart() {\n  return match(new Route());\n}\n",
    "web/route.ts": "export class Route {}\nexport function matchRoute() {}\nexport const match = matchRoute;\n",
    "web/legacy/entry.js": "const r = require('../router');\nexport * from \"../route\";\nr.routerStart();\n",
    "tools/run.py": "import os, sys as system\nfrom . import helper\nfrom tools.helper import run_all\n\ndef main():\n    run_all()\n",
    "tools/helper.py": "def run_all():\n    pass\n",
    "src/A.java": "import java.util.List;\nimport static java.lang.Math.*;\n\npublic class A {\n    public int size() { return 1; }\n}\n",
    "docs/old/notes.md": "nothing\n",
    "lib/long.go": "package lib\n" + _LONG,
    "lib/long.go.bak": "package lib\n" + _LONG,
    "other/deep/long.go": "package lib\n" + _LONG,
    "other/twin.go": "package lib\n" + _LONG,
    ".env": "X=1\n",
    "a/.work/b.go": "package b\n",
    "c/.claude/d.md": "x\n",
    "e/my-auth-state.json": "{}\n",
    "e/site.cookies.txt": "x\n",
    "f/.agent-browser-state/g": "x\n",
    "f/.env.sample": "x\n",
}
NAMES = {
    "import_edges": scans, "importers": scans, "risk_structure": scans, "risk_components": scans, "effects_by_kind": scans, "effects_by_file": scans, "surface_counts": scans,
    "inventory_owners": scans, "secret_files": scans, "rank_components": retrieval, "duplicate_files": files, "path_guards": structure, "symbol_references": code_graph, "call_edges": code_graph, "call_cycles": code_graph, "duplicate_bodies": code_graph,
}

_COLUMNS = {
    "source_files": "file_id bigint, snapshot_id string, repo string, path string, language string, size bigint, generated boolean, content string",
    "report_rows": "row_id bigint, report_id string, path string",
    "evidence": "evidence_id string, path string",
}
_ROWS = [(i, "s", "r", path, "", len(content.encode()), False, content) for i, (path, content) in enumerate(FILES.items())]


def folder(spark: SparkSession) -> str:
    """Folder of the sample tables in the shared folder, written once per application."""

    def write(path: str) -> None:
        for table, columns in _COLUMNS.items():
            spark.createDataFrame(_ROWS if table == "source_files" else [], columns).write.mode("overwrite").parquet(f"{path}/{table}.parquet")

    return scratch(spark, "samples", write)


def _over(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, folder(spark))

    run.__doc__ = (query.__doc__ or "").rstrip() + " Over the sample tables."
    return run


def _sql(text: str) -> str:
    value = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    rows = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in _ROWS)
    tables = f"source_files AS (SELECT * FROM (VALUES {rows}) v(file_id, snapshot_id, repo, path, language, size, generated, content)), report_rows AS (SELECT NULL::VARCHAR AS path WHERE false), evidence AS (SELECT NULL::VARCHAR AS path WHERE false)"
    head = "WITH RECURSIVE " if text.startswith("WITH RECURSIVE ") else "WITH "
    return head + tables + ", " + text.removeprefix(head)


_PAIRS = {name: (module.QUERIES[name], module.ORACLES[name]) for name, module in NAMES.items()} | scans.SAMPLE_ONLY
QUERIES = {f"{name}_sample": _over(query) for name, (query, _) in _PAIRS.items()}
ORACLES = {f"{name}_sample": _sql(sql) for name, (_, sql) in _PAIRS.items()}
