"""Queries over spans, imports, phases, custom rules, candidates, packing and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths, text
from marlstone.operators import declarations, diffs, guards, imports, linescan, pipelines, resolution, tasks
from marlstone.plans.code_graph import SYMBOLS
from marlstone.plans.files import _DIR, FILES, _split_sql
from marlstone.plans.scans import LINES
from marlstone.session import load, materialize
from marlstone.sources import adapters, writers

#: A catalogue of custom rules as a user would give it: (id, pattern, weight, most, include, exclude).
CUSTOM = [("switch", r"\bswitch\b", 3, 2, [], []), ("error", r"\b(?:err|Error)\b", 2, 4, ["**/*.go", "**/*.ts"], ["internal/vendors/**"]), ("loop", r"\bfor\b", 1, 5, [], ["**/*.py"])]
REQUESTS_TOP = 96


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    symbols = declarations.symbols(adapters.source_lines(files)).select("path", "repo", "line", "name", "kind", "signature")
    return diffs.spans(symbols, files.select("path", F.size(F.split("content", "\n")).alias("lines")))


def symbol_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line span of every symbol."""
    return _spans(spark, sf_dir).select("path", "line", "name", "end")


def clone_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols whose span overlaps a cloned range of their file."""
    pairs = load(spark, sf_dir, "clone_pairs")
    side = lambda n: pairs.select(F.regexp_replace(F.regexp_replace(F.translate(f"{n}_file_name", "\\", "/"), r"^(?:\./)+", ""), r"^[^/]*/", "").alias("path"), F.col(f"{n}_file_start").alias("start"), (F.col(f"{n}_file_end") + 1).alias("end"))
    return diffs.overlapping(_spans(spark, sf_dir), side("first").unionByName(side("second"))).select("path", "line", "name")


def marker_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that hold change markers, with their number."""
    marks = [p for p in linescan.RISK if p.kind == "change-marker"]
    points = linescan.hits(adapters.source_lines(adapters.files(spark, sf_dir)), marks).select("path", "number")
    return diffs.enclosing(points, _spans(spark, sf_dir)).groupBy("path", "symbol").agg(F.count(F.lit(1)).alias("markers"))


def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named script imports per outcome."""
    files = adapters.files(spark, sf_dir)
    lines = adapters.source_lines(files)
    out = resolution.resolve(resolution.bindings(lines), files, declarations.symbols(lines))
    return out.groupBy(F.coalesce("reason", F.lit("resolved")).alias("outcome")).agg(F.count(F.lit(1)).alias("imports"), F.count_distinct("module").alias("modules"))


def plan_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that only the plan or only the capture has."""
    plan = load(spark, sf_dir, "clean_plan").select(F.regexp_replace("file", r"^\./", "").alias("path")).filter("path is not null")
    return diffs.drift(plan, load(spark, sf_dir, "source_files"), ["path"])


def phase_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by the kind of phase their name says."""
    folders = adapters.files(spark, sf_dir).select(paths.directory(F.col("path")).alias("folder"), "path")
    kind = F.when(F.lower("folder").startswith("cmd/"), "Boot").otherwise(pipelines.phase_kind(paths.base(F.col("folder"))))
    return folders.groupBy(kind.alias("kind")).agg(F.count_distinct("folder").alias("folders"), F.count(F.lit(1)).alias("files"))


def custom_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a user's catalogue per file: matches up to a maximum times a weight."""
    rules = []
    for rule, pattern, weight, most, include, exclude in CUSTOM:
        applies = (paths.glob_match(F.col("path"), include) if include else F.lit(True)) & ~paths.glob_match(F.col("path"), exclude)
        rules.append(F.when(applies, F.least(F.lit(most), F.regexp_count("content", F.lit(pattern))) * weight).otherwise(0).alias(rule))
    scored = adapters.files(spark, sf_dir).select("path", *rules)
    total = sum((F.col(r[0]) for r in CUSTOM), F.lit(0))
    return scored.withColumn("score", total.cast("long")).filter("score > 0").select("path", "score")


def _evidence(spark: SparkSession, sf_dir: str, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence with owners, named symbols) of requests (key, request)."""
    files = adapters.files(spark, sf_dir)
    lines = adapters.source_lines(files)
    symbols = materialize(declarations.symbols(lines).select("path", "line", "name", "signature"))
    edges = imports.import_edges(files)
    hit = materialize(tasks.evidence(tasks.goal_terms(requests, "key", "request"), tasks.evidence_parts(files, symbols, edges)))
    slim = files.select("path", "language")
    folders = slim.select(F.col("path").alias("seed"), paths.directory(F.col("path")).alias("folder"))
    importing = imports.internal_imports(edges, slim).join(folders, "folder").select("path", "seed")
    calling = declarations.call_edges(symbols, declarations.calls(lines)).filter("src <> dst").select(F.col("src").alias("path"), F.col("dst").alias("seed"))
    named = tasks.goal_identifiers(requests, "key", "request").join(symbols.select("path", F.lower("name").alias("name")).distinct(), "name").groupBy("key", "path").agg(F.count(F.lit(1)).alias("exact"))
    return tasks.with_owners(hit, importing, calling), named


def evidence_of(spark: SparkSession, sf_dir: str, goal: str) -> DataFrame:
    """(path, exact, relevance) of the files with evidence for one goal, owners among them."""
    hit, named = _evidence(spark, sf_dir, spark.createDataFrame([("goal", goal)], "key string, request string"))
    return hit.join(named, ["key", "path"], "left").select("path", F.coalesce("exact", F.lit(0)).alias("exact"), "relevance")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.plans.retrieval import rank_scores

    requests = load(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("key"), "request")
    hit, named = _evidence(spark, sf_dir, requests)
    return tasks.candidates(hit, named, rank_scores(spark, sf_dir), requests, REQUESTS_TOP)


def task_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that answer a request, by relevance."""
    return _candidates(spark, sf_dir).select(F.col("key").alias("case_id"), "rank", "path", "relevance", "terms", tasks.confidence(F.col("relevance")).alias("confidence"))


def task_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files packed into each request's token budget."""
    costs = adapters.files(spark, sf_dir).select("path", text.token_estimate(F.col("content")).alias("tokens"))
    budgets = load(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("key"), F.col("token_budget").alias("budget"))
    return tasks.pack(_candidates(spark, sf_dir), costs, budgets).withColumnRenamed("key", "case_id")


def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a packed document would share, with their copies and first document."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    packed, _ = writers.dictionary(docs)
    return packed.filter("ref is not null").groupBy("ref").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first")).select("copies", "first")


def path_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured and reported paths that break a rule."""
    seen = load(spark, sf_dir, "source_files").select("path").union(load(spark, sf_dir, "report_rows").select("path")).union(load(spark, sf_dir, "evidence").select("path"))
    return seen.filter("path is not null").distinct().select("path", F.explode(guards.path_rules(F.col("path"))).alias("rule"))


def case_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out cases by the rules they break."""
    from marlstone.sources.readers import eval_case_errors

    return eval_case_errors(load(spark, sf_dir, "eval_cases")).groupBy(F.size("errors").alias("broken_rules")).agg(F.count(F.lit(1)).alias("cases"))


QUERIES = {q.__name__: q for q in (symbol_spans, clone_symbols, marker_owners, import_resolution, plan_drift, phase_kinds, custom_risk, task_candidates, task_packets, packed_texts, path_guards, case_validation)}

_SPANS = f"{SYMBOLS}, sp AS (SELECT s.path, line, name, coalesce(lead(line) OVER (PARTITION BY s.path ORDER BY line, name), len(string_split(content, chr(10))) + 1)::INT AS fin FROM s JOIN f USING (path))"
_BASE = "lower(regexp_extract(folder, '[^/]*$'))"
#: Written out here on its own, so that a wrong entry of the operator's table shows.
_KINDS = " ".join(f"WHEN regexp_matches({_BASE}, '^({names})') THEN '{kind}'" for names, kind in [
    ("main|cmd|cli|boot", "Boot"), ("commands|command|dispatch|route", "Route"), ("spec|schema|model|parse|load", "Parse"), ("validate|valid|check|lint", "Check"), ("render|template|templates|view|html", "Render"),
    ("watch|watcher|fsnotify|notify", "Watch"), ("serve|server|http|handler|routes", "Serve"), ("emit|output", "Emit"), ("review|scan|analyze|inspect", "Analyze"),
])
_PREFIX = "(least(strlen(part), strlen(term)) >= 3 AND (starts_with(part, term) OR starts_with(term, part)))"
ORACLES = {
    "symbol_spans": f'WITH {_SPANS} SELECT path, line, name, fin AS "end" FROM sp',
    "clone_symbols": rf"""WITH {_SPANS}, h AS (SELECT regexp_replace(regexp_replace(replace(n, '\', '/'), '^(\./)+', ''), '^[^/]*/', '') AS path, a, b + 1 AS b FROM (SELECT first_file_name AS n, first_file_start AS a, first_file_end AS b FROM clone_pairs UNION ALL SELECT second_file_name, second_file_start, second_file_end FROM clone_pairs))
SELECT path, line, name FROM sp WHERE EXISTS (SELECT 1 FROM h WHERE h.path = sp.path AND line < h.b AND h.a < fin)""",
    "marker_owners": rf"WITH {_SPANS}, m AS (SELECT path, number FROM l WHERE regexp_matches(text, '\b(?:TODO|FIXME|HACK|XXX)\b')) SELECT m.path, name AS symbol, count(*)::BIGINT AS markers FROM m JOIN sp ON m.path = sp.path AND number >= line AND number < fin GROUP BY 1, 2",
    "plan_drift": r"WITH p AS (SELECT DISTINCT regexp_replace(file, '^\./', '') AS path FROM clean_plan WHERE file IS NOT NULL), s AS (SELECT DISTINCT path FROM source_files) SELECT coalesce(p.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'left' ELSE 'right' END AS side FROM p FULL JOIN s ON p.path = s.path WHERE p.path IS NULL OR s.path IS NULL",
    "phase_kinds": f"WITH d AS (SELECT path, {_DIR} AS folder FROM source_files) SELECT CASE WHEN starts_with(lower(folder), 'cmd/') THEN 'Boot' {_KINDS} ELSE 'Unknown' END AS kind, count(DISTINCT folder)::BIGINT AS folders, count(*)::BIGINT AS files FROM d GROUP BY 1",
    "custom_risk": r"""WITH c AS (SELECT path, 3 * least(2, len(regexp_extract_all(content, '\bswitch\b'))) + CASE WHEN regexp_matches(path, '\.(go|ts)$') AND NOT starts_with(path, 'internal/vendors/') THEN 2 * least(4, len(regexp_extract_all(content, '\b(?:err|Error)\b'))) ELSE 0 END
 + CASE WHEN path NOT LIKE '%.py' THEN least(5, len(regexp_extract_all(content, '\bfor\b'))) ELSE 0 END AS score FROM source_files) SELECT path, score::BIGINT AS score FROM c WHERE score > 0""",
    "import_resolution": rf"""WITH {SYMBOLS}, b0 AS (SELECT path, number AS line, regexp_extract(text, '^import \{{([^}}]*)\}} from ["'']([^"'']+)["'']', 1) AS names, regexp_extract(text, '^import \{{([^}}]*)\}} from ["'']([^"'']+)["'']', 2) AS module FROM l WHERE language IN ('typescript', 'javascript') AND regexp_matches(text, '^import \{{([^}}]*)\}} from ["'']([^"'']+)["'']')),
b AS (SELECT path, line, module, trim(unnest(string_split(names, ','))) AS symbol FROM b0),
k AS (SELECT b.*, count(*) OVER (PARTITION BY path, symbol) AS n_bound, (SELECT count(DISTINCT s.path) FROM s WHERE s.name = b.symbol AND starts_with(b.module, './') AND regexp_replace(regexp_replace(s.path, '\.(tsx?|jsx?|mjs|cjs)$', ''), '/index$', '') = regexp_replace(b.path, '[^/]*$', '') || substr(b.module, 3) AND regexp_matches(s.path, '\.(tsx?|jsx?|mjs|cjs)$')) AS hits FROM b)
SELECT CASE WHEN n_bound > 1 THEN 'ambiguous_binding' WHEN hits = 0 THEN 'unresolved_target' WHEN hits > 1 THEN 'ambiguous_binding' ELSE 'resolved' END AS outcome, count(*)::BIGINT AS imports, count(DISTINCT module)::BIGINT AS modules FROM k GROUP BY 1""",
    "packed_texts": "SELECT count(*)::BIGINT AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1",
    "path_guards": r"WITH p AS (SELECT path FROM source_files UNION SELECT path FROM report_rows UNION SELECT path FROM evidence), b AS (SELECT path, string_split(path, '/') AS g, regexp_extract(path, '[^/]*$') AS n FROM p WHERE path IS NOT NULL) SELECT path, 'private-work-directory' AS rule FROM b WHERE list_contains(g, '.work') UNION ALL SELECT path, 'private-claude-directory' FROM b WHERE list_contains(g, '.claude') UNION ALL SELECT path, 'environment-file' FROM b WHERE n = '.env' OR (starts_with(n, '.env.') AND n NOT IN ('.env.example', '.env.sample', '.env.template')) UNION ALL SELECT path, 'browser-auth-state' FROM b WHERE n = 'auth-state.json' OR ends_with(n, '-auth-state.json') UNION ALL SELECT path, 'browser-cookie-file' FROM b WHERE n IN ('cookies.txt', 'cookies.json') OR ends_with(n, '.cookies.txt') UNION ALL SELECT path, 'browser-agent-state-directory' FROM b WHERE list_contains(g, '.agent-browser-state')",
    "case_validation": "SELECT ((coalesce(trim(case_id), '') = '')::INT + (coalesce(trim(request), '') = '')::INT + (coalesce(token_budget, 0) <= 0)::INT + (coalesce(len(expected_paths), 0) = 0)::INT + (coalesce(classification, '') NOT IN ('lexical', 'non-lexical'))::INT + (len(list_filter(expected_paths, lambda p: starts_with(p, '/') OR contains(p, '..'))) > 0)::INT)::INT AS broken_rules, count(*)::BIGINT AS cases FROM eval_cases GROUP BY 1",
}

_BARE = r"regexp_matches(trim(request), '^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$')"


def candidates_sql(components: str) -> str:
    """SQL of ``task_candidates`` on top of that of the rank components (which holds f, l, s, im, ii, e and parts)."""
    free = lambda t: f"list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{Nd}}]+'), lambda x: x)"
    return rf"""WITH {components}, w AS (SELECT case_id, {_BARE} AS bare, unnest(regexp_extract_all(request, '[\p{{L}}\p{{Nd}}]+')) AS w FROM eval_cases), g0 AS (SELECT case_id, bare, unnest({_split_sql("w")}) AS term FROM w),
g AS (SELECT DISTINCT case_id, bare, term FROM g0 WHERE length(term) >= 2 AND term NOT IN ('the', 'and', 'for', 'with', 'into', 'that', 'this', 'from', 'add', 'fix')),
sg AS (SELECT path, unnest(string_split(path, '/')) AS seg FROM f), sm AS (SELECT path, regexp_replace(seg, '\.[^.]*$', '') AS stem FROM sg WHERE seg NOT IN ('', '.', '..')),
pk AS (SELECT path, regexp_extract(content, '(?m)^package[ \t]+(\w+)', 1) AS pk FROM f WHERE language = 'go'),
pt AS (SELECT path, 'path' AS field, path AS value, unnest({_split_sql("stem")}) AS part FROM sm WHERE stem <> '' UNION SELECT path, 'package', pk, unnest({_split_sql("pk")}) FROM pk WHERE pk <> ''
 UNION SELECT path, 'import', '', unnest({free("module")}) FROM im UNION SELECT path, 'symbol', name, unnest({_split_sql("name")}) FROM s UNION SELECT path, 'signature', signature, unnest({free("signature")}) FROM s),
m AS (SELECT term, part, max(CASE WHEN replace(term, '_', '') = replace(part, '_', '') THEN 1 ELSE 0 END) AS exact FROM (SELECT DISTINCT term FROM g), (SELECT DISTINCT part FROM pt) WHERE replace(term, '_', '') = replace(part, '_', '') OR {_PREFIX} GROUP BY term, part),
x AS (SELECT path, field, value, term, max(exact) AS exact FROM pt JOIN m USING (part) GROUP BY ALL),
wt AS (SELECT * FROM (VALUES ('path', 8, 4), ('package', 5, 5), ('import', 3, 3), ('symbol', 8, 12), ('signature', 4, 6)) v(field, plain, symbolic)),
h AS (SELECT case_id, path, sum(CASE WHEN exact = 1 THEN CASE WHEN bare THEN symbolic ELSE plain END ELSE greatest(1, (CASE WHEN bare THEN symbolic ELSE plain END) // 2) END)::BIGINT AS relevance, count(DISTINCT term)::BIGINT AS terms FROM g JOIN x USING (term) JOIN wt USING (field) GROUP BY case_id, path),
ow AS (SELECT ii.path, f.path AS seed, 6 AS credit FROM ii JOIN f ON regexp_replace(f.path, '/?[^/]*$', '') = ii.folder UNION SELECT src, dst, 4 FROM e WHERE src <> dst),
o AS (SELECT case_id, ow.path, arg_min(credit, (seed, -credit))::BIGINT AS relevance, 0::BIGINT AS terms FROM h JOIN ow ON ow.seed = h.path WHERE ow.path <> ow.seed AND ow.path NOT LIKE '%\_test.go' ESCAPE '\' AND (case_id, ow.path) NOT IN (SELECT (case_id, path) FROM h) GROUP BY case_id, ow.path),
sc AS (SELECT f.path, coalesce(sum(points), 0) AS score FROM f LEFT JOIN parts USING (path) GROUP BY f.path),
id0 AS (SELECT case_id, {_BARE} AS bare, unnest(regexp_split_to_array(trim(request), '\s+')) AS word FROM eval_cases), id1 AS (SELECT case_id, bare, regexp_matches(word, '[`"'']') AS quoted, trim(word, '`"''(),;.!?:') AS request FROM id0),
id AS (SELECT DISTINCT case_id, lower(request) AS name FROM id1 WHERE {_BARE} AND (bare OR quoted OR regexp_matches(request, '[_:.\\>-]') OR regexp_matches(substr(request, 2), '\p{{Lu}}')) AND lower(request) NOT IN ('the', 'and', 'for', 'with', 'into', 'that', 'this', 'from', 'add', 'fix')),
ex AS (SELECT case_id, path, count(DISTINCT lower(s.name)) AS exact FROM id JOIN s ON lower(s.name) = id.name GROUP BY case_id, path),
un AS (SELECT * FROM h UNION ALL SELECT * FROM o), fb AS (SELECT case_id, path, 0::BIGINT AS relevance, 0::BIGINT AS terms FROM eval_cases, f WHERE case_id NOT IN (SELECT case_id FROM h)),
r AS (SELECT case_id, path, relevance, terms, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(exact, 0) DESC, relevance DESC, score DESC, path)::INT AS rank FROM (SELECT * FROM un UNION ALL SELECT * FROM fb) JOIN sc USING (path) LEFT JOIN ex USING (case_id, path))
SELECT case_id, rank, path, relevance, terms, CASE WHEN relevance >= 16 THEN 'high' WHEN relevance >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE rank <= 96"""
