"""Queries that scan source lines: risks, effects, surface, owners, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.contract import top_per_group
from marlstone.operators import declarations, imports, linescan, routes
from marlstone.plans.files import FILES
from marlstone.session import load
from marlstone.sources import adapters


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.source_lines(adapters.files(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("text").alias("language"), F.lit("docs").alias("class"), "repo")
    return adapters.source_lines(d)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir).filter(F.col("class") == "production")
    lines = adapters.source_lines(files)
    return linescan.risk_points(files, lines, imports.structure_signals(files, declarations.symbols(lines), imports.import_edges(files)))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct imports of every file."""
    return imports.import_edges(adapters.files(spark, sf_dir)).select("path", "module")


def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that import each module, and the score of their number."""
    return imports.importers(imports.import_edges(adapters.files(spark, sf_dir)))


def risk_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies, symbols and long public signatures of Go production files."""
    files = adapters.files(spark, sf_dir)
    return imports.structure_signals(files, declarations.symbols(adapters.source_lines(files)), imports.import_edges(files)).select("path", "depends_on", "symbols", "signatures")


def routes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route registrations of Go sources."""
    return routes.routes(_lines(spark, sf_dir))


def risk_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by risk score with their lanes."""
    return linescan.risk_files(_points(spark, sf_dir)).select("path", "score", F.concat_ws(",", "lanes").alias("lanes"), "reasons").orderBy(F.desc("score"), "path")


def risk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and matches of each reason of each file."""
    return _points(spark, sf_dir).groupBy("path", "reason").agg(F.sum("points").cast("long").alias("points"), F.count(F.lit(1)).alias("matches"))


def risk_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and points of each lane."""
    return _points(spark, sf_dir).groupBy("lane").agg(F.count_distinct("path").alias("files"), F.sum("points").cast("long").alias("points"))


def effects_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects and files of each kind, in files that are no Go tests."""
    lines = _lines(spark, sf_dir).filter(~F.col("path").endswith("_test.go"))
    return linescan.effects(lines).groupBy("kind", "lane").agg(F.count(F.lit(1)).alias("effects"), F.count_distinct("path").alias("files"))


def effects_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect score of each file."""
    lines = _lines(spark, sf_dir).filter(~F.col("path").endswith("_test.go"))
    return linescan.effect_scores(linescan.effects(lines)).select("path", "score", "effects", F.concat_ws(",", "lanes").alias("lanes"))


def document_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patterns over the lines of documents."""
    return linescan.effects(_documents(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("effects"), F.count_distinct("path").alias("documents"))


def surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface hits per kind in files that are no Go tests."""
    lines = _lines(spark, sf_dir).filter(~F.col("path").endswith("_test.go"))
    return linescan.hits(lines, linescan.SURFACE).groupBy("kind").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("name").alias("names"))


def change_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve change markers of each file and their total."""
    found = linescan.hits(_lines(spark, sf_dir), [p for p in linescan.RISK if p.kind == "change-marker"])
    return top_per_group(found.select("path", "number"), ["path"], [F.col("number")], 12)


def inventory_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that own boundary operations, with their roles."""
    return linescan.owners(linescan.effects(_lines(spark, sf_dir))).select("path", F.concat_ws(",", "roles").alias("roles"), "evidence")


def secret_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with assignments that look like secrets; the values are never shown."""
    pattern = r"(?i)\b(?:password|passwd|secret|api[_-]?key)\b\s*[:=]\s*\S"
    return _lines(spark, sf_dir).filter(F.col("text").rlike(pattern)).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.min("number").alias("first"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, blank and comment lines per language."""
    comment = F.col("text").rlike(r"^(?://|#|/\*|\*)")
    return _lines(spark, sf_dir).groupBy("language").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text") == "").alias("blank"), F.count_if(comment).alias("comment")
    )


QUERIES = {q.__name__: q for q in (import_edges, importers, risk_structure, risk_queue, risk_components, risk_lanes, effects_by_kind, effects_by_file, document_effects, surface_counts, change_markers, inventory_owners, secret_files, line_counts)}

_WS = "chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)"
LINES = f"l AS (SELECT path, repo, language, class, raw, number, trim(raw, {_WS}) AS text FROM (SELECT path, repo, language, class, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1)::INT AS number FROM f))"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _hits(patterns: list[linescan.Pattern], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT path, language, number, text, {i} AS ordinal, '{p.kind}' AS kind, '{p.lane}' AS lane, {p.weight} AS weight, '{p.reason}' AS reason, {p.most} AS most, {str(p.generic).lower()} AS generic, "
        f"{'regexp_extract(text, ' + chr(39) + _q(p.regex) + chr(39) + ', 1)' if '([^' in p.regex else chr(39) * 2} AS name FROM {source} WHERE regexp_matches(text, '{_q(p.regex)}')"
        + (f" AND len(regexp_extract_all(text, '{_q(p.regex)}')) > len(regexp_extract_all(text, '{_q(p.regex + p.bounded)}'))" if p.bounded else "")
        for i, p in enumerate(patterns)
    )


_TERMS = " UNION ALL ".join(
    f"SELECT path, 0 AS line, {1 + i} AS ordinal, '{lane}' AS lane, '{reason}' AS reason, {weight} AS weight FROM r WHERE regexp_matches(lower(path), '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    for i, (term, weight, lane, reason) in enumerate(linescan.RISK_TERMS)
)
#: Distinct imports of files, of a table f.
IMPORTS = r"""im AS (SELECT DISTINCT path, language, module FROM (
 SELECT path, language, unnest(regexp_extract_all(content, '(?m)^import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"', 1)) AS module FROM f WHERE language = 'go'
 UNION ALL SELECT path, language, unnest(regexp_extract_all(block, '(?m)^[ \t]*(?:[\w.]+[ \t]+)?"([^"\n]+)"', 1)) FROM (SELECT path, language, unnest(regexp_extract_all(content, '(?m)^import[ \t]*\(([^)]*)\)', 1)) AS block FROM f WHERE language = 'go')
 UNION ALL SELECT path, language, unnest(list_concat(regexp_extract_all(content, '(?m)^(?:import|export)\b[^''";]*?\bfrom[ \t]*[''"]([^''"\n]+)[''"]', 1), regexp_extract_all(content, '(?m)^import[ \t]+[''"]([^''"\n]+)[''"]', 1), regexp_extract_all(content, '\brequire\([ \t]*[''"]([^''"\n]+)[''"][ \t]*\)', 1))) FROM f WHERE language IN ('typescript', 'javascript', 'tsx', 'jsx')
 UNION ALL SELECT path, language, regexp_extract(unnest(string_split(part, ',')), '^\s*([.\w]+)', 1) FROM (SELECT path, language, unnest(regexp_extract_all(content, '(?m)^[ \t]*import[ \t]+([\w., \t]+)', 1)) AS part FROM f WHERE language = 'python')
 UNION ALL SELECT path, language, unnest(regexp_extract_all(content, '(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b', 1)) FROM f WHERE language = 'python'
 UNION ALL SELECT path, language, unnest(regexp_extract_all(content, '(?m)^import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;', 1)) FROM f WHERE language = 'java') WHERE module <> '')"""
#: Structure of Go production files, of tables f, l and im.
_STRUCTURE = r"""sy AS (SELECT path, count(*) AS symbols, count_if(regexp_matches(raw, '^(func (\([^)]*\) )?|type |var |const )[A-Z]') AND strlen(text) >= 80) AS signatures FROM l
 WHERE language = 'go' AND regexp_matches(raw, '^func \([^)]*\) [A-Za-z_]\w*\(|^func [A-Za-z_]\w*\(|^(type|var|const) [A-Za-z_]\w*\b') GROUP BY path),
dp AS (SELECT path, count(DISTINCT module) AS depends_on FROM im GROUP BY path),
st AS (SELECT f.path, coalesce(depends_on, 0)::BIGINT AS depends_on, coalesce(symbols, 0)::BIGINT AS symbols, coalesce(signatures, 0)::BIGINT AS signatures FROM f LEFT JOIN dp USING (path) LEFT JOIN sy USING (path) WHERE language = 'go' AND class = 'production')"""
_RISK = f"""{FILES}, r AS (SELECT * FROM f WHERE class = 'production'), {LINES.replace("FROM f)", "FROM r)")}, {IMPORTS}, {_STRUCTURE},
h AS ({_hits(linescan.RISK, "l")}),
c AS (SELECT path, number AS line, ordinal + 100 AS ordinal, lane, reason, weight FROM (SELECT *, row_number() OVER (PARTITION BY path, ordinal ORDER BY number) AS n FROM h WHERE language = 'go' OR generic) WHERE n <= most),
a AS (SELECT path, 0 AS line, 0 AS ordinal, 'cli-ux' AS lane, 'entrypoint or command surface' AS reason, 20 AS weight FROM r WHERE path LIKE 'cmd/%' OR lower(path) LIKE '%/main.go' OR path = 'main.go'
 UNION ALL {_TERMS} UNION ALL SELECT * FROM c
 UNION ALL SELECT path, 0, 51, 'coupling', 'imports ' || depends_on || ' dependencies', 10 FROM st WHERE depends_on >= 8
 UNION ALL SELECT path, 0, 52, 'large-functions', symbols || ' symbols in one file', 8 FROM st WHERE symbols >= 25
 UNION ALL SELECT path, 0, 53, 'api-contracts', signatures || ' complex public signature(s)', (6 * signatures)::INT FROM st WHERE signatures > 0),
p AS (SELECT path, lane, reason, greatest(1, weight >> least(row_number() OVER (PARTITION BY path, reason ORDER BY line, ordinal) - 1, 30)) AS points FROM a)"""
_EFFECTS = f"""e0 AS ({_hits(linescan.EFFECTS, "s")}),
e AS (SELECT DISTINCT path, kind, CASE WHEN strpos(text, '(') > 1 THEN trim(split_part(text, '(', 1), {_WS}) ELSE '' END AS op, number AS line, lane, weight, text FROM e0)"""
_NO_TESTS = f"{FILES}, {LINES}, s AS (SELECT * FROM l WHERE path NOT LIKE '%\\_test.go' ESCAPE '\\')"
_ROLE = "CASE " + " ".join(f"WHEN suffix IN ({', '.join(repr(n) for n in names)}) THEN '{role}'" for role, names in linescan.ROLES.items()) + " END"
_ROUTES = r"""g AS (SELECT path, number AS line, raw FROM l WHERE language = 'go' AND path NOT LIKE '%\_test.go' ESCAPE '\'),
a AS (SELECT path, line, regexp_extract(raw, '\b(?:\w+\.)?(?:HandleFunc|Handle)\(\s*"([^"]+)"\s*,\s*([A-Za-z_][\w.]*|\bfunc\b)', ['x', 'h']) AS m FROM g WHERE regexp_matches(raw, '\b(?:\w+\.)?(?:HandleFunc|Handle)\(\s*"([^"]+)"\s*,\s*([A-Za-z_][\w.]*|\bfunc\b)')),
b AS (SELECT path, line, regexp_extract(raw, '\b\w+\.(Get|Post|Put|Delete|Patch|Head|Options|Connect|Trace)\(\s*"(/[^"]*)"\s*,\s*([A-Za-z_][\w.]*|\bfunc\b)', ['v', 'x', 'h']) AS m FROM g WHERE regexp_matches(raw, '\b\w+\.(Get|Post|Put|Delete|Patch|Head|Options|Connect|Trace)\(\s*"(/[^"]*)"\s*,\s*([A-Za-z_][\w.]*|\bfunc\b)'))
SELECT 'net/http' AS framework, CASE WHEN contains(m.x, ' ') THEN split_part(m.x, ' ', 1) ELSE 'ANY' END AS method, CASE WHEN contains(m.x, ' ') THEN substr(m.x, strpos(m.x, ' ') + 1) ELSE m.x END AS pattern, CASE m.h WHEN 'func' THEN '<inline>' ELSE m.h END AS handler, path, line FROM a
UNION ALL SELECT 'chi', upper(m.v), m.x, CASE m.h WHEN 'func' THEN '<inline>' ELSE m.h END, path, line FROM b"""
ORACLES = {
    "import_edges": f"WITH {FILES}, {IMPORTS} SELECT DISTINCT path, module FROM im",
    "importers": f"WITH {FILES}, {IMPORTS} SELECT module, count(DISTINCT path)::BIGINT AS importers, (CASE WHEN count(DISTINCT path) <= 8 THEN 10 * count(DISTINCT path) ELSE 72 + count(DISTINCT path) END)::BIGINT AS score FROM im GROUP BY module",
    "risk_structure": f"WITH {FILES}, {LINES}, {IMPORTS}, {_STRUCTURE} SELECT path, depends_on, symbols, signatures FROM st",
    "risk_queue": f"WITH {_RISK} SELECT path, sum(points)::BIGINT AS score, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes, count(DISTINCT reason)::BIGINT AS reasons FROM p GROUP BY path",
    "risk_components": f"WITH {_RISK} SELECT path, reason, sum(points)::BIGINT AS points, count(*)::BIGINT AS matches FROM p GROUP BY path, reason",
    "risk_lanes": f"WITH {_RISK} SELECT lane, count(DISTINCT path)::BIGINT AS files, sum(points)::BIGINT AS points FROM p GROUP BY lane",
    "effects_by_kind": f"WITH {_NO_TESTS}, {_EFFECTS} SELECT kind, lane, count(*)::BIGINT AS effects, count(DISTINCT path)::BIGINT AS files FROM e GROUP BY kind, lane",
    "effects_by_file": f"WITH {_NO_TESTS}, {_EFFECTS} SELECT path, sum(weight)::BIGINT AS score, count(*)::BIGINT AS effects, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes FROM e GROUP BY path",
    "document_effects": f"WITH f AS (SELECT doc_id::VARCHAR AS path, repo, 'text' AS language, 'docs' AS class, text AS content FROM documents), {LINES}, s AS (SELECT * FROM l), {_EFFECTS} SELECT kind, count(*)::BIGINT AS effects, count(DISTINCT path)::BIGINT AS documents FROM e GROUP BY kind",
    "surface_counts": f"WITH {_NO_TESTS}, h AS ({_hits(linescan.SURFACE, 's')}) SELECT kind, count(*)::BIGINT AS hits, count(DISTINCT name)::BIGINT AS names FROM h GROUP BY kind",
    "change_markers": rf"WITH {FILES}, {LINES}, h AS (SELECT path, number, row_number() OVER (PARTITION BY path ORDER BY number) AS rn, count(*) OVER (PARTITION BY path)::BIGINT AS group_total FROM l WHERE regexp_matches(text, '\b(?:TODO|FIXME|HACK|XXX)\b')) SELECT path, number, group_total FROM h WHERE rn <= 12",
    "inventory_owners": rf"WITH {FILES}, {LINES}, s AS (SELECT * FROM l), {_EFFECTS}, o AS (SELECT path, regexp_extract(regexp_extract(text, '\b([A-Za-z_][\w.]*)\(', 1), '[^.]*$') AS suffix FROM e), w AS (SELECT path, {_ROLE} AS role FROM o) SELECT path, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*)::BIGINT AS evidence FROM w WHERE role IS NOT NULL GROUP BY path",
    "secret_files": rf"WITH {FILES}, {LINES} SELECT path, count(*)::BIGINT AS lines, min(number)::INT AS first FROM l WHERE regexp_matches(text, '(?i)\b(?:password|passwd|secret|api[_-]?key)\b\s*[:=]\s*\S') GROUP BY path",
    "line_counts": rf"WITH {FILES}, {LINES} SELECT language, count(*)::BIGINT AS lines, count_if(text = '')::BIGINT AS blank, count_if(regexp_matches(text, '^(?://|#|/\*|\*)'))::BIGINT AS comment FROM l GROUP BY language",
}
#: Registered over the sample tables only: the test tables hold no route.
SAMPLE_ONLY = {"routes": (routes_of, f"WITH {FILES}, {LINES}, {_ROUTES}")}
