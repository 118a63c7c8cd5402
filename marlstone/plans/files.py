"""Queries over captured files: languages, classes, caps, manifests, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import paths, text
from marlstone.operators import duplicates, running
from marlstone.session import load
from marlstone.sources import adapters

#: Ordered caps of a capture.
MAX_FILES, MAX_BYTES = 150, 200_000


def overview_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes per language."""
    f = adapters.files(spark, sf_dir)
    return f.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "language")


def overview_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, generated files, tests and distinct directories per repository."""
    f = adapters.files(spark, sf_dir)
    return f.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("generated").alias("generated"),
        F.count_if(F.col("class") == "test").alias("tests"),
        F.count_distinct(paths.directory(F.col("path"))).alias("packages"),
    )


def file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and language of every file."""
    return adapters.files(spark, sf_dir).select("path", "language", "generated", "class")


def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left after excluded folders."""
    return adapters.files(spark, sf_dir).filter(~paths.excluded(F.col("path"), ["vendor", "node_modules", "third_party", "external"])).groupBy("repo").agg(F.count(F.lit(1)).alias("files"))


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a list of globs selects."""
    return adapters.files(spark, sf_dir).filter(paths.glob_match(F.col("path"), ["**/*_test.go", "src/**/*.ts", "web/*/*.js"])).select("path")


def capture_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository: the files in path order until a cap on files or bytes stops the walk."""
    f = running.prefix_sums(adapters.files(spark, sf_dir).select("repo", "path", "size", F.lit(1).alias("one")), "repo", "path", {"n": "one", "bytes": "size"})
    return f.filter((F.col("n") <= MAX_FILES) & (F.col("bytes") <= MAX_BYTES)).groupBy("repo").agg(F.count(F.lit(1)).alias("shown"), F.max("bytes").alias("bytes"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash of every file."""
    return adapters.files(spark, sf_dir).select("path", F.sha2(F.col("content"), 256).alias("sha256"), text.bytes_of(F.col("content")).alias("bytes"), text.token_estimate(F.col("content")).alias("tokens"))


def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of each repository's content: sums of its entries' hashes, which partial sums make up in any order."""
    entry = F.sha2(F.concat_ws(" ", F.sha2(F.col("content"), 256), "path"), 256)
    parts = [F.sum(F.conv(F.substring(entry, i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias(f"sum{k}") for k, i in enumerate((1, 16))]
    return adapters.files(spark, sf_dir).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), *parts)


def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by backup suffix, name and size, or size and leading bytes, with their originals."""
    return duplicates.duplicate_files(adapters.files(spark, sf_dir).select(F.concat_ws("/", "repo", "path").alias("path"), "size", "content"))


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text occurs more than once, with the first of them."""
    return duplicates.same_content(load(spark, sf_dir, "documents"), "doc_id", "text")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored size against the content's size: the files a freshness check would reject."""
    f = adapters.files(spark, sf_dir)
    return f.filter(~F.col("size").eqNullSafe(text.bytes_of(F.col("content")))).select("path", "size", text.bytes_of(F.col("content")).alias("bytes"))


def path_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of every path."""
    return adapters.files(spark, sf_dir).select("path", F.explode(text.path_terms(F.col("path"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("path").alias("files"))


def request_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every held-out request."""
    return load(spark, sf_dir, "eval_cases").select("case_id", F.posexplode(text.expand_terms(F.col("request"))).alias("ordinal", "term"))


def content_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what most of their lines are: scratch notes, log lines, settings or meaningful text."""
    lines = F.filter(F.transform(F.split("text", "\n"), text.trimmed), lambda s: s != "")
    logs = F.size(F.filter(lines, lambda s: s.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}")))
    settings = F.size(F.filter(lines, lambda s: s.rlike(r"^[A-Za-z_][\w.-]*\s*[:=]\s*\S")))
    scratch = F.forall(lines, lambda s: s.rlike(r"^(?:[-*]\s*)?(?:TODO|FIXME|XXX)\b"))
    kind = (
        F.when(F.size(lines) == 0, "empty")
        .when(scratch, "todo-only")
        .when(2 * logs > F.size(lines), "log-dump")
        .when(2 * settings > F.size(lines), "config")
        .otherwise("meaningful")
    )
    return load(spark, sf_dir, "documents").select(kind.alias("content_class")).groupBy("content_class").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    q.__name__: q
    for q in (
        overview_languages, overview_repos, file_classes, path_filter, glob_filter, capture_prefix, manifest, snapshot_ids,
        duplicate_files, duplicate_texts, changed_files, path_terms, request_terms, content_classes,
    )
}

EXT = r"lower(regexp_extract(path, '\.[^./]*$'))"
LANGUAGE = (
    f"CASE WHEN {EXT} = '.go' THEN 'go' WHEN {EXT} = '.py' THEN 'python' WHEN {EXT} = '.java' THEN 'java' WHEN {EXT} IN ('.js', '.mjs', '.cjs') THEN 'javascript' "
    f"WHEN {EXT} = '.ts' THEN 'typescript' WHEN {EXT} = '.tsx' THEN 'tsx' WHEN {EXT} = '.jsx' THEN 'jsx' ELSE 'unknown' END"
)
GENERATED = "(path LIKE '%.gen.go' OR path LIKE '%\\_generated.go' ESCAPE '\\')"
CLASS = f"""CASE WHEN {GENERATED} OR list_contains(string_split(lower(path), '/'), 'generated') THEN 'generated'
 WHEN list_has_any(string_split(lower(path), '/'), ['vendor', 'node_modules', 'third_party']) THEN 'vendor'
 WHEN lower(path) LIKE '%\\_test.go' ESCAPE '\\' OR list_has_any(string_split(lower(path), '/'), ['test', 'tests']) THEN 'test'
 WHEN list_has_any(string_split(lower(path), '/'), ['testdata', 'fixtures', 'fixture']) THEN 'fixture'
 WHEN list_contains(string_split(lower(path), '/'), 'docs') OR regexp_matches(lower(path), '(^|/)(readme|contributing|changelog|license)\\.md$') THEN 'docs'
 WHEN list_has_any(string_split(lower(path), '/'), ['example', 'examples']) OR regexp_matches(lower(path), '(^|/)example_[^/]*$') THEN 'example'
 WHEN list_has_any(string_split(lower(path), '/'), ['.work', 'receipts', 'artifacts', 'benchmarks']) OR lower(path) LIKE '%.jsonl' THEN 'receipt/data'
 WHEN {LANGUAGE} <> 'unknown' THEN 'production' ELSE 'unknown' END"""
FILES = f"f AS (SELECT file_id, repo, path, size, content, {LANGUAGE} AS language, {GENERATED} AS generated, {CLASS} AS class FROM source_files)"
_DIR = "CASE WHEN regexp_replace(path, '/?[^/]*$', '') = '' THEN '.' ELSE regexp_replace(path, '/?[^/]*$', '') END"
#: Camel-case boundaries without look-around: an underscore before each capital that follows a lower-case letter or digit, then inside of runs.
_SNAKE = r"regexp_replace(regexp_replace({t}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1_\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1_\2', 'g')"


def _split_sql(t: str) -> str:
    parts = f"list_filter(string_split(lower(CASE WHEN contains({t}, '_') THEN {t} ELSE {_SNAKE.format(t=t)} END), '_'), lambda p: p <> '')"
    return f"CASE WHEN len({parts}) < 2 THEN [lower({t})] ELSE list_concat([lower({t})], {parts}) END"


ORACLES = {
    "overview_languages": f"WITH {FILES} SELECT language, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY language",
    "overview_repos": f"WITH {FILES} SELECT repo, count(*)::BIGINT AS files, count_if(generated)::BIGINT AS generated, count_if(class = 'test')::BIGINT AS tests, count(DISTINCT {_DIR})::BIGINT AS packages FROM f GROUP BY repo",
    "file_classes": f"WITH {FILES} SELECT path, language, generated, class FROM f",
    "path_filter": "SELECT repo, count(*)::BIGINT AS files FROM source_files WHERE NOT regexp_matches(path, '^(vendor|node_modules|third_party|external)(/|$)') GROUP BY repo",
    "glob_filter": r"SELECT path FROM source_files WHERE regexp_matches(path, '^(.*/)?[^/]*_test\.go$') OR regexp_matches(path, '^src/(.*/)?[^/]*\.ts$') OR regexp_matches(path, '^web/[^/]*/[^/]*\.js$')",
    "capture_prefix": f"""WITH w AS (SELECT repo, path, count(*) OVER (PARTITION BY repo ORDER BY path) AS n, sum(size) OVER (PARTITION BY repo ORDER BY path) AS bytes FROM source_files)
SELECT repo, count(*)::BIGINT AS shown, max(bytes)::BIGINT AS bytes FROM w WHERE n <= {MAX_FILES} AND bytes <= {MAX_BYTES} GROUP BY repo""",
    "manifest": "SELECT path, sha256(content) AS sha256, strlen(content)::BIGINT AS bytes, ((strlen(content) + 3) // 4)::BIGINT AS tokens FROM source_files",
    "snapshot_ids": """WITH e AS (SELECT repo, sha256(sha256(content) || ' ' || path) AS h FROM source_files)
SELECT repo, count(*)::BIGINT AS files, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR AS sum0, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS sum1 FROM e GROUP BY repo""",
    "duplicate_texts": "WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS original, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT doc_id, original FROM g WHERE doc_id <> original",
    "changed_files": "SELECT path, size, strlen(content)::BIGINT AS bytes FROM source_files WHERE size IS DISTINCT FROM strlen(content)",
    "path_terms": rf"""WITH s AS (SELECT path, unnest(string_split(path, '/')) AS seg FROM source_files), t AS (SELECT path, regexp_replace(seg, '\.[^.]*$', '') AS stem FROM s WHERE seg NOT IN ('', '.', '..')),
e AS (SELECT path, unnest({_split_sql("stem")}) AS term FROM t WHERE stem <> '') SELECT term, count(*)::BIGINT AS uses, count(DISTINCT path)::BIGINT AS files FROM e GROUP BY term""",
    "request_terms": rf"""WITH w AS (SELECT case_id, unnest(regexp_extract_all(request, '[\p{{L}}\p{{Nd}}]+')) AS w, generate_subscripts(regexp_extract_all(request, '[\p{{L}}\p{{Nd}}]+'), 1) AS i FROM eval_cases),
e AS (SELECT case_id, i, unnest({_split_sql("w")}) AS term, generate_subscripts({_split_sql("w")}, 1) AS j FROM w),
d AS (SELECT case_id, term, min((i, j)) AS pos FROM e WHERE length(term) >= 3 AND term NOT IN ('the', 'and', 'for', 'with', 'into', 'that', 'this', 'from', 'add', 'fix') GROUP BY case_id, term)
SELECT case_id, (row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1)::INT AS ordinal, term FROM d""",
    "content_classes": r"""WITH l AS (SELECT list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12))), lambda s: s <> '') AS x FROM documents)
SELECT CASE WHEN len(x) = 0 THEN 'empty' WHEN len(list_filter(x, lambda s: NOT regexp_matches(s, '^(?:[-*]\s*)?(?:TODO|FIXME|XXX)\b'))) = 0 THEN 'todo-only'
 WHEN 2 * len(list_filter(x, lambda s: regexp_matches(s, '^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}'))) > len(x) THEN 'log-dump'
 WHEN 2 * len(list_filter(x, lambda s: regexp_matches(s, '^[A-Za-z_][\w.-]*\s*[:=]\s*\S'))) > len(x) THEN 'config' ELSE 'meaningful' END AS content_class, count(*)::BIGINT AS documents FROM l GROUP BY 1""",
    "duplicate_files": r"""WITH b AS (SELECT concat_ws('/', repo, path) AS path, size, substr(sha256(CAST(content AS BLOB)), 1, 64) AS whole, content FROM source_files),
x AS (SELECT path, size, regexp_extract(path, '[^/]*$') AS base, content FROM b),
s1 AS (SELECT x.path, 'backup-suffix' AS signal, 1 AS pri, o.path AS original FROM x JOIN x o ON o.path = regexp_replace(x.path, '(\.bak|\.orig|\.old|~)$', '') AND o.path <> x.path),
g AS (SELECT path, size, base, content, first_value(path) OVER (PARTITION BY base, size ORDER BY strlen(path), path) AS o2, first_value(path) OVER (PARTITION BY size, content ORDER BY strlen(path), path) AS o3 FROM x WHERE size > 4096),
u AS (SELECT * FROM s1 UNION ALL SELECT path, 'name-size', 2, o2 FROM g WHERE o2 <> path UNION ALL SELECT path, 'content', 3, o3 FROM g WHERE o3 <> path)
SELECT path, signal, original FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pri) AS rn FROM u) WHERE rn = 1""",
}
