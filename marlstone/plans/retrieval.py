"""Queries of retrieval, its evaluation, and file ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import declarations, graphs, imports, ranking, resolution, retrieval, tasks
from marlstone.plans.code_graph import SYMBOLS
from marlstone.plans.scans import IMPORTS
from marlstone.session import load, materialize
from marlstone.sources import adapters

INTENT = "scan the handler tokens and fold each ledgerBudget"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("query"), F.col("passage").alias("request"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a sentence with the passage."""

    def sentences(df: DataFrame, key: str, body: str) -> DataFrame:
        return df.select(F.col(key), F.explode(F.split(body, r"\. |\.\n|\.$")).alias("s")).filter(F.length("s") >= 30).distinct()

    cases = sentences(load(spark, sf_dir, "eval_cases").withColumnRenamed("case_id", "query"), "query", "passage")
    return cases.join(sentences(_documents(spark, sf_dir), "doc", "text"), "s").select("query", "doc").distinct()


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(_documents(spark, sf_dir), "doc", "text", _queries(spark, sf_dir), "query", "request")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every held-out passage."""
    return _ranked(spark, sf_dir)


def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best files of every request, by content and path."""
    docs = load(spark, sf_dir, "source_files").filter("content is not null").select(F.col("path").alias("doc"), F.concat_ws(" ", "content", F.translate("path", "/", " ")).alias("text"))
    asked = load(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("query"), "request")
    return retrieval.bm25(docs, "doc", "text", asked, "query", "request")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and NDCG of every request with gold."""
    return retrieval.metrics(_ranked(spark, sf_dir), _gold(spark, sf_dir))


def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the metrics."""
    return _means(retrieval_metrics(spark, sf_dir))


def _means(m: DataFrame) -> DataFrame:
    return m.agg(F.count(F.lit(1)).alias("cases"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in m.columns if c != "query"])


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = _documents(spark, sf_dir).select("doc", text.token_estimate(F.col("text")).alias("tokens"))
    return retrieval.first_relevant_cost(_ranked(spark, sf_dir), _gold(spark, sf_dir), cost)


def first_relevant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens read before the first relevant document."""
    return _costs(spark, sf_dir)


def recall_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of requests answered within each budget."""
    return retrieval.recall_at_budgets(_costs(spark, sf_dir))


def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out cases per classification, and whether there are enough of them to judge."""
    n = load(spark, sf_dir, "eval_cases").groupBy("classification").agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("category").alias("categories"))
    return n.withColumn("enough", F.col("cases") >= 25)


def _parts(spark: SparkSession, sf_dir: str, intent: str = "", reference: bool = False) -> tuple[DataFrame, DataFrame]:
    files = adapters.files(spark, sf_dir)
    lines = adapters.source_lines(files)
    symbols = materialize(declarations.symbols(lines).select("path", "line", "name", "kind", "exported"))
    edges = declarations.call_edges(symbols, declarations.calls(lines)).filter("src <> dst")
    callers = edges.groupBy("symbol", "dst").agg(F.count_distinct("src").alias("callers")).withColumn("score", F.least(F.lit(20), 2 * F.col("callers")))
    slim = files.select("path", "language", "class")
    found = imports.import_edges(files.select("path", "language", "content"))
    imported = imports.imported_files(imports.internal_imports(found, slim), slim)
    bonus = None
    if reference:
        edges = materialize(resolution.reference_edges(resolution.resolve(resolution.bindings(lines), slim, symbols), symbols))
        bonus = graphs.rank_bonus(edges, graphs.pagerank(edges))
    return slim, ranking.components(slim, symbols, callers, intent, imported, reference=bonus)


def rank_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every component of every file, without a request."""
    return _parts(spark, sf_dir)[1]


def rank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, score) of every file, without a request."""
    return materialize(ranking.ranked(*_parts(spark, sf_dir)))


def file_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by score for a request, with the ranks of the reference graph."""
    files, parts = _parts(spark, sf_dir, INTENT, True)
    return ranking.ranked(files, parts).orderBy(F.desc("score"), "path")


def goal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the order of a goal: those with evidence by relevance, then the rest by rank."""
    from marlstone.plans.structure import evidence_of

    files, parts = _parts(spark, sf_dir)
    return tasks.order_for_goal(ranking.ranked(files, parts), evidence_of(spark, sf_dir, INTENT))


def explain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, symbols, detail level and what is left out of every file under a budget of 256 tokens for each."""
    files, parts = _parts(spark, sf_dir)
    symbols = declarations.symbols(adapters.source_lines(adapters.files(spark, sf_dir)))
    return ranking.explain(files, ranking.ranked(files, parts), symbols, 256)


def rank_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each confidence tier per file."""
    return _parts(spark, sf_dir)[1].groupBy("path", ranking.tier(F.col("component")).alias("tier")).agg(F.sum("points").cast("long").alias("points"))


def header_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose headers fit a budget of 1,024 tokens."""
    files, parts = _parts(spark, sf_dir)
    return ranking.header_cutoff(ranking.ranked(files, parts), 1024).filter("shown").select("path", "position")


def file_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calling files, tests beside it and risk level of every file whose functions others call."""
    files = adapters.files(spark, sf_dir)
    lines = adapters.source_lines(files)
    symbols = declarations.symbols(lines)
    edges = declarations.call_edges(symbols, declarations.calls(lines)).filter("src <> dst")
    users = edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("users"))
    exported = symbols.filter("exported").select("path").distinct().withColumn("exported", F.lit(True))
    tested = files.filter(F.col("path").endswith("_test.go")).select(F.regexp_replace("path", r"_test\.go$", ".go").alias("path")).distinct().withColumn("tested", F.lit(True))
    joined = users.join(exported, "path", "left").join(tested, "path", "left")
    level = F.when(F.col("users") > 10, "high").when((F.col("users") > 3) | (F.col("exported").isNotNull() & F.col("tested").isNull()), "medium").otherwise("low")
    return joined.select("path", "users", level.alias("risk"))


QUERIES = {q.__name__: q for q in (bm25_topk, retrieval_metrics, mean_metrics, first_relevant_tokens, recall_at_budget, eval_gate, rank_components, file_rank, rank_tiers, header_cutoff, file_impact, file_search, goal_order, explain_files)}

_BM = r"""q AS (SELECT case_id AS query, passage AS request FROM eval_cases),
qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest(regexp_extract_all(lower(request), '[a-z0-9_]+')) AS term FROM q) GROUP BY query, term),
dt AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
ln AS (SELECT doc_id AS doc, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS length FROM documents),
c AS (SELECT count(*) AS n, avg(length) AS average FROM ln),
tf AS (SELECT doc, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query, doc, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))) AS s FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN ln USING (doc), c GROUP BY query, doc),
al AS (SELECT q.query, d.doc_id AS doc, round(coalesce(s, 0.0), 9) AS score FROM q CROSS JOIN documents d LEFT JOIN sc ON sc.query = q.query AND sc.doc = d.doc_id),
rk AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INT AS rank FROM al), top AS (SELECT * FROM rk WHERE rank <= 20)"""
_GOLD = r"""gs AS (SELECT DISTINCT query, s FROM (SELECT case_id AS query, unnest(regexp_split_to_array(passage, '\. |\.\n|\.$')) AS s FROM eval_cases) WHERE length(s) >= 30),
ds AS (SELECT DISTINCT doc, s FROM (SELECT doc_id AS doc, unnest(regexp_split_to_array(text, '\. |\.\n|\.$')) AS s FROM documents) WHERE length(s) >= 30),
gold AS (SELECT DISTINCT query, doc FROM gs JOIN ds USING (s))"""
_METRICS = f"""{_BM}, {_GOLD}, g AS (SELECT query, count(*) AS gold FROM gold GROUP BY query),
h AS (SELECT query, count_if(rank <= 1) AS h1, count_if(rank <= 5) AS h5, count_if(rank <= 10) AS h10, count_if(rank <= 20) AS h20, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM top JOIN gold USING (query, doc) GROUP BY query),
m AS (SELECT query, coalesce(h1 / gold, 0.0) AS recall_at_1, coalesce(h5 / gold, 0.0) AS recall_at_5, coalesce(h10 / gold, 0.0) AS recall_at_10, coalesce(h20 / gold, 0.0) AS recall_at_20, coalesce(1 / first, 0.0)::DOUBLE AS mrr,
 coalesce(CASE WHEN h10 > 0 THEN dcg / list_sum(list_transform(range(1, (h10 + 1)::BIGINT), lambda i: 1 / log2(i + 1))) END, 0.0)::DOUBLE AS ndcg_at_10 FROM g LEFT JOIN h USING (query))"""
_COSTS = f"""{_BM}, {_GOLD}, sp AS (SELECT query, doc, sum((strlen(text) + 3) // 4) OVER (PARTITION BY query ORDER BY rank) AS spent FROM top JOIN documents ON doc_id = doc),
k AS (SELECT query, coalesce(min(spent), 32000)::BIGINT AS tokens FROM (SELECT DISTINCT query FROM gold) LEFT JOIN (SELECT query, spent FROM sp JOIN gold USING (query, doc)) USING (query) GROUP BY query)"""
_NAME = "regexp_extract(path, '[^/]*$')"
_USERS = rf"""u AS (SELECT name, min(path) AS dst, min(line) AS declared FROM s GROUP BY name HAVING count(*) = 1),
cl AS (SELECT path, number AS line, unnest(regexp_extract_all(text, '\b([A-Za-z_]\w*)\(', 1)) AS name FROM l),
e AS (SELECT cl.path AS src, u.dst, cl.name AS symbol FROM cl JOIN u USING (name) WHERE cl.name NOT IN ({', '.join(repr(x) for x in declarations.NO_CALLS)}) AND cl.path <> u.dst)"""
_COMPONENTS = rf"""{SYMBOLS}, {_USERS}, {IMPORTS}, fo AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM f WHERE language = 'go'),
ii AS (SELECT path, arg_max(folder, strlen(folder)) AS folder FROM im JOIN fo ON language = 'go' AND folder <> '' AND (module = folder OR ends_with(module, '/' || folder)) GROUP BY path, module), imp AS (SELECT folder, count(DISTINCT path) AS importers FROM ii GROUP BY folder),
cc AS (SELECT symbol, dst, least(20, 2 * count(DISTINCT src)) AS score FROM e GROUP BY symbol, dst),
parts AS (SELECT * FROM (
 SELECT path, 'entry' AS component, (CASE {_NAME} WHEN 'main.go' THEN 40 WHEN 'main.ts' THEN 30 WHEN 'index.ts' THEN 30 WHEN 'index.js' THEN 30 WHEN 'app.py' THEN 30 WHEN 'main.py' THEN 30 WHEN 'main.rs' THEN 30 ELSE 0 END)::BIGINT AS points FROM f
 UNION ALL SELECT path, 'orientation', least(35, (CASE WHEN language = 'go' AND regexp_replace({_NAME}, '\.[^.]*$', '') = string_split(path, '/')[-2] THEN 25 ELSE 0 END) + (CASE WHEN {_NAME} = 'types.go' THEN 20 ELSE 0 END) + (CASE WHEN path NOT LIKE '%/%' AND path LIKE '%.go' AND path NOT LIKE '%\_test.go' ESCAPE '\' THEN 8 ELSE 0 END))::BIGINT FROM f
 UNION ALL SELECT path, 'depth', least(0, 2 - (len(string_split(path, '/')) - 1))::BIGINT FROM f
 UNION ALL SELECT path, 'test_demote', (CASE WHEN path LIKE '%\_test.go' ESCAPE '\' THEN -15 ELSE 0 END)::BIGINT FROM f
 UNION ALL SELECT path, 'class_demote', ((CASE WHEN class = 'test' AND path LIKE '%\_test.go' ESCAPE '\' THEN 0 ELSE CASE class WHEN 'example' THEN -12 WHEN 'vendor' THEN -20 WHEN 'generated' THEN -20 WHEN 'docs' THEN -6 WHEN 'test' THEN -10 ELSE 0 END END) + (CASE WHEN list_has_any(string_split(path, '/'), ['compat', '_compat', 'legacy']) THEN -12 ELSE 0 END))::BIGINT FROM f
 UNION ALL SELECT path, 'symbols', least(20, sum(CASE kind WHEN 'interface' THEN 3 WHEN 'type' THEN 3 WHEN 'struct' THEN 2 WHEN 'constant' THEN 0 WHEN 'variable' THEN 0 ELSE 1 END))::BIGINT FROM s WHERE exported GROUP BY path
 UNION ALL SELECT dst, 'callers', least(20, max(score))::BIGINT FROM cc GROUP BY dst
 UNION ALL SELECT path, 'tests', 4 FROM f WHERE path NOT LIKE '%\_test.go' ESCAPE '\' AND regexp_replace(path, '/?[^/]*$', '') IN (SELECT regexp_replace(path, '/?[^/]*$', '') FROM f WHERE path LIKE '%\_test.go' ESCAPE '\')
 UNION ALL SELECT f.path, 'imports', CASE WHEN importers <= 8 THEN 10 * importers ELSE 72 + importers END FROM f JOIN imp ON f.language = 'go' AND regexp_replace(f.path, '/?[^/]*$', '') = imp.folder) WHERE points <> 0)"""
_FILE_BM = "documents AS (SELECT path AS doc_id, concat_ws(' ', content, replace(path, '/', ' ')) AS text FROM source_files WHERE content IS NOT NULL), " + _BM.replace("passage AS request", "request")
_EXPLAIN = rf"""{_COMPONENTS}, rk AS (SELECT f.path, f.language, coalesce(sum(points), 0)::BIGINT AS score FROM f LEFT JOIN parts USING (path) GROUP BY f.path, f.language),
ct AS (SELECT path, count(*) AS n, sum(32 + strlen(name) + strlen(kind) + strlen(signature)) AS full FROM s GROUP BY path),
ex AS (SELECT rk.path, score, coalesce(n, 0)::BIGINT AS symbols, strlen(rk.path) + 30 AS header, n * 20 AS summary, "full", rk.language FROM rk LEFT JOIN ct USING (path)),
lv AS (SELECT *, CASE WHEN header > 716 THEN -1 WHEN symbols = 0 OR header + summary > 1024 THEN 0 WHEN header + "full" > 1024 THEN 1 ELSE 2 END AS level FROM ex)"""
ORACLES = {
    "file_search": f"WITH {_FILE_BM} SELECT query, rank, doc, score FROM top",
    "explain_files": f"WITH {_EXPLAIN} SELECT path, score, symbols, level, CASE WHEN language = 'go' THEN 'confirmed' END AS parse_confidence, CASE WHEN symbols = 0 THEN 'no symbol evidence was available for this file' WHEN level < 0 THEN 'omitted: token budget could not fit the file header' WHEN level = 0 THEN 'header only: token budget did not fit symbol detail' WHEN level = 1 THEN 'summary only: token budget did not fit full symbols' END AS omitted FROM lv",
    "bm25_topk": f"WITH {_BM} SELECT query, rank, doc, score FROM top",
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "mean_metrics": f"WITH {_METRICS} SELECT count(*)::BIGINT AS cases, {', '.join(f'coalesce(avg({c}), 0.0)::DOUBLE AS {c}' for c in ('recall_at_1', 'recall_at_5', 'recall_at_10', 'recall_at_20', 'mrr', 'ndcg_at_10'))} FROM m",
    "first_relevant_tokens": f"WITH {_COSTS} SELECT query, tokens FROM k",
    "recall_at_budget": f"WITH {_COSTS}, b AS (SELECT unnest([500, 1000, 2000, 4000, 8000, 16000, 32000])::BIGINT AS budget) SELECT budget, avg((tokens <= budget)::INT)::DOUBLE AS recall FROM k, b GROUP BY budget",
    "eval_gate": "SELECT classification, count(*)::BIGINT AS cases, count(DISTINCT category)::BIGINT AS categories, count(*) >= 25 AS enough FROM eval_cases GROUP BY classification",
    "rank_components": f"WITH {_COMPONENTS} SELECT path, component, points FROM parts",
    "rank_tiers": f"WITH {_COMPONENTS} SELECT path, CASE component WHEN 'callers' THEN 'lexical' WHEN 'intent' THEN 'contextual' WHEN 'consumed' THEN 'contextual' ELSE 'confirmed' END AS tier, sum(points)::BIGINT AS points FROM parts GROUP BY 1, 2",
    "header_cutoff": f"WITH {_COMPONENTS}, r AS (SELECT f.path, coalesce(sum(points), 0) AS score FROM f LEFT JOIN parts USING (path) GROUP BY f.path), w AS (SELECT path, row_number() OVER (ORDER BY score DESC, path)::INT AS position, sum(strlen(path) + 30) OVER (ORDER BY score DESC, path) AS cost FROM r) SELECT path, position FROM w WHERE cost <= 2867",
    "file_impact": rf"WITH {SYMBOLS}, {_USERS}, n AS (SELECT dst AS path, count(DISTINCT src)::BIGINT AS users FROM e GROUP BY dst) SELECT path, users, CASE WHEN users > 10 THEN 'high' WHEN users > 3 OR (path IN (SELECT path FROM s WHERE exported) AND path NOT IN (SELECT regexp_replace(path, '_test\.go$', '.go') FROM f WHERE path LIKE '%\_test.go' ESCAPE '\')) THEN 'medium' ELSE 'low' END AS risk FROM n",
}

# the candidates are ordered by the ranking, so their SQL stands on its own
from marlstone.plans import structure as _structure  # noqa: E402

_structure.ORACLES["task_candidates"] = _structure.candidates_sql(_COMPONENTS.replace("ex AS", "ex_ AS"))
