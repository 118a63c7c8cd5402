"""Queries over declarations, calls and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import declarations, duplicates, graphs
from marlstone.plans.files import FILES
from marlstone.plans.scans import LINES
from marlstone.session import load, materialize
from marlstone.sources import adapters


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.source_lines(adapters.files(spark, sf_dir))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return declarations.symbols(_lines(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return declarations.call_edges(declarations.symbols(lines), declarations.calls(lines))


def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of each kind per language."""
    return _symbols(spark, sf_dir).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.count_if("exported").alias("exported"))


def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that match a name, by grade."""
    scored = _symbols(spark, sf_dir).withColumn("score", declarations.match_score(F.col("name"), "fold"))
    return scored.filter("score > 0").select("path", "line", "name", "kind", "score").orderBy(F.desc("score"), "path", "line", "name")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that lead to the only declaration of their name."""
    return _calls(spark, sf_dir)


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct calling files of each called symbol, and its score."""
    n = _calls(spark, sf_dir).filter("src <> dst").groupBy("symbol", "dst").agg(F.count_distinct("src").alias("callers"))
    return n.withColumn("score", F.least(F.lit(20), 2 * F.col("callers")).cast("long"))


def orphan_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported symbols by use."""
    lines = _lines(spark, sf_dir)
    return declarations.orphan_classes(declarations.symbols(lines), declarations.occurrences(lines))


def dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unexported functions and types whose name occurs nowhere but in declarations."""
    lines = _lines(spark, sf_dir)
    symbols = declarations.symbols(lines)
    declared = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("declared"))
    seen = declarations.occurrences(lines).select("name", (F.col("test") + F.col("other")).alias("seen"))
    mine = symbols.filter(~F.col("exported") & ~F.col("name").isin("main", "init", "_") & ~F.col("name").startswith("Test"))
    return mine.join(declared, "name").join(seen, "name").filter("seen <= declared").select("path", "line", "name", "kind")


def repeated_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures that stand in more than one place, with the first four."""
    bodies = _symbols(spark, sf_dir).select("path", "line", "language", "kind", F.sha2("signature", 256).alias("body_hash"))
    found = duplicates.repeated_bodies(bodies, ["language", "kind"])
    return found.select("language", "kind", "body_hash", "sites", F.concat_ws(" ", "shown").alias("shown"))


def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonus of files (but Go's) whose exported names other files use: 2 a file, 24 at most; names that over 40 % of the files declare don't count."""
    lines = _lines(spark, sf_dir)
    declared = declarations.symbols(lines).filter(F.col("exported") & (F.col("language") != "go") & (F.octet_length("name") >= 4)).select("name", F.col("path").alias("dst"))
    limit = adapters.files(spark, sf_dir).agg(F.expr("count(1) * 40 div 100").alias("most"))
    # names that many files declare go before anything is joined
    targets = declared.groupBy("name").agg(F.count(F.lit(1)).alias("targets")).crossJoin(F.broadcast(limit)).filter((F.col("most") < 2) | (F.col("targets") <= F.col("most"))).select("name")
    names = declared.distinct().join(targets, "name")
    words = lines.select("path", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"[\p{L}_][\p{L}\p{Nd}_]*"), F.lit(0)))).alias("name")).join(targets, "name", "left_semi").distinct()
    used = words.join(names, "name").filter("path <> dst").select("dst", "path").distinct()
    return used.groupBy("dst").agg(F.count(F.lit(1)).alias("users")).select(F.col("dst").alias("path"), F.least(F.lit(24), 2 * F.col("users")).cast("long").alias("bonus"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a supplier to the next one of the same order."""
    from pyspark.sql import Window

    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nxt = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return lines.select(F.col("l_suppkey").alias("src"), nxt.alias("dst")).filter("dst is not null")


def _file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from a calling file to the file that declares what it calls."""
    return materialize(graphs.distinct_edges(_calls(spark, sf_dir).filter("src <> dst")))


def call_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong component of every file of the call graph."""
    return graphs.strong_components(_file_calls(spark, sf_dir))


def call_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the call graph that hold a cycle."""
    edges = _file_calls(spark, sf_dir)
    return graphs.cycles(edges, graphs.strong_components(edges))


def call_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 files with most neighbours in the call graph."""
    return graphs.hubs(_file_calls(spark, sf_dir))


def duplicate_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of Go functions that occur in more than one place of the capture, whatever their packages."""
    found = duplicates.repeated_bodies(duplicates.go_bodies(adapters.files(spark, sf_dir)), ["kind"])
    return found.select("kind", "sites", F.concat_ws(" ", "shown").alias("shown"))


def symbol_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that ``kind:function:file:src/:fold`` finds, by grade."""
    return declarations.find(_symbols(spark, sf_dir), "kind:Function:file:src/:fold").select("path", "line", "name", "kind", "score")


def canonical_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol with its place in canonical order within its file."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("path").orderBy("line", "name", "kind"))
    return _symbols(spark, sf_dir).select("path", "line", "name", "kind", nth.alias("ordinal"))


def graph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and distinct edges of the call graph and the trade graph."""
    both = _calls(spark, sf_dir).select(F.lit("calls").alias("kind"), "src", "dst").unionByName(_trade(spark, sf_dir).select(F.lit("trades").alias("kind"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src", "dst").alias("pairs"))


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct neighbours of every node of the trade graph."""
    return graphs.degrees(_trade(spark, sf_dir))


def graph_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 nodes with most neighbours."""
    return graphs.hubs(_trade(spark, sf_dir))


def _importers(edges: DataFrame) -> DataFrame:
    n = graphs.distinct_edges(edges).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("importers"))
    return n.withColumn("score", graphs.import_score(F.col("importers")).cast("long"))


def importer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the number of distinct sources of every node of the trade graph."""
    return _importers(_trade(spark, sf_dir))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).filter("src <> dst").groupBy("src", "dst").agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("weight"))


def pagerank_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of the trade graph as points up to 30."""
    edges = _weighted(spark, sf_dir)
    return graphs.rank_bonus(edges, graphs.pagerank(edges))


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong component of every node of the trade graph."""
    return graphs.strong_components(_trade(spark, sf_dir))


def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the trade graph that hold a cycle."""
    edges = materialize(graphs.distinct_edges(_trade(spark, sf_dir)))
    return graphs.cycles(edges, graphs.strong_components(edges))


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trade graph that its smallest source reaches, with the fewest steps."""
    edges = materialize(graphs.distinct_edges(_trade(spark, sf_dir)))
    return graphs.reachable(edges, edges.agg(F.min("src").alias("node")))


def suffix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone names joined to captured paths by their longest suffix."""
    pairs = load(spark, sf_dir, "clone_pairs")
    names = pairs.select(F.col("first_file_name").alias("name")).union(pairs.select("second_file_name")).select(F.regexp_replace(F.translate("name", "\\", "/"), r"^(?:\./)+", "").alias("name"))
    return graphs.suffix_join(names, "name", load(spark, sf_dir, "source_files"), "path")


QUERIES = {
    q.__name__: q
    for q in (
        symbol_kinds, find_symbol, call_edges, callers, orphan_symbols, dead_symbols, repeated_declarations, symbol_references,
        graph_kinds, graph_degrees, graph_hubs, importer_scores, pagerank_bonus, strong_components, graph_cycles, reach, suffix_matches,
        call_components, call_cycles, call_hubs, duplicate_bodies, symbol_query, canonical_symbols,
    )
}

_OPT = " ".join(f"WHEN language IN ({', '.join(repr(x) for x in langs)}) AND regexp_matches(raw, '{p}') THEN {i}" for i, (langs, _, p) in enumerate(declarations.RULES))
_KIND = " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k, _) in enumerate(declarations.RULES))
_NAME = " ".join(f"WHEN {i} THEN regexp_extract(raw, '{p}', 1)" for i, (_, _, p) in enumerate(declarations.RULES))
SYMBOLS = f"""{FILES}, {LINES}, s0 AS (SELECT *, CASE {_OPT} END AS rule FROM l),
s1 AS (SELECT path, repo, language, class, number AS line, CASE rule {_NAME} END AS name, CASE rule {_KIND} END AS kind, text AS signature, raw FROM s0 WHERE rule IS NOT NULL),
s AS (SELECT *, CASE WHEN language = 'go' THEN regexp_matches(name, '^[A-Z]') WHEN language = 'python' THEN regexp_matches(name, '^[^_]') WHEN language = 'java' THEN contains(raw, 'public ') ELSE raw LIKE 'export %' END AS exported FROM s1)"""
_CALLS = rf"""{SYMBOLS}, u AS (SELECT name, min(path) AS dst, min(line) AS declared FROM s GROUP BY name HAVING count(*) = 1),
c AS (SELECT path, number AS line, unnest(regexp_extract_all(text, '\b([A-Za-z_]\w*)\(', 1)) AS name FROM l),
e AS (SELECT c.path AS src, u.dst, c.name AS symbol, c.line FROM c JOIN u USING (name) WHERE c.name NOT IN ({', '.join(repr(x) for x in declarations.NO_CALLS)}) AND NOT (c.path = u.dst AND c.line = u.declared))"""
_TEST = "(path LIKE '%\\_test.go' ESCAPE '\\' OR class = 'test')"
_SEEN = r"w AS (SELECT unnest(regexp_extract_all(raw, '[A-Za-z_]\w*')) AS name, path, class FROM l)"
_SEEN += f", n AS (SELECT name, count_if{_TEST} AS test, count_if(NOT {_TEST}) AS other FROM w GROUP BY name)"


def _trade_sql() -> str:
    return "t0 AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem), t AS (SELECT * FROM t0 WHERE dst IS NOT NULL)"


_COMPONENTS = """d AS (SELECT DISTINCT src, dst FROM t), v AS (SELECT src AS node FROM d UNION SELECT dst FROM d),
r(a, b) AS (SELECT node, node FROM v UNION SELECT r.a, d.dst FROM r JOIN d ON d.src = r.b),
k AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""
_SCC = f"{_trade_sql()}, {_COMPONENTS}"
_CALL_GRAPH = f"{_CALLS}, t AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)"
_CYCLES = "o AS (SELECT DISTINCT src AS node, 1 AS loop FROM t WHERE src = dst) SELECT component, count(*)::BIGINT AS nodes FROM k LEFT JOIN o USING (node) GROUP BY component HAVING count(*) > 1 OR max(loop) = 1"
_DEG = "g AS (SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM (SELECT DISTINCT src, dst FROM t) UNION ALL SELECT dst, 1, 0 FROM (SELECT DISTINCT src, dst FROM t)) GROUP BY node)"
ORACLES = {
    "call_components": f"WITH RECURSIVE {_CALL_GRAPH}, {_COMPONENTS} SELECT node, component FROM k",
    "call_cycles": f"WITH RECURSIVE {_CALL_GRAPH}, {_COMPONENTS}, {_CYCLES}",
    "call_hubs": f"WITH {_CALL_GRAPH}, {_DEG} SELECT *, in_degree + out_degree AS degree FROM g ORDER BY degree DESC, node LIMIT 25",
    "duplicate_bodies": rf"""WITH {FILES}, g AS (SELECT path, content, unnest(regexp_extract_all(content, '(?m)^func [^\n]*\{{\n(?:[^}}\n][^\n]*\n|\n)*\}}')) AS src FROM f WHERE language = 'go' AND NOT generated AND path NOT LIKE '%\_test.go' ESCAPE '\'),
b AS (SELECT path, len(string_split(content[1:strpos(content, src) - 1], chr(10)))::INT AS line, CASE WHEN starts_with(src, 'func (') THEN 'method' ELSE 'function' END AS kind, list_filter(list_transform(string_split(src[strpos(src, chr(10)) + 1:], chr(10)), lambda x: regexp_replace(trim(x, ' ' || chr(9) || chr(13)), '[ \t]+', ' ', 'g')), lambda x: x <> '') AS lines, src FROM g),
k AS (SELECT path, line, kind, array_to_string(lines, chr(10)) AS body FROM b WHERE len(string_split(src, chr(10))) >= 10 AND len(regexp_extract_all(src, '(?m)^\t[^\t}}\r\n]')) >= 5)
SELECT kind, count(*)::BIGINT AS sites, string_agg(site, ' ' ORDER BY site) FILTER (WHERE rn <= 4) AS shown FROM (SELECT *, path || ':' || line AS site, row_number() OVER (PARTITION BY kind, body ORDER BY path, line) AS rn FROM k) GROUP BY kind, body HAVING count(*) >= 2""",
    "symbol_query": f"WITH {SYMBOLS}, g AS (SELECT path, line, name, kind, CASE WHEN name = 'fold' THEN 100 WHEN lower(name) = 'fold' THEN 75 WHEN name LIKE 'fold%' THEN 50 WHEN lower(name) LIKE '%fold%' THEN 25 ELSE 0 END AS score FROM s WHERE kind = 'function' AND contains(path, 'src/')) SELECT * FROM g WHERE score > 0",
    "canonical_symbols": f"WITH {SYMBOLS} SELECT path, line, name, kind, row_number() OVER (PARTITION BY path ORDER BY line, name, kind)::INT AS ordinal FROM s",
    "symbol_kinds": f"WITH {SYMBOLS} SELECT language, kind, count(*)::BIGINT AS symbols, count_if(exported)::BIGINT AS exported FROM s GROUP BY language, kind",
    "find_symbol": f"WITH {SYMBOLS}, g AS (SELECT path, line, name, kind, CASE WHEN name = 'fold' THEN 100 WHEN lower(name) = 'fold' THEN 75 WHEN name LIKE 'fold%' THEN 50 WHEN lower(name) LIKE '%fold%' THEN 25 ELSE 0 END AS score FROM s) SELECT * FROM g WHERE score > 0",
    "call_edges": f"WITH {_CALLS} SELECT src, dst, symbol, line FROM e",
    "callers": f"WITH {_CALLS} SELECT symbol, dst, count(DISTINCT src)::BIGINT AS callers, least(20, 2 * count(DISTINCT src))::BIGINT AS score FROM e WHERE src <> dst GROUP BY symbol, dst",
    "orphan_symbols": f"WITH {SYMBOLS}, {_SEEN}, d AS (SELECT name, count_if{_TEST} AS dt, count_if(NOT {_TEST}) AS d_other FROM s GROUP BY name) SELECT path, line, name, kind, CASE WHEN coalesce(other, 0) - d_other <= 0 AND coalesce(test, 0) - dt <= 0 THEN 'zero' WHEN coalesce(other, 0) - d_other <= 0 THEN 'test-only' ELSE 'used' END AS usage FROM s JOIN d USING (name) LEFT JOIN n USING (name) WHERE exported AND NOT {_TEST} AND class <> 'generated' AND name <> 'main'",
    "dead_symbols": f"WITH {SYMBOLS}, {_SEEN}, d AS (SELECT name, count(*) AS declared FROM s GROUP BY name) SELECT path, line, name, kind FROM s JOIN d USING (name) JOIN n USING (name) WHERE NOT exported AND name NOT IN ('main', 'init', '_') AND name NOT LIKE 'Test%' AND test + other <= declared",
    "repeated_declarations": f"WITH {SYMBOLS}, b AS (SELECT language, kind, sha256(signature) AS body_hash, path || ':' || line AS site, row_number() OVER (PARTITION BY language, kind, signature ORDER BY path, line) AS rn FROM s) SELECT language, kind, body_hash, count(*)::BIGINT AS sites, string_agg(site, ' ' ORDER BY site) FILTER (WHERE rn <= 4) AS shown FROM b GROUP BY language, kind, body_hash HAVING count(*) >= 2",
    "symbol_references": rf"WITH {SYMBOLS}, m AS (SELECT count(*) * 40 // 100 AS most FROM f), x0 AS (SELECT name, path AS dst FROM s WHERE exported AND language <> 'go' AND strlen(name) >= 4), x AS (SELECT DISTINCT name, dst FROM x0 WHERE name NOT IN (SELECT name FROM x0, m GROUP BY name, most HAVING most >= 2 AND count(*) > most)), w AS (SELECT DISTINCT path, unnest(regexp_extract_all(raw, '[\p{{L}}_][\p{{L}}\p{{Nd}}_]*')) AS name FROM l) SELECT dst AS path, least(24, 2 * count(DISTINCT w.path))::BIGINT AS bonus FROM x JOIN w USING (name) WHERE w.path <> dst GROUP BY dst",
    "graph_kinds": f"WITH {_CALLS}, {_trade_sql()}, b AS (SELECT 'calls' AS kind, src, dst FROM e UNION ALL SELECT 'trades', src::VARCHAR, dst::VARCHAR FROM t) SELECT kind, count(*)::BIGINT AS edges, count(DISTINCT (src, dst))::BIGINT AS pairs FROM b GROUP BY kind",
    "graph_degrees": f"WITH {_trade_sql()}, {_DEG} SELECT * FROM g",
    "graph_hubs": f"WITH {_trade_sql()}, {_DEG} SELECT *, in_degree + out_degree AS degree FROM g ORDER BY degree DESC, node LIMIT 25",
    "importer_scores": f"WITH {_trade_sql()}, n AS (SELECT dst AS node, count(DISTINCT src)::BIGINT AS importers FROM t GROUP BY dst) SELECT node, importers, (CASE WHEN importers <= 8 THEN importers * 10 ELSE 80 + importers - 8 END)::BIGINT AS score FROM n",
    "strong_components": f"WITH RECURSIVE {_SCC} SELECT node, component FROM k",
    "graph_cycles": f"WITH RECURSIVE {_SCC}, {_CYCLES}",
    "reach": f"WITH RECURSIVE {_trade_sql()}, d AS (SELECT DISTINCT src, dst FROM t), r(node, steps) AS (SELECT min(src), 0 FROM d UNION SELECT d.dst, r.steps + 1 FROM r JOIN d ON d.src = r.node WHERE r.steps < 200) SELECT node, min(steps)::INT AS steps FROM r GROUP BY node",
    "suffix_matches": r"WITH n AS (SELECT DISTINCT regexp_replace(replace(x, '\', '/'), '^(\./)+', '') AS name FROM (SELECT first_file_name AS x FROM clone_pairs UNION ALL SELECT second_file_name FROM clone_pairs) WHERE x IS NOT NULL) SELECT name, arg_max(path, strlen(path)) AS target FROM n JOIN source_files ON name = path OR ends_with(name, '/' || path) GROUP BY name",
}
