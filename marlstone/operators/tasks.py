"""Candidates for a request, and their packing into a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.session import ship_package

#: Weight of a term on each field, for a request in words and for a bare symbol.
WEIGHTS = {"path": 8, "package": 5, "import": 3, "symbol": 8, "signature": 4}
SYMBOL_WEIGHTS = {"path": 4, "package": 5, "import": 3, "symbol": 12, "signature": 6}
#: Relevance of a file that imports one with evidence, or calls it.
IMPORTER, CALLER = 6, 4
#: Fixed value: a request that is a bare symbol, or a word of a request that may name one.
SYMBOL = r"^(?:[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\|->|\.)[A-Za-z_][A-Za-z0-9_]*)+|_[A-Za-z0-9_]*|[A-Za-z][A-Za-z0-9]*[A-Z_][A-Za-z0-9_]*|[A-Z][A-Za-z0-9]*)$"
ATTEMPTS = 96


def goal_terms(requests: DataFrame, key: str, request: str) -> DataFrame:
    """(key, at, term, bare) of every request, with the place of the term; bare: the request is a symbol."""
    bare = F.trim(F.col(request)).rlike(SYMBOL)
    return requests.select(F.col(key).alias("key"), bare.alias("bare"), F.posexplode(text.expand_terms(F.col(request), 2)).alias("at", "term")).select("key", "at", "term", "bare")


def goal_identifiers(requests: DataFrame, key: str, request: str) -> DataFrame:
    """(key, name): lower-case names that a request says explicitly: a bare symbol, and quoted, qualified or compound words."""
    bare = F.trim(F.col(request)).rlike(SYMBOL)
    words = requests.select(F.col(key).alias("key"), bare.alias("bare"), F.explode(F.split(F.trim(F.col(request)), r"\s+")).alias("word"))
    name = F.btrim("word", F.lit("`\"'(),;.!?:"))
    said = words.select("key", "bare", F.col("word").rlike("[`\"']").alias("quoted"), name.alias("name")).filter(F.col("name").rlike(SYMBOL))
    compound = F.col("name").rlike(r"[_:.\\>-]") | F.substring("name", 2, 1 << 30).rlike(r"\p{Lu}")
    return said.filter(F.col("bare") | F.col("quoted") | compound).select("key", F.lower("name").alias("name")).filter(~F.col("name").isin(text.STOPWORDS)).distinct()


def evidence_parts(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, field, value, part): the vocabulary of each field of a file; all imports of a file are one value."""
    words = lambda c: F.flatten(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), text.split_identifier))
    of_path = files.select("path", F.lit("path").alias("field"), F.col("path").alias("value"), F.explode(text.path_terms(F.col("path"))).alias("part"))
    package = F.regexp_extract("content", r"(?m)^package[ \t]+(\w+)", 1)
    of_package = files.filter(F.col("language") == "go").select("path", F.lit("package").alias("field"), package.alias("value"), F.explode(text.path_terms(package)).alias("part"))
    of_import = edges.select("path", F.lit("import").alias("field"), F.lit("").alias("value"), F.explode(words(F.col("module"))).alias("part"))
    of_name = symbols.select("path", F.lit("symbol").alias("field"), F.col("name").alias("value"), F.explode(text.split_identifier(F.col("name"))).alias("part"))
    of_signature = symbols.select("path", F.lit("signature").alias("field"), F.col("signature").alias("value"), F.explode(words(F.col("signature"))).alias("part"))
    return of_path.unionByName(of_package).unionByName(of_import).unionByName(of_name).unionByName(of_signature).distinct()


def evidence(terms: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, path, relevance, terms, covers) of every file that a request's terms match, with the places of the terms.

    A term earns a field's weight where a part equals it, half of it where one
    is a prefix of the other (3 bytes at least). Prefixes meet in equality
    joins: each side is exploded into its prefixes.
    """
    table = F.create_map(*[F.lit(x) for mode, weights in (("false", WEIGHTS), ("true", SYMBOL_WEIGHTS)) for field, w in weights.items() for x in (mode + field, w)])
    bare = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(""))
    vocabulary = parts.select("part").distinct()
    asked = terms.select("term").distinct()
    exact = asked.join(vocabulary, bare("term") == bare("part")).select("term", "part", F.lit(1).alias("exact"))

    def heads(df: DataFrame, column: str) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.length(column)), lambda n: F.substring(F.col(column), F.lit(1), n))
        return df.filter(F.octet_length(column) >= 3).select(column, F.explode(F.filter(every, lambda h: F.octet_length(h) >= 3)).alias("_h"))

    longer_part = heads(vocabulary, "part").join(asked.withColumnRenamed("term", "_h").withColumn("term", F.col("_h")), "_h").select("term", "part", F.lit(0).alias("exact"))
    longer_term = heads(asked, "term").join(vocabulary.withColumnRenamed("part", "_h").withColumn("part", F.col("_h")), "_h").select("term", "part", F.lit(0).alias("exact"))
    matches = exact.unionByName(longer_part).unionByName(longer_term).groupBy("term", "part").agg(F.max("exact").alias("exact"))
    # what a term earns on a file is added up before the requests come in
    of_field = parts.join(matches, "part").groupBy("path", "field", "value", "term").agg(F.max("exact").alias("exact"))

    def points(mode: str) -> Column:
        weight = table[F.concat(F.lit(mode), F.col("field"))]
        return F.sum(F.when(F.col("exact") == 1, weight).otherwise(F.greatest(F.lit(1), F.floor(weight / 2)))).cast("long")

    of_file = of_field.groupBy("path", "term").agg(points("false").alias("plain"), points("true").alias("symbolic"))
    earned = F.when(F.col("bare"), F.col("symbolic")).otherwise(F.col("plain"))
    return terms.join(of_file, "term").groupBy("key", "path").agg(F.sum(earned).cast("long").alias("relevance"), F.count_distinct("term").alias("terms"), F.collect_set("at").alias("covers"))


def with_owners(hit: DataFrame, importing: DataFrame, calling: DataFrame) -> DataFrame:
    """hit and the files without evidence that import or call one with it; of several the first by path counts, importers first.

    importing and calling are (path, seed): path imports the package of seed, or calls it. Tests are no owners.
    """
    edges = importing.select("path", "seed", F.lit(IMPORTER).alias("credit")).unionByName(calling.select("path", "seed", F.lit(CALLER).alias("credit"))).filter((F.col("path") != F.col("seed")) & ~F.col("path").endswith("_test.go")).distinct()
    owners = hit.select("key", F.col("path").alias("seed")).join(edges, "seed").join(hit.select("key", "path"), ["key", "path"], "left_anti")
    first = owners.groupBy("key", "path").agg(F.min_by("credit", F.struct("seed", F.negate("credit"))).cast("long").alias("relevance"))
    return hit.unionByName(first.withColumn("terms", F.lit(0).cast("long")).withColumn("covers", F.array().cast("array<int>")))


def candidates(hit: DataFrame, exact: DataFrame, scores: DataFrame, keys: DataFrame, top: int = ATTEMPTS) -> DataFrame:
    """(key, rank, path, relevance, terms, covers): the best files of every request.

    exact: (key, path, exact) numbers of explicitly named symbols; scores: (path, score) of the ranking. Order: named
    symbols, relevance, score, path. A request without any evidence gets the first files of the ranking.
    """
    every = hit.join(exact, ["key", "path"], "left").join(scores, "path")
    order = Window.partitionBy("key").orderBy(F.desc(F.coalesce("exact", F.lit(0))), F.desc("relevance"), F.desc("score"), "path")
    best = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("key", "rank", "path", "relevance", "terms", "covers")
    lost = keys.select("key").distinct().join(hit.select("key").distinct(), "key", "left_anti")
    leading = scores.orderBy(F.desc("score"), "path").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path")))
    fallback = lost.crossJoin(F.broadcast(leading)).select("key", "rank", "path", F.lit(0).cast("long").alias("relevance"), F.lit(0).cast("long").alias("terms"), F.array().cast("array<int>").alias("covers"))
    return best.unionByName(fallback)


def order_for_goal(scores: DataFrame, found: DataFrame) -> DataFrame:
    """(path, relevance, score): files with evidence by named symbols, relevance, score and path, then the others by score.

    found: (path, exact, relevance) of one goal; without any evidence the order of the scores stays.
    """
    joined = scores.join(found, "path", "left").select("path", F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("relevance", F.lit(0)).cast("long").alias("relevance"), "score")
    return joined.orderBy(F.desc("exact"), F.desc("relevance"), F.desc("score"), "path").select("path", "relevance", "score")


def confidence(relevance):
    """Label of a relevance."""
    return F.when(relevance >= 16, "high").when(relevance >= 8, "medium").otherwise("low")


def pack(found: DataFrame, costs: DataFrame, budgets: DataFrame, most: int = 6) -> DataFrame:
    """(key, rank, path, tokens, used): candidates that fit the request's budget; one that doesn't is skipped.

    The strongest comes first, then for each term that no packed file matches the best file that does, then the rest in order.

    Sequential by definition; a request has at most ``ATTEMPTS`` candidates, so a group is small.
    """
    ship_package(found.sparkSession)
    kind = dict(found.dtypes)["key"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used, rows, covered, tried = 0, [], set(), set()
        order = list(group.sort_values("rank").itertuples())

        def attempt(r) -> None:
            nonlocal used
            if r.path not in tried and len(rows) < most:
                tried.add(r.path)
                if used + r.tokens <= r.budget:
                    used += r.tokens
                    covered.update(r.covers)
                    rows.append((r.key, r.rank, r.path, r.tokens, used))

        attempt(order[0])
        for term in sorted({t for r in order for t in r.covers}):
            for r in order:
                if term in covered:
                    break
                if term in r.covers:
                    attempt(r)
        for r in order:
            attempt(r)
        return pd.DataFrame(rows, columns=["key", "rank", "path", "tokens", "used"])

    joined = found.join(costs, "path").join(budgets, "key").select("key", "rank", "path", F.col("tokens").cast("long"), F.col("budget").cast("long"), "covers")
    return joined.groupBy("key").applyInPandas(run, f"key {kind}, rank int, path string, tokens long, used long")

