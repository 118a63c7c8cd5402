"""Route registrations of Go sources, and the routes a query selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registrations of two frameworks.
NET_HTTP = r'\b(?:\w+\.)?(?:HandleFunc|Handle)\(\s*"([^"]+)"\s*,\s*([A-Za-z_][\w.]*|\bfunc\b)'
CHI = r'\b\w+\.(Get|Post|Put|Delete|Patch|Head|Options|Connect|Trace)\(\s*"(/[^"]*)"\s*,\s*([A-Za-z_][\w.]*|\bfunc\b)'


def routes(lines: DataFrame) -> DataFrame:
    """(framework, method, pattern, handler, path, line) of Go lines outside tests; a literal without a blank has method ANY."""
    go = lines.filter((F.col("language") == "go") & ~F.col("path").endswith("_test.go"))

    def group(pattern: str, n: int) -> Column:
        return F.regexp_extract("raw", pattern, n)

    literal = group(NET_HTTP, 1)
    blank = F.instr(literal, " ")
    plain = F.when(
        F.col("raw").rlike(NET_HTTP),
        F.struct(F.lit("net/http").alias("framework"), F.when(blank > 0, F.substring_index(literal, " ", 1)).otherwise("ANY").alias("method"), F.when(blank > 0, F.substr(literal, blank + 1)).otherwise(literal).alias("pattern"), group(NET_HTTP, 2).alias("handler")),
    )
    verbs = F.when(F.col("raw").rlike(CHI), F.struct(F.lit("chi").alias("framework"), F.upper(group(CHI, 1)).alias("method"), group(CHI, 2).alias("pattern"), group(CHI, 3).alias("handler")))
    found = go.select("path", F.col("number").alias("line"), F.explode(F.array_compact(F.array(plain, verbs))).alias("r"))
    handler = F.when(F.col("r.handler") == "func", "<inline>").otherwise(F.col("r.handler"))
    return found.select("r.framework", "r.method", "r.pattern", handler.alias("handler"), "path", "line")


def matching(found: DataFrame, query: str) -> DataFrame:
    """Routes that a query selects: exact ones, else those whose method and pattern contain it.

    A registration without a method answers a query with any.
    """
    query = query.strip()
    canonical = F.concat_ws(" ", "method", "pattern")
    method, _, pattern = query.partition(" ")
    any_method = (F.col("method") == "ANY") & (F.col("pattern") == pattern) if method and pattern else F.lit(False)
    graded = found.withColumn("_exact", (canonical == query) | (F.col("pattern") == query) | any_method).filter(F.col("_exact") | (F.lit(bool(query)) & canonical.contains(query)))
    best = graded.agg(F.max("_exact").alias("_best"))
    return graded.crossJoin(F.broadcast(best)).filter(F.col("_exact") == F.col("_best")).drop("_exact", "_best")


def endpoint(found: DataFrame, query: str, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Routes of a query with the declaration of the handler and the names it calls.

    A handler declared in the file that registers it wins; else the first by path and line. symbols carry
    ``end``, the line behind their span; calls are (path, line, name).
    """
    picked = matching(found, query).withColumn("name", F.element_at(F.split("handler", r"\."), -1))
    declared = symbols.filter(F.col("kind").isin("function", "method")).select("name", F.col("path").alias("_p"), F.col("line").alias("_l"), F.col("end").alias("_e"))
    order = F.struct((F.col("_p") != F.col("path")).alias("far"), F.col("_p").alias("path"), F.col("_l").alias("line"), F.col("_e").alias("end"))
    key = ["framework", "method", "pattern", "handler", "path", "line"]
    best = picked.join(declared, "name", "left").groupBy(*key).agg(F.min(F.when(F.col("_p").isNotNull(), order)).alias("h"))
    c = calls.select(F.col("path").alias("_cp"), F.col("line").alias("_cl"), F.col("name").alias("callee"))
    body = best.join(c, (F.col("_cp") == F.col("h.path")) & (F.col("_cl") > F.col("h.line")) & (F.col("_cl") < F.col("h.end")), "left")
    return body.groupBy(*key, F.col("h.path").alias("handler_path"), F.col("h.line").alias("handler_line")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
