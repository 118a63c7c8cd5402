"""Declarations and calls found by line patterns; facts from here are lexical, not parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (languages, kind, pattern with the name as its only group); the first that holds on a line counts.
RULES = [
    (("go",), "method", r"^func \([^)]*\) ([A-Za-z_]\w*)\("),
    (("go",), "function", r"^func ([A-Za-z_]\w*)\("),
    (("go",), "struct", r"^type ([A-Za-z_]\w*) struct\b"),
    (("go",), "interface", r"^type ([A-Za-z_]\w*) interface\b"),
    (("go",), "type", r"^type ([A-Za-z_]\w*)\b"),
    (("go",), "variable", r"^var ([A-Za-z_]\w*)\b"),
    (("go",), "constant", r"^const ([A-Za-z_]\w*)\b"),
    (("python",), "method", r"^[ \t]+(?:async )?def ([A-Za-z_]\w*)\("),
    (("python",), "function", r"^(?:async )?def ([A-Za-z_]\w*)\("),
    (("python",), "class", r"^class ([A-Za-z_]\w*)\b"),
    (("javascript", "typescript"), "class", r"^(?:export )?(?:default )?class ([A-Za-z_$]\w*)\b"),
    (("javascript", "typescript"), "interface", r"^(?:export )?interface ([A-Za-z_$]\w*)\b"),
    (("javascript", "typescript"), "function", r"^(?:export )?(?:default )?(?:async )?function ([A-Za-z_$]\w*)\("),
    (("javascript", "typescript"), "constant", r"^(?:export )?const ([A-Za-z_$]\w*) ="),
    (("java",), "class", r"^[ \t]*(?:public )?(?:abstract )?(?:final )?class ([A-Za-z_]\w*)\b"),
    (("java",), "method", r"^[ \t]+(?:public|protected|private) (?:static )?[\w<>\[\]]+ ([A-Za-z_]\w*)\("),
]
EXPORTED = {"go": r"^[A-Z]", "python": r"^[^_]"}
#: Words before a parenthesis that are no calls.
NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "func", "function", "def", "class", "super", "typeof", "print", "make", "len", "append", "new"]


def symbols(lines: DataFrame) -> DataFrame:
    """Declarations: path, line, name, kind, exported, signature."""
    options = [
        F.when(F.col("language").isin(*languages) & F.col("raw").rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("raw", pattern, 1).alias("name")))
        for languages, kind, pattern in RULES
    ]
    found = lines.withColumn("_s", F.coalesce(*options)).filter(F.col("_s").isNotNull())
    name = F.col("_s.name")
    exported = (
        F.when(F.col("language") == "go", name.rlike(EXPORTED["go"]))
        .when(F.col("language") == "python", name.rlike(EXPORTED["python"]))
        .when(F.col("language") == "java", F.col("raw").contains("public "))
        .otherwise(F.col("raw").startswith("export "))
    )
    return found.select("path", "repo", "language", "class", F.col("number").alias("line"), name.alias("name"), F.col("_s.kind").alias("kind"), exported.alias("exported"), F.col("text").alias("signature"))


def calls(lines: DataFrame) -> DataFrame:
    """Call sites by shape: path, line, name."""
    names = F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\("), F.lit(1))
    return lines.select("path", F.col("number").alias("line"), F.explode(names).alias("name")).filter(~F.col("name").isin(NO_CALLS))


def call_edges(symbols_: DataFrame, calls_: DataFrame) -> DataFrame:
    """Call sites with their declaration, where exactly one symbol has the name: src, dst, symbol, line."""
    unique = symbols_.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("dst"), F.min("line").alias("declared")).filter("n = 1")
    joined = calls_.join(unique, "name")
    return joined.filter(~((F.col("path") == F.col("dst")) & (F.col("line") == F.col("declared")))).select(F.col("path").alias("src"), "dst", F.col("name").alias("symbol"), "line")


def occurrences(lines: DataFrame) -> DataFrame:
    """Identifier occurrences per name, in test files and others."""
    words = F.regexp_extract_all("raw", F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    test = F.col("path").endswith("_test.go") | (F.col("class") == "test")
    return lines.select(F.explode(words).alias("name"), test.alias("test")).groupBy("name").agg(F.count_if("test").alias("test"), F.count_if(~F.col("test")).alias("other"))


def orphan_classes(symbols_: DataFrame, seen: DataFrame) -> DataFrame:
    """Exported symbols outside of tests by whether their name is used: zero, test-only or used."""
    test = F.col("path").endswith("_test.go") | (F.col("class") == "test")
    declared = symbols_.groupBy("name").agg(F.count_if(test).alias("d_test"), F.count_if(~test).alias("d_other"))
    candidates = symbols_.filter("exported").filter(~test & ~F.col("class").isin("generated") & (F.col("name") != "main"))
    joined = candidates.join(declared, "name").join(seen, "name", "left")
    other, tests = F.coalesce("other", F.lit(0)) - F.col("d_other"), F.coalesce("test", F.lit(0)) - F.col("d_test")
    kind = F.when((other <= 0) & (tests <= 0), "zero").when(other <= 0, "test-only").otherwise("used")
    return joined.select("path", "line", "name", "kind", kind.alias("usage"))


def match_score(name: Column, query: str) -> Column:
    """Graded match of a name: exact 100, equal but for case 75, prefix 50, contained 25 (case-blind), else 0."""
    return (
        F.when(name == query, 100)
        .when(F.lower(name) == query.lower(), 75)
        .when(name.startswith(query), 50)
        .when(F.lower(name).contains(query.lower()), 25)
        .otherwise(0)
    )


def parse_query(query: str) -> tuple[str, str, str]:
    """(name, kind, file) of ``kind:K:file:F:name``: the qualifiers in any order, the rest is the name; a ``symbol:`` handle stays whole."""
    query = query.strip()
    if query.startswith("symbol:"):
        return query, "", ""
    parts = query.split(":")
    found = {"kind": "", "file": ""}
    while len(parts) > 1 and parts[0] in found:
        found[parts[0]] = parts[1]
        parts = parts[2:]
    return ":".join(parts), found["kind"], found["file"]


def find(symbols_: DataFrame, query: str, kind: str = "", file: str = "") -> DataFrame:
    """symbols with ``score`` that a query finds; explicit filters win over those in the query, an empty name finds nothing."""
    name, own_kind, own_file = parse_query(query)
    kind, file = kind or own_kind, file or own_file
    keep = F.lit(bool(name))
    if kind:
        keep = keep & (F.lower("kind") == kind.lower())
    if file:
        keep = keep & F.col("path").contains(file)
    scored = symbols_.filter(keep).withColumn("score", match_score(F.col("name"), name))
    return scored.filter("score > 0").orderBy(F.desc("score"), "path", "line", "name")
