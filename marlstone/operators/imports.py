"""Import edges of files, their resolution to package folders, and what follows from them.

Edges are found by patterns over whole contents, so they are lexical. An import
resolves to a folder of the capture: behind the module's prefix where the
module is known, else by the longest folder that the import path ends in.

Defined cases: NULL contents and paths have no imports; a repeated import of a
file is one edge; an import that is no folder of the capture resolves to
nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import paths
from marlstone.operators.graphs import import_score, suffix_join

GO_ONE = r'(?m)^import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"'
GO_BLOCK = r"(?m)^import[ \t]*\(([^)]*)\)"
GO_LINE = r'(?m)^[ \t]*(?:[\w.]+[ \t]+)?"([^"\n]+)"'
SCRIPT_FROM = r"""(?m)^(?:import|export)\b[^'";]*?\bfrom[ \t]*['"]([^'"\n]+)['"]"""
SCRIPT_BARE = r"""(?m)^import[ \t]+['"]([^'"\n]+)['"]"""
SCRIPT_REQUIRE = r"""\brequire\([ \t]*['"]([^'"\n]+)['"][ \t]*\)"""
PYTHON_IMPORT = r"(?m)^[ \t]*import[ \t]+([\w., \t]+)"
PYTHON_FROM = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import\b"
JAVA_IMPORT = r"(?m)^import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)[ \t]*;"


def _all(pattern: str, column: Column | None = None) -> Column:
    return F.regexp_extract_all(F.col("content") if column is None else column, F.lit(pattern), F.lit(1))


def import_edges(files: DataFrame) -> DataFrame:
    """Distinct (path, language, module) of files with path, language and content."""
    nothing = F.array().cast("array<string>")
    blocks = F.flatten(F.transform(_all(GO_BLOCK), lambda b: _all(GO_LINE, b)))
    names = F.flatten(F.transform(_all(PYTHON_IMPORT), lambda part: F.transform(F.split(part, ","), lambda n: F.regexp_extract(n, r"^\s*([.\w]+)", 1))))
    modules = (
        F.when(F.col("language") == "go", F.concat(_all(GO_ONE), blocks))
        .when(F.col("language").isin("typescript", "javascript", "tsx", "jsx"), F.concat(_all(SCRIPT_FROM), _all(SCRIPT_BARE), _all(SCRIPT_REQUIRE)))
        .when(F.col("language") == "python", F.concat(F.filter(names, lambda n: n != ""), _all(PYTHON_FROM)))
        .when(F.col("language") == "java", _all(JAVA_IMPORT))
        .otherwise(nothing)
    )
    return files.filter(F.col("path").isNotNull()).select("path", "language", F.explode(F.array_distinct(modules)).alias("module")).distinct()


def importers(edges: DataFrame) -> DataFrame:
    """(module, importers, score) of every import path."""
    n = edges.groupBy("module").agg(F.count_distinct("path").alias("importers"))
    return n.withColumn("score", import_score(F.col("importers")).cast("long"))


def internal_imports(edges: DataFrame, files: DataFrame, module: str = "") -> DataFrame:
    """Distinct (path, folder) of Go imports that lead to a folder with Go files; the root is ``.``."""
    go = edges.filter(F.col("language") == "go").select("path", "module")
    folders = files.filter(F.col("language") == "go").select(paths.directory(F.col("path")).alias("folder")).distinct()
    if module:
        below = F.when(F.col("module") == module, F.lit(".")).when(F.col("module").startswith(module + "/"), F.substring("module", len(module) + 2, 1 << 30))
        return go.select("path", below.alias("folder")).filter("folder is not null").join(folders, "folder", "left_semi").select("path", "folder").distinct()
    found = suffix_join(go.select(F.col("module")).distinct(), "module", folders.filter("folder <> '.'"), "folder")
    return go.join(found.select("module", F.col("target").alias("folder")), "module").select("path", "folder").distinct()


def imported_files(internal: DataFrame, files: DataFrame) -> DataFrame:
    """(path, importers, score) of the Go files of every imported folder."""
    n = internal.groupBy("folder").agg(F.count_distinct("path").alias("importers"))
    go = files.filter(F.col("language") == "go").select("path", paths.directory(F.col("path")).alias("folder"))
    return go.join(n, "folder").select("path", "importers", import_score(F.col("importers")).cast("long").alias("score"))


def structure_signals(files: DataFrame, symbols: DataFrame, edges: DataFrame, module: str = "") -> DataFrame:
    """(path, imported_by, depends_on, symbols, signatures) of Go production files.

    imported_by counts the import edges to the file's package and needs the module's path.
    """
    go = files.filter((F.col("language") == "go") & (F.col("class") == "production")).select("path")
    deps = edges.groupBy("path").agg(F.count_distinct("module").alias("depends_on"))
    long = F.col("exported") & (F.octet_length("signature") >= 80)
    declared = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(long).alias("signatures"))
    out = go.join(deps, "path", "left").join(declared, "path", "left")
    if module:
        folder = paths.directory(F.col("path"))
        own = out.withColumn("module", F.when(folder == ".", F.lit(module)).otherwise(F.concat(F.lit(module + "/"), folder)))
        n = edges.groupBy("module").agg(F.count(F.lit(1)).alias("imported_by"))
        out = own.join(n, "module", "left").drop("module")
    else:
        out = out.withColumn("imported_by", F.lit(0))
    return out.select("path", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("imported_by", "depends_on", "symbols", "signatures")])
