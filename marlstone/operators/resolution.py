"""Imports resolved to files and definitions, with a reason where that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import paths

#: Endings of script files, in the order in which they are tried.
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def normal_path(path: Column) -> Column:
    """Path without ``.`` and with each ``..`` and the segment before it taken out; NULL where it leaves the root."""
    empty = F.array().cast("array<string>")
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(parts, empty, lambda a, s: F.when(s != "..", F.concat(a, F.array(s))).when((F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.when(~F.array_contains(walked, ".."), F.array_join(walked, "/"))


def bindings(lines: DataFrame) -> DataFrame:
    """Named script imports: path, line, symbol, local name, module."""
    pattern = r"""^import \{([^}]*)\} from ["']([^"']+)["']"""
    found = lines.filter(F.col("language").isin("typescript", "javascript") & F.col("text").rlike(pattern))
    names = F.transform(F.split(F.regexp_extract("text", pattern, 1), ","), lambda s: F.trim(s))
    one = found.select("path", F.col("number").alias("line"), F.regexp_extract("text", pattern, 2).alias("module"), F.explode(names).alias("name")).filter("name <> ''")
    return one.select("path", "line", "module", F.split("name", " as ")[0].alias("symbol"), F.element_at(F.split("name", " as "), -1).alias("local"))


def module_paths(path: Column, module: Column) -> Column:
    """Files that a relative script module may mean."""
    base = normal_path(F.concat_ws("/", paths.directory(path), module))
    options = F.array(*[F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS], *[F.concat(base, F.lit(f"/index{e}")) for e in SCRIPT_ENDINGS])
    relative = module.startswith("./") | module.startswith("../")
    empty = F.array().cast("array<string>")
    return F.when(~relative | base.isNull(), empty).when(module.rlike(r"\.[A-Za-z]+$"), F.array(base)).otherwise(options)


def resolve(bound: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """bound with ``target`` where exactly one candidate file defines the symbol, else ``reason``."""
    tried = bound.withColumn("_id", F.struct("path", "line", "symbol", "local", "module")).withColumn("candidates", module_paths(F.col("path"), F.col("module")))
    each = tried.select("_id", F.explode("candidates").alias("candidate"))
    captured = each.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi")
    defined = symbols.select(F.col("path").alias("candidate"), F.col("name").alias("_name")).distinct()
    wanted = captured.withColumn("_name", F.col("_id.symbol"))
    hits = wanted.join(defined, ["candidate", "_name"]).groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.min("candidate").alias("target"))
    twice = bound.groupBy("path", "local").agg(F.count(F.lit(1)).alias("bindings"))
    joined = tried.join(hits, "_id", "left").join(twice, ["path", "local"])
    n = F.coalesce("n", F.lit(0))
    reason = F.when(F.col("bindings") > 1, "ambiguous_binding").when(n == 0, "unresolved_target").when(n > 1, "ambiguous_binding")
    return joined.select("path", "line", "symbol", "local", "module", F.when(reason.isNull(), F.col("target")).alias("target"), reason.alias("reason"))


def reference_edges(resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, weight) of resolved imports between files: the root of their number over the root of the most definitions that one of their symbols has."""
    defined = symbols.groupBy(F.col("name").alias("symbol")).agg(F.count(F.lit(1)).alias("definitions"))
    found = resolved.filter(F.col("target").isNotNull() & (F.col("path") != F.col("target"))).join(defined, "symbol", "left")
    pairs = found.groupBy(F.col("path").alias("src"), F.col("target").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("definitions", F.lit(0))).alias("most"))
    return pairs.select("src", "dst", (F.sqrt(F.col("n").cast("double")) / F.sqrt(F.greatest(F.col("most"), F.lit(1)).cast("double"))).alias("weight"))
