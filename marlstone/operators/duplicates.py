"""Duplicate files and texts, by signals of decreasing strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import paths

#: Files up to this size are too common in content to count as copies.
LEAST_BYTES = 4096
#: Bytes that the content signal compares.
PREFIX_BYTES = 4096


def duplicate_files(files: DataFrame) -> DataFrame:
    """(path, signal, original) of files that copy another; the first signal that holds counts.

    A backup suffix points to the file without it; equal name and size, or
    equal size and leading bytes, point to the shortest path, ties to the
    smallest. The original is a pre-aggregated minimum, so a large group of
    copies is not gathered.
    """
    f = files.select("path", "size", paths.base(F.col("path")).alias("base"), F.sha2(F.substring(F.encode("content", "utf-8"), 1, PREFIX_BYTES), 256).alias("prefix"))
    plain = F.regexp_replace("path", r"(\.bak|\.orig|\.old|~)$", "")
    backups = f.select("path", plain.alias("original")).filter(F.col("path") != F.col("original"))
    first = backups.join(f.select(F.col("path").alias("original")), "original", "left_semi").select("path", F.lit(1).alias("pri"), F.lit("backup-suffix").alias("signal"), "original")
    large = f.filter(F.col("size") > LEAST_BYTES)

    def by(keys: list[str], pri: int, signal: str) -> DataFrame:
        heads = large.groupBy(*keys).agg(F.min(F.struct(F.octet_length("path").alias("n"), "path")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        return large.join(heads.select(*keys, F.col("m.path").alias("original")), keys).filter("path <> original").select("path", F.lit(pri).alias("pri"), F.lit(signal).alias("signal"), "original")

    every = first.unionByName(by(["base", "size"], 2, "name-size")).unionByName(by(["size", "prefix"], 3, "content"))
    best = every.groupBy("path").agg(F.min(F.struct("pri", "signal", "original")).alias("b"))
    return best.select("path", "b.signal", "b.original")


def same_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, original) of rows whose content another row with a smaller key has."""
    hashed = rows.select(F.col(key), F.sha2(F.col(content), 256).alias("h")).filter(F.col("h").isNotNull())
    heads = hashed.groupBy("h").agg(F.min(key).alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hashed.join(heads, "h").filter(F.col(key) != F.col("original")).select(key, "original")


def go_bodies(files: DataFrame, least_lines: int = 10, least_statements: int = 5) -> DataFrame:
    """(path, folder, line, kind, body_hash) of Go functions outside tests and generated files.

    A function ends at the first line that starts with a closing brace. Bodies are compared without
    indents, repeated blanks and empty lines; short ones and those of few statements are left out.
    """
    go = files.filter((F.col("language") == "go") & ~F.col("generated") & ~F.col("path").endswith("_test.go"))
    src = F.regexp_extract_all("content", F.lit(r"(?m)^func [^\n]*\{\n(?:[^}\n][^\n]*+\n|\n)*+\}"), F.lit(0))
    one = go.select("path", "content", F.explode(src).alias("src"))
    line = F.size(F.split(F.expr("left(content, locate(src, content) - 1)"), "\n"))
    body = F.filter(F.transform(F.slice(F.split("src", "\n"), F.lit(2), F.size(F.split("src", "\n"))), lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\r")), "[ \t]+", " ")), lambda x: x != "")
    kept = one.filter((F.size(F.split("src", "\n")) >= least_lines) & (F.regexp_count("src", F.lit(r"(?m)^\t[^\t}\r\n]")) >= least_statements))
    kind = F.when(F.col("src").startswith("func ("), "method").otherwise("function")
    return kept.select("path", paths.directory(F.col("path")).alias("folder"), line.alias("line"), kind.alias("kind"), F.sha2(F.array_join(body, "\n"), 256).alias("body_hash"))


def repeated_bodies(bodies: DataFrame, keys: list[str], least_sites: int = 2, show: int = 4) -> DataFrame:
    """Groups of equal bodies: number of sites and the first few of them."""
    site = Window.partitionBy(*keys, "body_hash").orderBy("path", "line")
    counts = bodies.groupBy(*keys, "body_hash").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= least_sites)
    first = bodies.withColumn("_rn", F.row_number().over(site)).filter(F.col("_rn") <= show)  # limited before the shuffle
    shown = first.groupBy(*keys, "body_hash").agg(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.col("line").cast("string")))).alias("shown"))
    return counts.join(shown, [*keys, "body_hash"])
