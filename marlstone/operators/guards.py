"""Rules on paths and bytes that must not leave a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import paths


def path_rules(path: Column) -> Column:
    """Array of the rules a path breaks."""
    segments, name = F.split(path, "/"), paths.base(path)
    env = (name == ".env") | (name.startswith(".env.") & ~name.isin(".env.example", ".env.sample", ".env.template"))
    rules = [
        (F.array_contains(segments, ".work"), "private-work-directory"),
        (F.array_contains(segments, ".claude"), "private-claude-directory"),
        (env, "environment-file"),
        ((name == "auth-state.json") | name.endswith("-auth-state.json"), "browser-auth-state"),
        (name.isin("cookies.txt", "cookies.json") | name.endswith(".cookies.txt"), "browser-cookie-file"),
        (F.array_contains(segments, ".agent-browser-state"), "browser-agent-state-directory"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))


def executable_format(content: Column) -> Column:
    """elf, mach-o or pe by leading bytes; NULL for others."""
    magic = F.hex(F.substring(content, 1, 4))
    return (
        F.when(magic == "7F454C46", "elf")
        .when(magic.isin("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA"), "mach-o")
        .when((F.substring(magic, 1, 4) == "4D5A") & (F.length(content) >= 64), "pe")
    )


def outgoing(blobs: DataFrame, most_bytes: int) -> DataFrame:
    """(commit, path, rule) of blobs with commit, path, size, content."""
    more = F.array_compact(F.array(F.when(F.col("size") > most_bytes, F.lit("oversized-blob")), F.when(executable_format(F.col("content")).isNotNull(), F.lit("executable-blob"))))
    return blobs.select("commit", "path", F.explode(F.concat(path_rules(F.col("path")), more)).alias("rule")).distinct()
