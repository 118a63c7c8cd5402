"""Facts of a path: language, generated flag, class, terms, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of each extension.
LANGUAGES = {
    ".go": "go",
    ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".java": "java",
    ".php": "php",
    ".py": "python",
    ".rb": "ruby",
    ".rs": "rust",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".jsx": "jsx",
}


def base(path: Column) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Path without its last segment; ``.`` for a bare name."""
    cut = F.regexp_replace(path, "/?[^/]*$", "")
    return F.when(cut == "", F.lit(".")).otherwise(cut)


def depth(path: Column) -> Column:
    """Number of directories above a file."""
    return F.size(F.split(path, "/")) - 1


def language(path: Column) -> Column:
    """Language id of a path's extension, ``unknown`` for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))], F.lit("unknown"))


def generated(path: Column) -> Column:
    """Suffixes of generated Go sources."""
    return path.endswith(".gen.go") | path.endswith("_generated.go")


def file_class(path: Column, language_: Column, generated_: Column) -> Column:
    """Role of a file: the first rule that holds decides."""
    clean = F.lower(F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", ""))
    segments = F.split(clean, "/")
    name = F.element_at(segments, -1)

    def has(*names: str) -> Column:
        return F.arrays_overlap(segments, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(generated_ | has("generated"), "generated")
        .when(has("vendor", "node_modules", "third_party"), "vendor")
        .when(name.endswith("_test.go") | has("test", "tests"), "test")
        .when(has("testdata", "fixtures", "fixture"), "fixture")
        .when(has("docs") | name.isin("readme.md", "contributing.md", "changelog.md", "license.md"), "docs")
        .when(has("example", "examples") | name.startswith("example_"), "example")
        .when(has(".work", "receipts", "artifacts", "benchmarks") | name.endswith(".jsonl"), "receipt/data")
        .when(~language_.isin("", "unknown", "markdown"), "production")
        .otherwise("unknown")
    )


def excluded(path: Column, excludes: list[str], includes: list[str] | None = None) -> Column:
    """The path is one of the excludes or below one, and no include reopens it."""
    out = F.lit(False)
    for x in excludes:
        x = x.strip("/")
        out = out | (path == x) | path.startswith(x + "/")
    for i in includes or []:
        out = out & (path != i)
    return out


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ``*`` and ``?`` stay within a segment, ``**`` spans any number of them."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def glob_match(path: Column, globs: list[str]) -> Column:
    """The path matches any of the globs."""
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)
