"""Pattern scans over source lines: hits, risk scores with repeat decay, effects, surface, owners.

All patterns of a table are one projection of each line, an array of the hits
that hold, so no line meets a pattern table in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text


@dataclass(frozen=True)
class Pattern:
    """One line pattern; a capture group, where there is one, names the hit."""

    kind: str
    regex: str
    lane: str = ""
    weight: int = 0
    reason: str = ""
    most: int = 0
    generic: bool = False
    bounded: str = ""  # a line all of whose matches continue like this is no hit


#: Content patterns of the risk score.
RISK = [
    Pattern("subprocess", r"\bexec\.Command(?:Context)?\(", "error-handling", 12, "subprocess boundary", 3),
    Pattern("unsafe", r"\bunsafe\.", "security", 14, "unsafe memory access", 3),
    Pattern("http-server", r"\bhttp\.(?:ListenAndServe|Handle(?:Func)?)\(", "api-contracts", 10, "http server boundary", 3),
    Pattern("http-client", r"\bhttp\.(?:Get|Post|Head)\(", "api-contracts", 8, "outbound http boundary", 3),
    Pattern("database-open", r"\b(?:sql\.Open|pgxpool\.New|pgx\.Connect)\(", "data-integrity", 10, "database boundary", 3),
    Pattern("filesystem-write", r"\bos\.(?:WriteFile|Create(?:Temp)?|Remove(?:All)?|Rename|MkdirAll)\(", "data-integrity", 8, "filesystem write boundary", 3),
    Pattern("unbounded-read", r"\bio\.ReadAll\(", "performance", 6, "unbounded read candidate", 3, bounded=r"\s*io\.LimitReader\("),
    Pattern("change-marker", r"\b(?:TODO|FIXME|HACK|XXX)\b", "best-practices", 4, "change marker", 3, True),
    Pattern("goroutine", r"\bgo\s+func\(", "lifecycle-concurrency", 6, "goroutine launch", 3),
    Pattern("panic", r"\bpanic\(", "error-handling", 4, "panic path", 3),
    Pattern("detached-context", r"\bcontext\.Background\(\)", "lifecycle-concurrency", 6, "detached context", 3),
]
#: Path terms of the risk score; two pairs share a reason.
RISK_TERMS = [
    ("auth", 14, "security", "path signals authentication"),
    ("token", 12, "security", "path signals token handling"),
    ("secret", 12, "security", "path signals secret handling"),
    ("password", 12, "security", "path signals credential handling"),
    ("credential", 12, "security", "path signals credential handling"),
    ("crypto", 12, "security", "path signals cryptography"),
    ("migrate", 12, "data-integrity", "path signals schema migration"),
    ("migration", 12, "data-integrity", "path signals schema migration"),
    ("handler", 8, "api-contracts", "path signals request handling"),
]
#: Side effects with their lanes and scores.
EFFECTS = [
    Pattern("filesystem-write", r"\b(?:os\.)?(?:WriteFile|OpenFile|Create(?:Temp)?|MkdirAll|Rename|Remove(?:All)?)\s*\(", "data-integrity", 10),
    Pattern("filesystem-read", r"\b(?:os\.)?(?:ReadFile|Open)\s*\(", "data-integrity", 4),
    Pattern("subprocess", r"\bexec\.Command(?:Context)?\(", "error-handling", 10),
    Pattern("process-exit", r"\b(?:os\.Exit|log\.Fatal|panic)\s*\(", "error-handling", 8),
    Pattern("http", r"\b(?:http\.(?:Get|Post|Head|NewRequest|NewRequestWithContext|Handle|HandleFunc|ListenAndServe)|fetch|axios)\s*\(|\.Do\(", "api-contracts", 8),
    Pattern("database", r"\b(?:sql|pgx|pgxpool)\.(?:Open|New|Connect|ConnectConfig|Ping|PingContext|Query|QueryContext|QueryRow|QueryRowContext|Exec|ExecContext|Begin|BeginTx|Commit|Rollback|Prepare|PrepareContext|SendBatch|CopyFrom)\(", "data-integrity", 10),
    Pattern("serialization", r"\b(?:json|yaml)\.(?:Marshal|Unmarshal|NewEncoder|NewDecoder)\(", "api-contracts", 5),
    Pattern("secret", r"(?i)\b(?:password|passwd|secret|api[_-]?key|token)\s*[:=]", "security", 9),
    Pattern("crypto", r"\bcrypto/[a-z0-9]+", "security", 8),
    Pattern("time", r"\btime\.(?:Now|After|NewTicker)\(", "data-integrity", 3),
    Pattern("randomness", r"\bmath/rand\b|\brand\.(?:Intn|Float64|Read|Seed)\(", "security", 5),
    Pattern("context-background", r"\bcontext\.Background\(\)", "lifecycle-concurrency", 7),
    Pattern("goroutine", r"\bgo\s+func\(", "lifecycle-concurrency", 8),
    Pattern("unbounded-read", r"\bio\.ReadAll\(", "performance", 9),
]
#: User-facing surface.
SURFACE = [
    Pattern("flag", r'\bflag\.(?:String|Bool|Int|Duration|Float64)\(\s*"([^"]+)"'),
    Pattern("env-var", r'\bos\.(?:Getenv|LookupEnv)\(\s*"([^"]+)"'),
    Pattern("config-key", r'`[^`]*yaml:"([^" ,]+)[^"]*"[^`]*`'),
    Pattern("schema-field", r'`[^`]*json:"([^" ,]+)[^"]*"[^`]*`'),
    Pattern("route", r'\bhttp\.(?:Handle|HandleFunc)\(\s*"([^"]+)"'),
    Pattern("output", r"\b(?:fmt\.Fprint\w*|os\.Std(?:out|err)|json\.NewEncoder)\("),
]
#: Roles of call suffixes at a trust boundary.
ROLES = {
    "constructor": ["Open", "Connect", "ConnectConfig", "New", "NewPool", "NewWithConfig", "NewClient", "NewRequest", "NewServeMux"],
    "reader": ["Get", "Head", "Stat", "Read", "ReadFile", "Query", "QueryContext", "QueryRow", "QueryRowContext", "Select", "Decode", "Unmarshal", "Ping"],
    "writer": ["Post", "Put", "Patch", "Delete", "Exec", "ExecContext", "Begin", "BeginTx", "Commit", "Rollback", "CopyFrom", "SendBatch", "Write", "WriteFile", "Create", "CreateTemp", "Remove", "RemoveAll", "Rename", "MkdirAll", "Encode", "Marshal", "Do"],
}


def hits(lines: DataFrame, patterns: list[Pattern], line_text: str = "text") -> DataFrame:
    """One row per line and pattern that holds: the line's columns, kind, ordinal of the pattern, name and lane."""

    def one(i: int, p: Pattern) -> Column:
        name = F.regexp_extract(line_text, p.regex, 1) if "([^" in p.regex else F.lit("")
        holds = F.col(line_text).rlike(p.regex)
        if p.bounded:
            holds = holds & (F.regexp_count(line_text, F.lit(p.regex)) > F.regexp_count(line_text, F.lit(p.regex + p.bounded)))
        return F.when(holds, F.struct(F.lit(i).alias("ordinal"), F.lit(p.kind).alias("kind"), F.lit(p.lane).alias("lane"), name.alias("name")))

    every = F.filter(F.array(*[one(i, p) for i, p in enumerate(patterns)]), lambda h: h.isNotNull())
    return lines.withColumn("_hit", F.explode(every)).select("*", "_hit.*").drop("_hit")


#: Fixed values: (signal, least value, points, lane, reason) of a file's structure; signatures earn 6 points each.
STRUCTURE = [
    ("imported_by", 5, 15, "architecture", "package imported by %d files"),
    ("depends_on", 8, 10, "coupling", "imports %d dependencies"),
    ("symbols", 25, 8, "large-functions", "%d symbols in one file"),
    ("signatures", 1, 6, "api-contracts", "%d complex public signature(s)"),
]


def structure_points(signals: DataFrame) -> DataFrame:
    """(path, line, ordinal, lane, reason, weight) of structure signals."""
    stages = [
        F.when(F.col(name) >= least, F.struct(F.lit(0).alias("line"), F.lit(50 + i).alias("ordinal"), F.lit(lane).alias("lane"), F.format_string(reason, name).alias("reason"), (F.lit(weight) * (F.col(name) if name == "signatures" else F.lit(1))).cast("int").alias("weight")))
        for i, (name, least, weight, lane, reason) in enumerate(STRUCTURE)
    ]
    return signals.select("path", F.explode(F.array_compact(F.array(*stages))).alias("s")).select("path", "s.*")


def risk_points(files: DataFrame, lines: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Scored observations: path, lane, reason, points after decay, counted; signals are those of ``imports.structure_signals``.

    The n-th observation of a reason earns half of the one before, at least 1;
    matches of a pattern beyond its maximum earn nothing.
    """
    lower = F.lower("path")
    entry = F.col("path").startswith("cmd/") | lower.endswith("/main.go") | (F.col("path") == "main.go")
    stages = [F.when(entry, F.struct(F.lit(0).alias("line"), F.lit(0).alias("ordinal"), F.lit("cli-ux").alias("lane"), F.lit("entrypoint or command surface").alias("reason"), F.lit(20).alias("weight")))]
    for i, (term, weight, lane, reason) in enumerate(RISK_TERMS):
        stages.append(
            F.when(lower.rlike(f"(?:^|[^a-z0-9]){term}(?:[^a-z0-9]|$)"), F.struct(F.lit(0).alias("line"), F.lit(1 + i).alias("ordinal"), F.lit(lane).alias("lane"), F.lit(reason).alias("reason"), F.lit(weight).alias("weight")))
        )
    of_path = files.select("path", F.explode(F.filter(F.array(*stages), lambda s: s.isNotNull())).alias("s")).select("path", "s.*")
    meta = F.array(*[F.struct(F.lit(p.reason).alias("reason"), F.lit(p.weight).alias("weight"), F.lit(p.most).alias("most"), F.lit(p.generic).alias("generic")) for p in RISK])
    found = hits(lines, RISK).withColumn("m", F.element_at(meta, F.col("ordinal") + 1)).filter((F.col("language") == "go") | F.col("m.generic"))
    nth = F.row_number().over(Window.partitionBy("path", "ordinal").orderBy("number"))
    capped = found.withColumn("_n", nth).filter(F.col("_n") <= F.col("m.most"))
    of_line = capped.select("path", F.col("number").alias("line"), (F.col("ordinal") + 100).alias("ordinal"), "lane", "m.reason", "m.weight")
    every = of_path.unionByName(of_line)
    if signals is not None:
        every = every.unionByName(structure_points(signals))
    again = F.row_number().over(Window.partitionBy("path", "reason").orderBy("line", "ordinal"))
    return every.withColumn("_k", again).withColumn("points", F.greatest(F.lit(1), F.expr("shiftright(weight, least(_k - 1, 30))"))).select("path", "lane", "reason", "line", "points")


def risk_files(points: DataFrame) -> DataFrame:
    """Score, lanes and reasons of each file that scored."""
    return points.groupBy("path").agg(F.sum("points").cast("long").alias("score"), F.array_sort(F.collect_set("lane")).alias("lanes"), F.count_distinct("reason").alias("reasons"))


def effects(lines: DataFrame) -> DataFrame:
    """Distinct effects (path, kind, op, line, lane) of the lines."""
    found = hits(lines, EFFECTS)
    op = F.when(F.instr("text", "(") > 1, text.trimmed(F.substring_index("text", "(", 1))).otherwise(F.lit(""))
    return found.select("path", "kind", op.alias("op"), F.col("number").alias("line"), "lane", "text").dropDuplicates(["path", "kind", "op", "line"])


def effect_scores(found: DataFrame) -> DataFrame:
    """Score and lanes of each file with effects."""
    weights = F.create_map(*[F.lit(x) for p in EFFECTS for x in (p.kind, p.weight)])
    return found.groupBy("path").agg(F.sum(weights[F.col("kind")]).cast("long").alias("score"), F.count(F.lit(1)).alias("effects"), F.array_sort(F.collect_set("lane")).alias("lanes"))


def owners(found: DataFrame) -> DataFrame:
    """Files that own boundary operations, with the roles of their calls."""
    role = F.create_map(*[F.lit(x) for r, names in ROLES.items() for n in names for x in (n, r)])
    called = F.regexp_extract("text", r"\b([A-Za-z_][\w.]*)\(", 1)
    suffix = F.element_at(F.split(called, r"\."), -1)
    return found.withColumn("role", role[suffix]).filter(F.col("role").isNotNull()).groupBy("path").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("evidence"))
