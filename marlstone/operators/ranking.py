"""File ranking as a sum of named components, and detail levels under a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import paths, text

#: Points of entry file names.
ENTRY = {"main.go": 40, "main.ts": 30, "index.ts": 30, "index.js": 30, "app.py": 30, "main.py": 30, "main.rs": 30}
#: Points of exported symbols by kind; kinds not named have 1.
KIND_POINTS = {"interface": 3, "type": 3, "struct": 2, "constant": 0, "variable": 0}
#: Demotion by class.
DEMOTE = {"example": -12, "vendor": -20, "generated": -20, "docs": -6, "test": -10}
#: Tiers of the components that are not confirmed.
TIERS = {"callers": "lexical", "intent": "contextual", "consumed": "contextual"}


def tier(component: Column) -> Column:
    """Confidence tier of a component."""
    table = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return F.coalesce(table[component], F.lit("confirmed"))


def components(files: DataFrame, symbols: DataFrame, callers: DataFrame, intent: str = "", imported: DataFrame | None = None, consumed: list[str] | None = None, reference: DataFrame | None = None) -> DataFrame:
    """(path, component, points) of every component that is not 0; files has path, language, class.

    imported: (path, score) of files whose package others import; consumed: paths that are read already;
    reference: (node, bonus) of the reference graph's ranks.
    """
    name = paths.base(F.col("path"))
    entry = F.create_map(*[F.lit(x) for pair in ENTRY.items() for x in pair])
    demote = F.create_map(*[F.lit(x) for pair in DEMOTE.items() for x in pair])
    kinds = F.create_map(*[F.lit(x) for pair in KIND_POINTS.items() for x in pair])
    test = F.col("path").endswith("_test.go")
    folder = F.element_at(F.split(F.col("path"), "/"), -2)
    package = F.when(F.size(F.split(F.col("path"), "/")) > 1, folder)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    compat = F.arrays_overlap(F.split(F.translate("path", "\\", "/"), "/"), F.array(*[F.lit(x) for x in ("compat", "_compat", "legacy")]))

    def part(label: str, points) -> DataFrame:
        return files.select("path", F.lit(label).alias("component"), points.cast("long").alias("points"))

    own = F.when((F.col("language") == "go") & (stem == package), 25).otherwise(0)
    orientation = F.least(F.lit(35), own + F.when(name == "types.go", 20).otherwise(0) + F.when(~F.col("path").contains("/") & F.col("path").endswith(".go") & ~test, 8).otherwise(0))
    depth = F.least(F.lit(0), 2 - paths.depth(F.col("path")))
    class_points = F.when((F.col("class") == "test") & test, 0).otherwise(F.coalesce(demote[F.col("class")], F.lit(0))) + F.when(compat, -12).otherwise(0)
    of_symbols = symbols.filter("exported").groupBy("path").agg(F.least(F.lit(20), F.sum(F.coalesce(kinds[F.col("kind")], F.lit(1)))).cast("long").alias("points")).select("path", F.lit("symbols").alias("component"), "points")
    of_callers = callers.groupBy(F.col("dst").alias("path")).agg(F.least(F.lit(20), F.max("score")).cast("long").alias("points")).select("path", F.lit("callers").alias("component"), "points")
    tested_folders = files.filter(test).select(paths.directory(F.col("path")).alias("_d")).distinct()
    tested = files.filter(~test).withColumn("_d", paths.directory(F.col("path"))).join(tested_folders, "_d", "left_semi").select("path", F.lit("tests").alias("component"), F.lit(4).cast("long").alias("points"))
    parts = [
        part("entry", F.coalesce(entry[name], F.lit(0))),
        part("orientation", orientation),
        part("depth", depth),
        part("test_demote", F.when(test, -15).otherwise(0)),
        part("class_demote", class_points),
        tested,
        of_symbols,
        of_callers,
    ]
    if imported is not None:
        parts.append(imported.select("path", F.lit("imports").alias("component"), F.col("score").cast("long").alias("points")))
    if consumed:
        parts.append(part("consumed", F.when(F.col("path").isin(consumed), 15).otherwise(0)))
    if reference is not None:
        parts.append(reference.select(F.col("node").alias("path"), F.lit("reference_graph").alias("component"), F.col("bonus").cast("long").alias("points")))
    if intent:
        parts.append(intent_points(files, symbols, intent))
    return reduce(DataFrame.unionByName, parts).filter("points <> 0")


def intent_points(files: DataFrame, symbols: DataFrame, intent: str) -> DataFrame:
    """Points of a request's terms on path (4 / 2) and symbols (2 / 1, the first that matches), 30 at most."""
    terms = files.sparkSession.range(1).select(F.explode(text.expand_terms(F.lit(intent))).alias("term"))
    on_path = files.select("path", text.path_terms(F.col("path")).alias("parts")).crossJoin(F.broadcast(terms)).select("path", text.match_part(F.col("parts"), F.col("term"), F.lit(4), F.lit(2)).alias("p"))
    on_symbol = symbols.select("path", "line", text.split_identifier(F.col("name")).alias("parts")).crossJoin(F.broadcast(terms))
    matched = on_symbol.select("path", "term", "line", text.match_part(F.col("parts"), F.col("term"), F.lit(2), F.lit(1)).alias("p")).filter("p > 0")
    first = matched.groupBy("path", "term").agg(F.min_by("p", "line").alias("p")).select("path", "p")
    return on_path.unionByName(first).groupBy("path").agg(F.least(F.lit(30), F.sum("p")).cast("long").alias("points")).select("path", F.lit("intent").alias("component"), "points")


def ranked(files: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, score) of every file; files without a component have 0."""
    sums = parts.groupBy("path").agg(F.sum("points").alias("score"))
    return files.select("path").join(sums, "path", "left").select("path", F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def header_cutoff(files_: DataFrame, max_tokens: int) -> DataFrame:
    """(path, position, shown): files in rank order whose headers fit 70 % of the budget; the first that doesn't fit ends it.

    Only the first ``cap / 30`` positions can fit, so no more are summed.
    """
    cap = max_tokens * 4 * 70 // 100
    first = files_.orderBy(F.desc("score"), "path").limit(cap // 30 + 1)
    order = Window.orderBy(F.desc("score"), "path")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    cost = F.sum(F.octet_length("path") + 30).over(run)
    return first.select("path", F.row_number().over(order).alias("position"), (cost <= cap).alias("shown"))


def detail_levels(costs: list[tuple[int, int, int]], max_tokens: int) -> list[int]:
    """Detail level of each file in rank order from (header, summary, full) bytes; summary 0 means no symbols.

    -1 omitted, 0 header, 1 summary, 2 all symbols. The passes are sequential by
    definition (a file that is too large is skipped, later ones may fit) and run
    over at most as many files as headers fit into the budget.
    """
    budget = max_tokens * 4
    if max_tokens <= 0:
        return [2] * len(costs)
    levels, used = [-1] * len(costs), 0
    shown = 0
    for header, _, _ in costs:
        if used + header > budget * 70 // 100:
            break
        used += header
        levels[shown] = 0
        shown += 1
    for i in range(shown):
        if costs[i][1] and used + costs[i][1] <= budget:
            levels[i], used = 1, used + costs[i][1]
    for i in range(shown):
        if levels[i] == 1 and used - costs[i][1] + costs[i][2] <= budget:
            levels[i], used = 2, used - costs[i][1] + costs[i][2]
    return levels


def explain(files: DataFrame, scores: DataFrame, symbols: DataFrame, tokens: int) -> DataFrame:
    """(path, score, symbols, level, parse_confidence, omitted): each file under a budget of its own, so others don't use it up.

    Levels: -1 omitted, 0 header, 1 summary, 2 all symbols; ``omitted`` says what the budget left out.
    """
    budget = tokens * 4
    cost = F.sum(32 + F.octet_length("name") + F.octet_length("kind") + F.octet_length("signature"))
    sized = files.select("path", "language").join(scores, "path").join(symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n"), cost.alias("full")), "path", "left")
    header, n = F.octet_length("path") + 30, F.coalesce("n", F.lit(0)).cast("long")
    level = F.when(F.lit(tokens > 0) & (header > budget * 70 // 100), -1).when((n == 0) | F.lit(tokens > 0) & (header + n * 20 > budget), 0).when(F.lit(tokens > 0) & (header + F.col("full") > budget), 1).otherwise(2)
    omitted = (
        F.when(n == 0, "no symbol evidence was available for this file")
        .when(F.col("level") < 0, "omitted: token budget could not fit the file header")
        .when(F.col("level") == 0, "header only: token budget did not fit symbol detail")
        .when(F.col("level") == 1, "summary only: token budget did not fit full symbols")
    )
    return sized.withColumn("level", level).select("path", "score", n.alias("symbols"), "level", F.when(F.col("language") == "go", "confirmed").alias("parse_confidence"), omitted.alias("omitted"))
