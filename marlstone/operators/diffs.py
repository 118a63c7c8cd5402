"""Changes of symbols: spans, hunk overlap, classification, moves, set drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spans(symbols: DataFrame, ends: DataFrame) -> DataFrame:
    """symbols with ``end``: the line of the next symbol of the file, or one behind its last line (ends: path, lines)."""
    nxt = F.lead("line").over(Window.partitionBy("path").orderBy("line", "name"))
    return symbols.withColumn("_next", nxt).join(ends, "path").withColumn("end", F.coalesce("_next", F.col("lines") + 1)).drop("_next", "lines")


def overlapping(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose span [line, end) overlaps a hunk [start, end) of their path."""
    h = hunks.select("path", F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    cond = (symbols.path == h.path) & (F.col("line") < F.col("_e")) & (F.col("_s") < F.col("end"))
    return symbols.join(h, cond, "left_semi")


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """points (path, number) with the symbol whose span holds them."""
    s = symbols.select(F.col("path").alias("_p"), F.col("name").alias("symbol"), F.col("line").alias("_l"), F.col("end").alias("_e"))
    joined = points.join(s, (F.col("path") == F.col("_p")) & (F.col("number") >= F.col("_l")) & (F.col("number") < F.col("_e")))
    return joined.drop("_p", "_l", "_e")


def classify(before: DataFrame, after: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, name, kind, change): added, removed, signature or body of symbols that the hunks touch.

    Both sides carry line and end; of several symbols with one name and kind the first counts.
    """

    def first(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("path", "name", "kind").agg(F.min(F.struct("line", "end", "signature")).alias(tag))

    old = first(overlapping(before, hunks.filter("side = 'old'")), "o")
    new = first(overlapping(after, hunks.filter("side = 'new'")), "n")
    known = first(before, "b").join(first(after, "a"), ["path", "name", "kind"], "full_outer")
    joined = known.join(old, ["path", "name", "kind"], "left").join(new, ["path", "name", "kind"], "left")
    change = (
        F.when(F.col("a").isNull() & F.col("o").isNotNull(), "removed")
        .when(F.col("b").isNull() & F.col("n").isNotNull(), "added")
        .when(F.col("n").isNotNull() & (F.col("a.signature") != F.col("b.signature")), "signature")
        .when(F.col("n").isNotNull(), "body")
    )
    return joined.select("path", "name", "kind", change.alias("change")).filter("change is not null")


def moves(changes: DataFrame) -> DataFrame:
    """changes where the only addition and the only removal of a name and kind in different files become one move."""
    added, removed = changes.filter("change = 'added'"), changes.filter("change = 'removed'")
    a = added.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("to")).filter("n = 1")
    r = removed.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("m"), F.min("path").alias("from")).filter("m = 1")
    pairs = a.join(r, ["name", "kind"]).filter(F.col("to") != F.col("from")).select("name", "kind", "to", "from")
    marked = changes.join(pairs, ["name", "kind"], "left")
    gone = (F.col("change") == "removed") & (F.col("path") == F.col("from"))
    came = (F.col("change") == "added") & (F.col("path") == F.col("to"))
    return marked.filter(~F.coalesce(gone, F.lit(False))).select("path", "name", "kind", F.when(came, "moved").otherwise(F.col("change")).alias("change"), F.when(came, F.col("from")).alias("moved_from"))


def drift(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys with ``side``: left or right where only that set has them."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return a.join(b, keys, "full_outer").filter("_l is null or _r is null").select(*keys, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def upsert(existing: DataFrame, scanned: DataFrame, key: str, authored: list[str]) -> DataFrame:
    """Rows of both by key; the authored columns of an existing row win, scanned ones fill the rest."""
    e, s = existing.alias("e"), scanned.alias("s")
    joined = e.join(s, F.col(f"e.{key}") == F.col(f"s.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"e.{c}"), F.col(f"s.{c}")) if c in authored or c == key else F.coalesce(F.col(f"s.{c}"), F.col(f"e.{c}"))
    return joined.select(*[pick(c).alias(c) for c in existing.columns])
