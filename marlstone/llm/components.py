"""Connected components of pairwise links by deterministic Boruvka hooking.

Each round every component selects its smallest outgoing edge (edges are
ordered by their two ends, so choices form trees plus mutual pairs), the
smaller end of a mutual pair becomes a root, trees collapse by pointer
doubling, and the edges are relabelled and deduplicated. At least half of the
components go each round. Only the components that still have edges take part
in a round; the rounds' maps shrink and are composed backwards at the end.

No step gathers a component or the edges of a vertex: smallest edges are
pre-aggregated minima, and relabelling is a shuffled lookup that salts hot
keys. Nothing is broadcast by hint; the planner may broadcast a map that is
below its own size limit.

Defined cases: a pair with a NULL or blank name is no link and adds no vertex;
a vertex linked only to itself is its own group; repeated and reversed pairs
count once; empty tables give an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.skew import hot_keys, replicated, salted
from marlstone.session import discard, materialize

SALTS = 32


def file_key(name: Column) -> Column:
    """A file name with ``/`` for a backslash and without leading ``./``; NULL for a blank one."""
    plain = F.regexp_replace(F.translate(name, "\\", "/"), r"^(?:\./)+", "")
    return F.when(F.length(F.btrim(name, F.lit(" \t\r\n"))) > 0, plain)


def _lookup(df: DataFrame, column: str, table: DataFrame, rows: int) -> DataFrame:
    """Replace column by table(id, to) where it has the id; df has that many rows."""
    hot = hot_keys(df, column, rows=rows)
    if not hot:
        joined = df.join(table, F.col(column) == F.col("id"), "left")
        return joined.withColumn(column, F.coalesce("to", column)).drop("id", "to")
    left = salted(df, column, hot, SALTS, F.struct(*df.columns))
    right = replicated(table, "id", hot, SALTS).withColumnRenamed("_salt", "_salt2")
    joined = left.join(right, (F.col(column) == F.col("id")) & (F.col("_salt") == F.col("_salt2")), "left")
    return joined.withColumn(column, F.coalesce("to", column)).drop("id", "to", "_salt", "_salt2")


def _hook(edges: DataFrame) -> DataFrame:
    """(id, to): each vertex's other end of its smallest edge, and itself for the smaller end of an edge both chose.

    Edges have u < v. An edge is chosen by at most its two ends, so grouping
    the choices by edge finds the mutual pairs without a join.
    """
    ends = edges.select(F.col("u").alias("id"), "u", "v").unionByName(edges.select(F.col("v").alias("id"), "u", "v"))
    least = ends.groupBy("id").agg(F.min(F.struct("u", "v")).alias("e")).select("id", "e.u", "e.v")
    chosen = least.groupBy("u", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.col("u").alias("id"), F.col("u").alias("to")), F.struct(F.col("v").alias("id"), F.col("u").alias("to")))
    other = F.when(F.col("id") == F.col("u"), F.col("v")).otherwise(F.col("u"))
    one = F.array(F.struct(F.col("id").alias("id"), other.alias("to")))
    return chosen.select(F.explode(F.when(F.col("n") == 2, both).otherwise(one)).alias("h")).select("h.id", "h.to")


def _collapse(hooks: DataFrame) -> tuple[DataFrame, int]:
    """Roots (id, to) of the hooked trees by pointer doubling, and the number of vertices."""
    current = materialize(hooks)
    rows = current.count()
    while True:
        table = current.select("id", "to")
        jump = _lookup(table.select(F.col("id").alias("self"), F.col("to").alias("up"), F.col("to").alias("next")), "next", table, rows)
        doubled = materialize(jump.select(F.col("self").alias("id"), F.col("next").alias("to"), (F.col("next") != F.col("up")).alias("moved")))
        discard(current)
        current = doubled
        if doubled.filter("moved").isEmpty():
            return doubled.select("id", "to"), rows


def boruvka(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges(u, v) of BIGINTs that has a neighbour; self links are ignored."""

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    left = materialize(tidy(edges))
    maps: list[tuple[DataFrame, int]] = []
    while size := left.count():
        roots, rows = _collapse(_hook(left))
        maps.append((roots, rows))
        before, left = left, materialize(tidy(_lookup(_lookup(left, "u", roots, size), "v", roots, size)))
        discard(before)
    if not maps:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).limit(0)
    final, _ = maps.pop()
    while maps:
        earlier, more = maps.pop()
        composed = _lookup(earlier.select(F.col("id").alias("self"), F.col("to").alias("next")), "next", final, more)
        final = materialize(composed.select(F.col("self").alias("id"), F.col("next").alias("to")))
    return final.select("id", F.col("to").alias("root"))


def consolidate(pairs: DataFrame, first: Column, second: Column) -> DataFrame:
    """(name, group_name) for every distinct name of the pairs that have both names; the group's name is its smallest."""
    links = materialize(pairs.select(first.alias("a"), second.alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    size = links.count()
    names = links.select(F.col("a").alias("name")).unionByName(links.select(F.col("b").alias("name"))).distinct()
    vertices = materialize(names.select("name", F.monotonically_increasing_id().alias("vertex")))
    ends = vertices.select(F.col("name").alias("b"), F.col("vertex").alias("v"))
    hot_a, hot_b = hot_keys(links, "a", rows=size), hot_keys(links, "b", rows=size)
    by_a = salted(links, "a", hot_a, SALTS, F.col("b")).join(replicated(vertices.withColumnRenamed("name", "a"), "a", hot_a, SALTS), ["a", "_salt"]).select("b", F.col("vertex").alias("u"))
    by_b = salted(by_a, "b", hot_b, SALTS, F.col("u")).join(replicated(ends, "b", hot_b, SALTS), ["b", "_salt"]).select("u", "v")
    roots = boruvka(by_b)
    member = materialize(vertices.join(roots, F.col("vertex") == F.col("id"), "left").select("name", F.coalesce("root", "vertex").alias("root")))
    heads = member.groupBy("root").agg(F.min("name").alias("group_name"))
    hot_root = hot_keys(member, "root", rows=member.count())
    return salted(member, "root", hot_root, SALTS, F.col("name")).join(replicated(heads, "root", hot_root, SALTS), ["root", "_salt"]).select("name", "group_name")
