"""Directed graphs as edge tables: degrees, hubs, weighted PageRank, strong components, reachability."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import discard, materialize


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs."""
    return edges.select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours on either side of every node; a loop counts on both."""
    pairs = distinct_edges(edges)
    ends = pairs.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(pairs.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def hubs(edges: DataFrame, top: int = 25) -> DataFrame:
    """Nodes with the most neighbours, ties by node."""
    return degrees(edges).withColumn("degree", F.col("in_degree") + F.col("out_degree")).orderBy(F.desc("degree"), "node").limit(top)


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, most: int = 40, every: int = 4) -> DataFrame:
    """(node, rank) of a graph with (src, dst, weight); dangling mass is spread evenly.

    The rank table has one row per node; the node count and the moved mass are
    the only values that reach the driver, once per ``every`` rounds.
    """
    weights = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = weights.groupBy("src").agg(F.sum("w").alias("total"))
    links = materialize(weights.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")))
    nodes = materialize(links.select(F.col("src").alias("node"), F.lit(1).alias("has")).unionByName(links.select(F.col("dst").alias("node"), F.lit(0).alias("has"))).groupBy("node").agg(F.max("has").alias("has")))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    rank = nodes.select("node", "has", F.lit(1.0 / n).alias("rank"))
    done, kept = 0, None
    while done < most:
        before = rank
        for _ in range(min(every, most - done)):
            loose = rank.agg(F.coalesce(F.sum(F.when(F.col("has") == 0, F.col("rank"))), F.lit(0.0)).alias("loose"))
            sent = links.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            last = rank.select("node", F.col("rank").alias("was"))
            base = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.lit(float(n)))
            rank = nodes.join(sent, "node", "left").join(last, "node").crossJoin(F.broadcast(loose)).select("node", "has", base.alias("rank"), F.abs(base - F.col("was")).alias("moved"))
            done += 1
        rank = materialize(rank)
        if kept is not None:
            discard(kept)
        kept = rank
        moved = rank.agg(F.sum("moved")).first()[0]
        rank = rank.select("node", "has", "rank")
        if moved < tolerance:
            break
        del before
    return rank.select("node", "rank")


def rank_bonus(edges: DataFrame, ranks: DataFrame, most: int = 30) -> DataFrame:
    """Rank of the nodes with incoming edges as 0..most of the largest among them."""
    targets = edges.select(F.col("dst").alias("node")).distinct()
    got = ranks.join(targets, "node", "left_semi")
    return got.crossJoin(F.broadcast(got.agg(F.max("rank").alias("top")))).select("node", F.when(F.col("top") > 0, F.round(F.lit(most) * F.round("rank", 12) / F.round("top", 12))).otherwise(0).cast("int").alias("bonus"))


def strong_components(edges: DataFrame, most: int | None = None, trims: int = 4) -> DataFrame:
    """(node, component) by forward and backward labels; the component is its smallest node.

    First nodes without an edge in or out leave, each its own component, ``trims`` times or until none does.
    Each round spreads the smallest label forward along the edges left, then
    walks back among nodes of one label; the nodes that both passes give the
    label of their own root form its component and leave, and so do edges
    between labels. Labels are ordered by a hash, so that nodes in the order of
    their ids, as in a chain, split into many labels. It goes on until no node
    is left; a bound on the rounds, where given, raises.
    """
    left = materialize(distinct_edges(edges))
    todo = materialize(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    left = left.filter("src <> dst")
    parts: list[DataFrame] = []
    before = todo.count()
    for _ in range(trims):
        both = left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        kept = materialize(both)
        parts.append(todo.join(kept, "node", "left_anti").select("node", F.col("node").alias("component")))
        todo, n = kept, kept.count()
        left = materialize(left.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        if not n or n == before:
            break
        before = n
    trimmed = len(parts)

    def spread(pairs: DataFrame, start: DataFrame) -> DataFrame:
        label = materialize(start)
        while True:
            sent = pairs.join(label.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("got"))
            nxt = materialize(label.join(sent, "node", "left").select("node", F.least("label", F.coalesce("got", "label")).alias("label"), (F.col("got") < F.col("label")).alias("moved")))
            discard(label)
            label = nxt
            if label.filter("moved").isEmpty():
                return label.select("node", "label")

    while not todo.isEmpty():
        if most is not None and len(parts) - trimmed >= most:
            raise RuntimeError(f"nodes are left after {most} rounds")
        forward = spread(left.select(F.col("src").alias("a"), F.col("dst").alias("b")), todo.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")).alias("label"))).select("node", F.col("label.n").alias("label"))
        same = materialize(left.join(forward.select(F.col("node").alias("src"), F.col("label").alias("l1")), "src").join(forward.select(F.col("node").alias("dst"), F.col("label").alias("l2")), "dst").filter("l1 = l2").select("src", "dst"))
        reach = same.select(F.col("dst").alias("a"), F.col("src").alias("b"))
        roots = forward.filter("node = label").select("node")
        # within one forward label, walk back from its root: 0 marks what reaches the root
        marks = spread(reach, forward.join(roots.withColumn("root", F.lit(True)), "node", "left").select("node", F.when(F.col("root"), 0).otherwise(1).alias("label")))
        rooted = materialize(marks.filter("label = 0").select("node").join(forward, "node").select("node", "label"))
        found = materialize(rooted.join(rooted.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component"))
        parts.append(found)
        gone = found.select("node")
        todo = materialize(todo.join(gone, "node", "left_anti"))
        left = materialize(same.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    out = parts[0] if parts else todo.select("node", F.col("node").alias("component"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Components that hold a cycle: more than one node, or a node with a loop."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(1))
    return components.join(loops, "node", "left").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.max("loop"), F.lit(0)).alias("loop")).filter("nodes > 1 or loop = 1").select("component", "nodes")


def reachable(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(node, steps): nodes reached from the start nodes and the fewest edges to them; a bound on the steps, where given, raises."""
    pairs = distinct_edges(edges)
    frontier = materialize(start.select("node").distinct().withColumn("steps", F.lit(0)))
    seen = frontier
    for step in count(1):
        nxt = pairs.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = materialize(nxt.withColumn("steps", F.lit(step)))
        if frontier.isEmpty():
            break
        if most is not None and step >= most:
            raise RuntimeError(f"nodes are left after {most - 1} steps")
        seen = materialize(seen.unionByName(frontier))
    return seen


def import_score(count):
    """Ten points for each of the first eight importers, one for each further one."""
    return F.when(count <= 8, count * 10).otherwise(80 + (count - 8))


def suffix_join(names: DataFrame, name: str, targets: DataFrame, target: str) -> DataFrame:
    """(name, target): the longest target that the name equals or ends with behind a slash; ties cannot occur.

    All suffixes of a name are exploded, so it is an equality join.
    """
    parts = F.split(name, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tails = names.select(name).distinct().select(name, F.explode(every).alias("_tail"))
    hit = tails.join(targets.select(F.col(target).alias("_tail")).distinct(), "_tail")
    return hit.groupBy(name).agg(F.max_by("_tail", F.octet_length("_tail")).alias("target"))
