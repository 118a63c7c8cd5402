"""Lexical retrieval and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.session import materialize

K1, B = 1.5, 0.75
RECALL_AT = [1, 5, 10, 20]
BUDGETS = [500, 1000, 2000, 4000, 8000, 16000, 32000]
MISS_TOKENS = 32_000
#: Terms of all requests up to which they are broadcast; the postings of a common term then stay spread over the documents.
BROADCAST_TERMS = 200_000


def postings(docs: DataFrame, doc: str, content: str) -> DataFrame:
    """(doc, term, tf, length) of every distinct term of a document."""
    tokens = docs.select(F.col(doc).alias("doc"), text.bm25_tokens(F.col(content)).alias("tokens"))
    every = tokens.select("doc", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    return every.groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, doc: str, content: str, queries: DataFrame, query: str, request: str, top: int = 20) -> DataFrame:
    """(query, rank, doc, score) of the best documents; ties by document, documents without a term last.

    A term that a request has twice counts twice. Postings of other terms
    never leave their stage. Documents without a shared term only matter where
    fewer than ``top`` have one; the candidates for those places are the first
    ``2 * top`` documents in order.
    """
    wanted = queries.select(F.col(query).alias("query"), F.explode(text.bm25_tokens(F.col(request))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    sizes = docs.select(F.size(text.bm25_tokens(F.col(content))).alias("length"))
    corpus = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"))
    asked = materialize(wanted)
    small = asked.count() <= BROADCAST_TERMS
    hint = F.broadcast if small else lambda d: d
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    post = materialize(postings(docs, doc, content).join(hint(asked.select("term").distinct()), "term", "left_semi"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average"))
    scored = (
        # spread by document before each posting meets every request with its term: the sums then need no shuffle
        post.repartition(parts, "doc").join(hint(asked.join(df, "term")), "term").crossJoin(F.broadcast(corpus))
        .groupBy("query", "doc").agg(F.round(F.sum(F.col("qtf") * idf * F.col("tf") * (K1 + 1) / norm), 9).alias("score"))
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    best = materialize(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    have = best.groupBy("query").agg(F.count(F.lit(1)).alias("have"))
    short = queries.select(F.col(query).alias("query")).distinct().join(have, "query", "left").filter(F.coalesce("have", F.lit(0)) < top).select("query")
    first = docs.select(F.col(doc).alias("doc")).orderBy("doc").limit(2 * top)
    fill = short.crossJoin(F.broadcast(first)).join(best.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    filled = best.select("query", "doc", "score").unionByName(fill)
    return filled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query", "rank", "doc", "score")


def metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall at fixed depths, reciprocal rank and NDCG at 10 per query with gold.

    The ideal gain counts the hits found in the top ten, not all gold.
    """
    goal = gold.distinct()
    total = goal.groupBy("query").agg(F.count(F.lit(1)).alias("gold"))
    hits = ranked.join(goal, ["query", "doc"]).groupBy("query").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in RECALL_AT],
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("h10").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    joined = total.join(hits, "query", "left")
    return joined.select(
        "query",
        *[F.coalesce(F.col(f"h{k}") / F.col("gold"), F.lit(0.0)).alias(f"recall_at_{k}") for k in RECALL_AT],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.when(F.col("h10") > 0, F.col("dcg") / ideal), F.lit(0.0)).alias("ndcg_at_10"),
    )


def first_relevant_cost(ranked: DataFrame, gold: DataFrame, cost: DataFrame) -> DataFrame:
    """(query, tokens): running cost of the ranking up to its first relevant document; a fixed cost where there is none."""
    run = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = ranked.join(cost, "doc").withColumn("spent", F.sum("tokens").over(run))
    hit = spent.join(gold.distinct(), ["query", "doc"], "left_semi").groupBy("query").agg(F.min("spent").alias("spent"))
    return gold.select("query").distinct().join(hit, "query", "left").select("query", F.coalesce("spent", F.lit(MISS_TOKENS)).cast("long").alias("tokens"))


def recall_at_budgets(costs: DataFrame) -> DataFrame:
    """Share of queries whose first relevant document lies within each budget."""
    budgets = costs.sparkSession.createDataFrame([(b,) for b in BUDGETS], "budget long")
    return costs.crossJoin(F.broadcast(budgets)).groupBy("budget").agg(F.avg((F.col("tokens") <= F.col("budget")).cast("double")).alias("recall"))
