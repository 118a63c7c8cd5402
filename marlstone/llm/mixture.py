"""Mixing sources to target token shares without sorting.

Each document has a hash; a source's budget is met by all documents a whole
number of times, plus once more those whose hash lies below a threshold. The
threshold comes from histograms: tokens are summed by source and hash bucket,
the bucket in which the budget ends is refined by the next bits of the hash,
and only that bucket, until nothing is left to split. The selection is then a
filter on the hash.

The total is a parameter; without it the tokens of all documents whose source
has a target. A source gets its share of the total, or all its documents
``max_repeats`` times where that is less. No document is used more often than
that, and no source exceeds its budget; it stays below it by less than the
document at the threshold. Documents with the same identifier have the same
hash and stay in or out together.

Defined cases: a NULL text has 0 tokens; a NULL source and a source without a
target are not selected and reported with a NULL target; a target without
documents is reported with 0; NULL or negative shares and repeats count as 0; a source named
twice in the targets counts with its largest entry; empty tables give empty results; a very long text is
counted whole; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import materialize, ship_package

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bits of the hash per histogram level, and the number of levels.
BITS, LEVELS = 12, 5
#: Split pattern of the byte-level vocabulary (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts go to the tokenizer in pieces of about this many characters, cut only where no match of the split pattern can lie across.
PIECE = 1 << 20
#: Before white space, and behind a run of letters or digits, a match always ends.
_ENDS = r"(?<=\S)(?=[ \t\r\n])|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])"
_LAST_END, _NEXT_END = regex.compile("(?r)" + _ENDS), regex.compile(_ENDS)
#: Sources up to which their plan is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000

_ENCODERS: dict = {}


def _pieces(text: str) -> Iterator[str]:
    """Pieces whose tokens are those of the whole text; a stretch without a safe cut stays whole."""
    at = 0
    while len(text) - at > PIECE:
        m = _LAST_END.search(text, at + 1, at + PIECE) or _NEXT_END.search(text, at + PIECE - 1)
        if m is None or m.start() <= at:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _hinted(df: DataFrame) -> DataFrame:
    """df with a broadcast hint where its number of rows has been seen to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def token_counter(spark: SparkSession, path: str = TOKENIZER):
    """A pandas UDF that counts a text's tokens; the vocabulary (under 1 MB) is read once here and broadcast."""
    with open(path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _ENCODERS:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
            _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = _ENCODERS[path].encode_ordinary
        for batch in texts:
            yield pd.Series([0 if t is None else sum(len(encode(p)) for p in _pieces(t)) for t in batch], dtype="int64")

    return count


def sized(docs: DataFrame, doc_id: str, text: str, source: str, path: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, h): a non-negative hash of BITS * LEVELS bits; written once, so texts are read once."""
    ship_package(docs.sparkSession)
    count = token_counter(docs.sparkSession, path)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 64 - BITS * LEVELS)
    return materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count(F.col(text)).alias("tokens"), h.alias("h")))


def budgets(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source: available tokens, budget, whole repeats and the rest to fill below the threshold."""
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    want = (
        targets.filter(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    )
    both = have.join(want, have.source.eqNullSafe(want.source), "full_outer").select(
        F.coalesce(have.source, want.source).alias("source"), F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("documents", F.lit(0)).alias("documents"), "target_share", "max_repeats"
    )
    size = F.lit(total) if total is not None else F.sum(F.when(F.col("target_share").isNotNull(), F.col("available"))).over(Window.partitionBy())
    budget = F.least(F.floor(F.col("target_share") * size), F.col("available") * F.col("max_repeats")).cast("long")
    return (
        both.withColumn("budget", F.coalesce(budget, F.lit(0)))
        .withColumn("whole", F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("available"))
    )


def thresholds(docs: DataFrame, plan: DataFrame, levels: int = LEVELS, bits: int = BITS) -> DataFrame:
    """plan with ``below``: documents with a smaller hash come once more.

    Each level sums tokens by bucket only within the bucket in which the
    budget of the source ended one level before, and keeps one row per source.
    """
    state = materialize(plan.filter(F.col("target_share").isNotNull()).select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")))
    width = bits * levels
    small = state.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else lambda d: d
    for level in range(levels):
        shift = width - bits * (level + 1)
        inside = docs.join(hint(state.select("source", "prefix")), "source").filter(F.shiftright("h", shift + bits) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        run = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        fits = run.join(hint(state.select("source", "rest")), "source").groupBy("source")
        ends = fits.agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("edge"),
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("used"),
        )
        # without an edge all that is left fits: nothing remains to refine
        state = materialize(
            state.join(ends, "source", "left").select(
                "source",
                (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"),
                F.coalesce("edge", F.lit(-1)).alias("prefix"),
                F.when(F.col("edge").isNotNull(), F.shiftleft("edge", shift)).when(F.col("prefix") >= 0, F.shiftleft(F.col("prefix") + 1, shift + bits)).otherwise(F.col("below")).alias("below"),
            )
        )
    return plan.join(state.select("source", "below"), "source", "left")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, plan) of sized documents: doc_id, source, tokens and copies of each selected one.

    The plan has one row per source or target, so its size follows the targets, not the documents.
    """
    plan = thresholds(docs, budgets(docs, targets, total))
    use = plan.filter(F.col("target_share").isNotNull()).select("source", "whole", "below")
    copies = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return docs.join(_hinted(use), "source").withColumn("copies", copies).filter(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies"), plan


def shares(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share, tokens and copies per source."""
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    joined = plan.select("source", "target_share", "max_repeats", "available", "documents", "budget").join(got, "source", "left")
    zero = joined.select("source", "target_share", "max_repeats", "available", "documents", "budget", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("selected", "copies", "most_copies")])
    whole = F.sum("selected").over(Window.partitionBy())
    return zero.withColumn("actual_share", F.when(whole > 0, F.col("selected") / whole).otherwise(F.lit(0.0)))
