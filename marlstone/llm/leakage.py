"""Evaluation passages inside a training corpus.

Text and passage match where they share at least ``words`` consecutive words:
maximal runs of letters and digits in lower case, whatever stands between
them. ``build_index`` reads the corpus once: each task packs the documents of
its partition into shards and writes an FM-index of each, over all words of
its documents. ``search_index`` searches any passages in the stored index, as
often as wanted, without the texts: all windows of ``words`` words of the
passages are searched backwards at once, occurrences are located by sampled
suffix positions, and touching occurrences of one case become one span to
remove. The corpus is never shuffled.

Passages are read in blocks of a bounded size; each block is broadcast and
makes one pass over the index, so any number of cases works.

Defined cases: NULL and empty texts and passages share nothing; a passage of
fewer words than a window is never found; repeated passages are found under each of their case
ids; a document that is larger than a shard becomes one shard of its own; repeated documents are
reported for each row; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.fmindex import FMIndex
from marlstone.session import materialize, ship_package

#: Letters and digits of any script.
WORD = re.compile(r"[^\W_]+")
#: Words of a match.
WORDS = 12
#: Bytes of passages per broadcast block.
BLOCK_BYTES = 16 << 20
#: Words per shard of the corpus.
SHARD_WORDS = 600_000


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text; it is split before it is lower-cased, since lower case can hold other breaks."""
    if not text:
        return []
    if "\u0130" in text or "\u03a3" in text:  # the lower case of these two has other characters or depends on what follows
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


_ALNUM: list[np.ndarray] = []


def spans_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the words of a text, in characters."""
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = _ALNUM[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


class Phrases:
    """Words of a block of passages, and the places where windows start."""

    def __init__(self, passages: list[tuple[str, str]], words: int = WORDS):
        self.words = words
        vocabulary: dict[str, int] = {}
        ids: list[int] = []
        starts, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.cases = [case for case, _ in passages]
        for k, (_, passage) in enumerate(passages):
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(passage)]
            if len(own) >= words:
                starts.append(np.arange(len(ids), len(ids) + len(own) - words + 1))
                owner.append(np.full(len(own) - words + 1, k))
                ids += own
        self.vocabulary = list(vocabulary)
        self.ids = np.array(ids, np.int32)
        self.starts, self.owner = np.concatenate(starts), np.concatenate(owner)


class Shard:
    """Documents that are indexed together."""

    def __init__(self) -> None:
        self.docs: list = []
        self.parts: list[list[str]] = []
        self.begins: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        words = words_of(text)
        if not words:
            return
        begins, ends = spans_of(text)
        self.docs.append(doc_id)
        self.parts.append(words)
        self.begins.append(begins)
        self.lengths.append(ends - begins)
        self.size += len(words)

    def packed(self) -> bytes:
        """The stored index: vocabulary, FM-index, documents, and the place of each word in its text."""
        vocabulary: dict[str, int] = {}
        seq = np.zeros(self.size + len(self.docs), np.int32)
        firsts = np.zeros(len(self.docs), np.int64)
        at = 0
        for k, words in enumerate(self.parts):
            firsts[k] = at
            seq[at : at + len(words)] = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            at += len(words) + 1
        gaps = np.concatenate([np.diff(b, prepend=0) for b in self.begins])
        places = [zlib.compress(x.astype(np.int32).tobytes(), 1) for x in (gaps, np.concatenate(self.lengths))]
        return pickle.dumps((list(vocabulary), FMIndex(seq, len(vocabulary)).state(), self.docs, firsts, places), protocol=5)


def build_index(documents: DataFrame, doc_id: str, text: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(words, docs, packed) of each shard, written in the shared folder; it can be written elsewhere and read again."""
    ship_package(documents.sparkSession)
    corpus = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(shard: Shard) -> pd.DataFrame:
            return pd.DataFrame([(shard.size, len(shard.docs), shard.packed())], columns=["words", "docs", "packed"])

        shard = Shard()
        for batch in batches:
            for doc, body in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                shard.add(doc, body)
                if shard.size >= shard_words:
                    yield row(shard)
                    shard = Shard()
        if shard.size:
            yield row(shard)

    return materialize(corpus.mapInPandas(build, "words long, docs long, packed binary"))


def occurrences(packed: bytes, phrases: Phrases) -> Iterator[tuple]:
    """(doc_id, case_id, start, end) with character offsets of each span of a stored shard."""
    words, state, docs, firsts, places = pickle.loads(packed)
    known = {w: i for i, w in enumerate(words, 1)}
    local = np.fromiter((known.get(w, 0) for w in phrases.vocabulary), np.int64, len(phrases.vocabulary))
    ids = local[phrases.ids] if len(phrases.ids) else np.zeros(0, np.int64)
    # a window with a word that the shard hasn't isn't there
    missing = np.concatenate([[0], np.cumsum(ids == 0)])
    windows = np.flatnonzero(missing[phrases.starts + phrases.words] == missing[phrases.starts]) if len(ids) else np.zeros(0, np.int64)
    if not len(windows):
        return
    index = FMIndex.restored(state)
    low, high = index.search(ids[phrases.starts[windows][:, None] + np.arange(phrases.words)])
    hits = np.flatnonzero(low < high)
    if not len(hits):
        return
    counts = high[hits] - low[hits]
    case = np.repeat(phrases.owner[windows[hits]], counts)
    rows = np.repeat(low[hits] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    at = index.locate(rows)
    doc = np.searchsorted(firsts, at, "right") - 1
    gaps, lengths = (np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in places)
    begins = np.cumsum(gaps)
    order = np.lexsort((at, case, doc))
    doc, case, at = doc[order], case[order], at[order]
    # a new span where no occurrence of the case in the document touches the one before
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (case[1:] != case[:-1]) | (at[1:] > at[:-1] + phrases.words)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    own = firsts - np.arange(len(firsts))  # words before each document: the sequence has a 0 behind each
    offset = np.where(own > 0, begins[np.maximum(own - 1, 0)], 0)  # gaps of a document start at 0 again
    for h, t in zip(heads.tolist(), tails.tolist()):
        d = int(doc[h])
        first, last = int(at[h]) - d, int(at[t]) - d + phrases.words - 1
        yield docs[d], phrases.cases[int(case[h])], int(begins[first] - offset[d]), int(begins[last] - offset[d] + lengths[last])


def search_index(index: DataFrame, kind: str, cases: DataFrame, case_id: str, passage: str, words: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, case_id, start, end): spans of the texts that a case's passage shares with an indexed document; kind is the type of the documents' ids."""
    spark = index.sparkSession
    held = cases.select(F.col(case_id).alias("case_id"), F.col(passage).alias("passage")).filter(F.col("case_id").isNotNull() & F.col("passage").isNotNull())
    size = held.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    out = None
    for b in range(blocks):
        block = held if blocks == 1 else held.filter(F.pmod(F.xxhash64("case_id", "passage"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(Phrases([(r["case_id"], r["passage"]) for r in block.collect()], words))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for packed in batch["packed"]:
                    yield pd.DataFrame(list(occurrences(packed, shared.value)), columns=["doc_id", "case_id", "start", "end"])

        found = index.select("packed").mapInPandas(scan, f"doc_id {kind}, case_id string, start long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def leaks(documents: DataFrame, doc_id: str, text: str, cases: DataFrame, case_id: str, passage: str, words: int = WORDS, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, case_id, start, end): spans of the text that a case's passage shares with a document."""
    return search_index(build_index(documents, doc_id, text, shard_words), dict(documents.dtypes)[doc_id], cases, case_id, passage, words, block_bytes)


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, cases): overlapping spans of all cases of a document made one."""
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("start") <= reach, 0).otherwise(1)).over(by)
    grouped = found.withColumn("_part", part).groupBy("doc_id", "_part")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("case_id")).alias("cases")).drop("_part")
