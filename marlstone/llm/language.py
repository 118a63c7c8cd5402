"""Language of documents and of the paragraphs of mixed ones.

One interpolated Kneser-Ney character model per language. The models are
trained here, on a sample of labelled documents that is bounded per language
(``PER_LANGUAGE``, drawn by a hash of the id, so that it doesn't depend on the
order of rows); a first model drops the sampled paragraphs that contradict
their label, the second is trained on the rest. All n-grams of an order lie in
one array sorted by hash, with the log probability of each language beside;
n-grams nobody has seen take the back-off weight of their context and the
next shorter n-gram. Every paragraph of every document is scored whole, and
gets the language with the lowest cross-entropy per character.

A heading counts as no prose and takes one of the document's languages.

The confidence is the posterior: the models' likelihood, tempered to fit
held-out paragraphs and pieces of them of a few words, right and wrong answers
alike. Labels are wrong at times, so the fit has a share of random labels
beside the temper. Rejection is calibrated on the same pieces: a paragraph
whose posterior is so low that fewer than ``LEAST_ACCURACY`` of the pieces
like it are right, or whose cross-entropy lies above all of them for its
length, has no language of its own and takes the document's.

Defined cases: documents without any prose (NULL, empty, code only) get a NULL
language with confidence 0 and are no cases; a label of an unknown form names
another language; labels are read in any letter case; ties go to the first
language of ``LANGUAGES``; repeated documents get a row each; empty tables
give empty results; without any labelled document there is no model and every language is NULL; only the named columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from marlstone.session import ship_package

LANGUAGES = ["en", "de", "fr", "es", "pt", "nl", "it"]
#: The forms of a label beside the two-letter code.
ALIASES = {
    "eng": "en", "english": "en",
    "deu": "de", "ger": "de", "german": "de",
    "fra": "fr", "fre": "fr", "french": "fr",
    "spa": "es", "spanish": "es",
    "por": "pt", "portuguese": "pt",
    "nld": "nl", "dut": "nl", "dutch": "nl",
    "ita": "it", "italian": "it",
}
MISSING = {"", "und", "unknown"}
#: Labelled documents per language to train on, at most.
PER_LANGUAGE = 400
#: Documents that are longer are not drawn for training, so that the sample has a size bound; drawn ones are used whole.
SAMPLE_CHARS = 100_000
ORDER = 5
#: Share of right answers among held-out pieces of a posterior from which on an answer is accepted.
LEAST_ACCURACY = 0.6
#: Words of the held-out pieces.
PIECES = (1, 2, 3, 5, 8)
#: Letters of a paragraph that carry a language of their own.
LEAST_LETTERS = 8
#: Characters scored at once.
CHUNK = 2_000_000

LETTERS = " 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
_CODES = np.full(0x10000, len(LETTERS), np.uint8)
for _i, _c in enumerate(LETTERS):
    _CODES[ord(_c)] = _i
_CODES[0x2019] = LETTERS.index("'")
SYMBOLS = len(LETTERS) + 1
BITS = 6

_BREAK = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_FENCE = regex.compile(r"(?:^|\n)[ \t]*(?:```|~~~)[^\n]*(?:\n|$)(?:.*?(?:\n[ \t]*(?:```|~~~)[ \t]*(?=\n|$)|$))", regex.S)
# code in prose: back-ticked spans, links, and words with inner capitals, digits or underscores; each word is scanned once
_NOISE = regex.compile(r"`[^`\n]*+`|https?://\S++|(?<!\w)(?:\p{L}*?\p{Ll}\p{Lu}|\p{L}*+[\d_])\w*+")
_HEADING = regex.compile(r"\s{0,3}(?:#{1,6}\s[^\n]*|[^\n]+\n\s{0,3}(?:=+|-+))\s*")
_OTHER = regex.compile(r"[^\p{L}'’]+")


def paragraphs(text: str | None) -> list[str]:
    """Paragraphs of a text: stretches between blank lines."""
    return [p for p in _BREAK.split(text.replace("\r\n", "\n").replace("\r", "\n")) if p.strip()] if text else []


def prose(paragraph: str) -> str:
    """Lower-case words of a paragraph without code, divided by single blanks."""
    plain = _FENCE.sub(" ", paragraph) if "```" in paragraph or "~~~" in paragraph else paragraph
    return _OTHER.sub(" ", _NOISE.sub(" ", plain)).strip().lower()


def is_heading(paragraph: str) -> bool:
    """A paragraph that is only a heading: it is no prose, so it doesn't make a document mixed."""
    return _HEADING.fullmatch(paragraph) is not None


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label; NULL for a missing one, the label itself for an unknown form."""
    text = (label or "").strip().lower()
    if text in MISSING:
        return None
    first = regex.split(r"[-_]", text)[0]
    return first if first in LANGUAGES else ALIASES.get(first) or ALIASES.get(text) or text


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts): every text behind ORDER - 1 blanks and before one."""
    pad = " " * (ORDER - 1)
    joined = "".join(f"{pad}{t} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return _CODES[np.minimum(points, 0xFFFF)].astype(np.int64), starts


def _keys(symbols: np.ndarray, n: int) -> np.ndarray:
    """Packed n-gram that ends at each place from n - 1 on."""
    out = symbols[: len(symbols) - n + 1].copy()
    for k in range(1, n):
        out = (out << BITS) | symbols[k : len(symbols) - n + 1 + k]
    return out


class HashArray:
    """Keys in an array sorted by hash, with a directory of the leading hash bits."""

    def __init__(self, keys: np.ndarray):
        h = self.hashed(keys)
        self.order = np.argsort(h, kind="stable")
        self.keys = keys[self.order]
        self.bits = int(np.clip(len(keys).bit_length(), 8, 20))
        self.start = np.searchsorted(h[self.order] >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1).astype(np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(keys) else 0

    @staticmethod
    def hashed(keys: np.ndarray) -> np.ndarray:
        return keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the array, -1 where it isn't there."""
        bucket = (self.hashed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[bucket].astype(np.int64), self.start[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], keys[left]
        while len(left):
            same = self.keys[at] == wanted
            out[left[same]] = at[same]
            at = at + 1
            more = ~same & (at < end)
            left, at, end, wanted = left[more], at[more], end[more], wanted[more]
        return out


@dataclass
class Model:
    """Kneser-Ney models of all languages, and the calibration of their answers."""

    tables: list[HashArray] = field(default_factory=list)  # n-grams of order 1, 2, ...
    logs: list[np.ndarray] = field(default_factory=list)  # their log probabilities, a column per language
    contexts: list[HashArray] = field(default_factory=list)  # contexts of length 1, 2, ...
    weights: list[np.ndarray] = field(default_factory=list)  # log back-off weights of the contexts
    floor: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), -np.log(SYMBOLS), np.float32))  # of a symbol nobody has seen
    temper: float = 1.0
    least: float = 0.6
    typical: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), 2.0))
    spread: float = 10.0

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character and language, characters) of each text; texts are whole."""
        sums, sizes = [], []
        part: list[str] = []
        room = 0
        for t in [*texts, None]:
            if part and (t is None or room + len(t) > CHUNK):
                s, n = self._scored(part)
                sums.append(s)
                sizes.append(n)
                part, room = [], 0
            if t is not None:
                part.append(t)
                room += len(t) + ORDER
        if not sums:
            return np.zeros((0, len(LANGUAGES))), np.zeros(0, np.int64)
        n = np.concatenate(sizes)
        return -np.concatenate(sums) / n[:, None], n

    def _scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols, starts = _symbols(texts)
        out = np.empty((len(texts), len(LANGUAGES)))
        # in slices of whole texts where possible, so that the matrix of scores stays small
        scores = np.empty((len(symbols) - ORDER + 1, len(LANGUAGES)), np.float32)
        keys = _keys(symbols, ORDER)
        todo = np.arange(len(keys))
        carried = None
        for n in range(ORDER, 0, -1):
            key = keys[todo] & ((1 << (BITS * n)) - 1)
            at = self.tables[n - 1].find(key)
            hit = at >= 0
            found = self.logs[n - 1][at[hit]]
            scores[todo[hit]] = found if carried is None else found + carried[hit]
            todo, key = todo[~hit], key[~hit]
            if not len(todo):
                break
            rest = np.zeros((len(todo), len(LANGUAGES)), np.float32) if carried is None else carried[~hit]
            if n > 1:
                at = self.contexts[n - 2].find(key >> BITS)
                known = at >= 0
                rest[known] += self.weights[n - 2][at[known]]
            else:
                scores[todo] = rest + self.floor
            carried = rest
        # the last ORDER - 1 places of a slice belong to n-grams that run into the next text's blanks
        ends = np.append(starts[1:], len(symbols))
        lengths = ends - starts - (ORDER - 1)
        place = np.repeat(np.arange(len(texts)), lengths)
        local = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        own = scores[starts[place] + local]
        bounds = np.cumsum(lengths) - lengths
        out[:] = np.add.reduceat(own.astype(np.float64), bounds, axis=0)
        return out, lengths

    def decide(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, confidence, accepted) of each text; texts without letters aren't accepted."""
        size = np.array([len(t) for t in texts], np.int64)
        best, confidence, accepted = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
        some = np.flatnonzero(size >= LEAST_LETTERS)
        if len(some) and self.tables:
            h, n = self.entropies([texts[i] for i in some])
            b = h.argmin(axis=1)
            logit = -(h - h.min(axis=1, keepdims=True)) * n[:, None] * self.temper
            post = 1 / np.exp(logit).sum(axis=1)
            fits = (h[np.arange(len(b)), b] - self.typical[b]) * np.sqrt(n) <= self.spread
            best[some], confidence[some], accepted[some] = b, post, fits & (post >= self.least)
        return best, confidence, accepted


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: the n-grams and their counts, raw for the highest order, continuation counts below."""
    symbols, starts = _symbols(texts)
    ends = np.append(starts[1:], len(symbols))
    inside = np.zeros(len(symbols), bool)
    for a, b in zip(starts, ends):
        inside[a + ORDER - 1 : b] = True
    out: list = [np.unique(_keys(symbols, ORDER)[inside[ORDER - 1 :]], return_counts=True)]
    for n in range(ORDER - 1, 0, -1):
        longer = out[0][0] & ((1 << (BITS * n)) - 1)
        out.insert(0, np.unique(longer, return_counts=True))
    return out


def fit(samples: list[list[str]]) -> Model:
    """Models of samples[l], the training texts of language l."""
    model = Model()
    counts = [_counts(t) if t else [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * ORDER for t in samples]
    lower = None
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([c[n - 1][0] for c in counts]))
        table = HashArray(union)
        context_keys = np.unique(union >> BITS)
        contexts = HashArray(context_keys)
        probs = np.empty((len(union), len(LANGUAGES)))
        weights = np.zeros((len(context_keys), len(LANGUAGES)))
        suffix = model.tables[n - 2].find(table.keys & ((1 << (BITS * (n - 1))) - 1)) if n > 1 else None
        context = contexts.find(table.keys >> BITS)
        for l in range(len(LANGUAGES)):
            keys, c = counts[l][n - 1]
            below = np.full(len(union), 1 / SYMBOLS) if n == 1 else lower[suffix, l]
            if not len(keys):
                probs[:, l] = below
                continue
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            mine = np.zeros(len(union))
            mine[table.find(keys)] = c
            total = np.bincount(context, mine, len(context_keys))
            kinds = np.bincount(context, mine > 0, len(context_keys))
            seen = total > 0
            back = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
            weights[:, l] = np.log(back)
            probs[:, l] = np.maximum(mine - discount, 0) / np.maximum(total, 1)[context] + back[context] * below
        model.tables.append(table)
        model.logs.append(np.log(np.maximum(probs, 1e-12)).astype(np.float32))
        if n == 1:
            model.floor = (weights[0] - np.log(SYMBOLS)).astype(np.float32)
        else:
            model.contexts.append(contexts)
            model.weights.append(weights.astype(np.float32))
        lower = probs
    return model


def calibrate(model: Model, held: list[tuple[str, int]]) -> Model:
    """Set the temper and the rejection limits by held-out (text, language index) pairs, whatever the model says of them."""
    pieces = list(held)
    for t, l in held:
        words = t.split(" ")
        pieces += [(" ".join(words[i : i + k]), l) for k in PIECES for i in range(0, min(len(words), 3 * k), k)]
    pieces = sorted({(t, l) for t, l in pieces if len(t) >= LEAST_LETTERS})
    if len(pieces) < 20:
        return model
    h, n = model.entropies([t for t, _ in pieces])
    truth = np.array([l for _, l in pieces])
    row = np.arange(len(truth))
    best = None
    for temper in 2.0 ** np.arange(-8, 3.1, 0.5):
        logit = -(h - h.min(axis=1, keepdims=True)) * n[:, None] * temper
        post = np.exp(logit)
        mine = post[row, truth] / post.sum(axis=1)
        for noise in (0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16):
            loss = -np.log(np.maximum((1 - noise) * mine + noise / len(LANGUAGES), 1e-300)).mean()
            if best is None or loss < best[0]:
                best = (loss, temper, noise)
    model.temper, noise = float(best[1]), best[2]
    first = h.argmin(axis=1)
    top = 1 / np.exp(-(h - h.min(axis=1, keepdims=True)) * n[:, None] * model.temper).sum(axis=1)
    right = (first == truth) / (1 - noise)
    # the lowest posterior whose neighbourhood, a twentieth wide or 20 pieces, is right often enough
    order = np.argsort(-top, kind="stable")
    model.least = 1 / len(LANGUAGES)
    for low in np.arange(0.95, 1 / len(LANGUAGES), -0.05):
        near = (top >= low) & (top < low + 0.05)
        if near.sum() < 20:
            near = order[max(0, int((top >= low).sum()) - 20) : int((top >= low).sum())]
        if len(right[near]) and right[near].mean() < LEAST_ACCURACY:
            model.least = float(low + 0.05)
            break
    own = h[row, first]
    for l in range(len(LANGUAGES)):
        if (first == l).any():
            model.typical[l] = np.average(own[first == l], weights=n[first == l])
    model.spread = float(((own - model.typical[first]) * np.sqrt(n)).max())
    return model


def train(documents: DataFrame, doc_id: str, text: str, label: str, per_language: int = PER_LANGUAGE) -> Model:
    """Model trained on at most per_language labelled documents of each language.

    The sample is collected: at most ``2 * per_language`` texts of each of the languages, of ``SAMPLE_CHARS`` characters at most.
    """
    forms = {c: c for c in LANGUAGES} | ALIASES
    first = F.split(F.lower(F.btrim(F.col(label))), "[-_]")[0]
    code: Column = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])[first]
    labelled = documents.select(F.xxhash64(F.lit(29), F.col(doc_id)).alias("h"), F.col(text).alias("text"), code.alias("code")).filter(F.col("code").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    sizes = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model()
    # a threshold of the hash per language: no sort, no shuffle of texts
    span = 2**63
    limit = F.create_map(*[F.lit(x) for c, n in sorted(sizes.items()) for x in (c, min(int(min(1.0, per_language / n) * span) * 2 - span, span - 1))])
    drawn = labelled.filter(F.col("h") <= limit[F.col("code")])
    # rows of one id share a hash, so more may be drawn than were meant; which stay doesn't depend on the order of rows
    place = F.row_number().over(Window.partitionBy("code").orderBy("h", F.xxhash64("text")))
    rows = sorted(drawn.withColumn("n", place).filter(F.col("n") <= 2 * per_language).select("h", "code", "text").collect(), key=lambda r: (r["code"], r["h"], r["text"]))
    texts: list[tuple[str, int, bool]] = []
    for r in rows:
        held = r["h"] % 5 == 0
        texts += [(t, LANGUAGES.index(r["code"]), held) for p in paragraphs(r["text"]) if len(t := prose(p)) >= LEAST_LETTERS]
    model = fit([[t for t, l, held in texts if l == k and not held] for k in range(len(LANGUAGES))])
    if texts:
        # wrong labels and foreign paragraphs: the other languages' models fit them better
        for _ in range(2):
            best, _, _ = model.decide([t for t, _, _ in texts])
            sound = [(t, l, held) for (t, l, held), b in zip(texts, best) if b == l]
            model = fit([[t for t, l, held in sound if l == k and not held] for k in range(len(LANGUAGES))])
        model = calibrate(model, [(t, l) for t, l, held in texts if held])
    return model


def store(model: Model, spark: SparkSession, path: str) -> None:
    """Write a model as a table of one row, so that later runs need not train it again."""
    spark.createDataFrame([(bytearray(pickle.dumps(model, protocol=5)),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> Model:
    """The model of a table that ``store`` wrote; it is trusted as code is."""
    return pickle.loads(bytes(spark.read.parquet(path).first()["model"]))


def _label(model: Model, ids: list, texts: list, labels: list) -> pd.DataFrame:
    owner, number, bodies, headings = [], [], [], []
    for i, text in enumerate(texts):
        for k, p in enumerate(paragraphs(text)):
            owner.append(i)
            number.append(k + 1)
            bodies.append(prose(p))
            headings.append(is_heading(p))
    best, confidence, accepted = model.decide(bodies)
    by_doc: dict[int, list[int]] = {}
    for j, i in enumerate(owner):
        by_doc.setdefault(i, []).append(j)
    rows = []
    for i, doc_id in enumerate(ids):
        parts = by_doc.get(i, [])
        weight = np.zeros(len(LANGUAGES))
        sure = 0.0
        for j in parts:
            if accepted[j] and not headings[j]:
                weight[best[j]] += len(bodies[j])
        if not weight.any():  # nothing clear: the whole text decides
            whole = " ".join(b for j in parts if (b := bodies[j]))
            if len(whole) >= LEAST_LETTERS and model.tables:
                b, c, _ = model.decide([whole])
                weight[b[0]], sure = len(whole), float(c[0]) / 2
        main = LANGUAGES[int(weight.argmax())] if weight.any() else None
        mine = [j for j in parts if accepted[j] and LANGUAGES[best[j]] == main]
        if mine:
            sizes = np.array([len(bodies[j]) for j in mine], float)
            sure = float((confidence[mine] * sizes).sum() / sizes.sum())
        code = label_code(labels[i])
        mixed = (weight > 0).sum() > 1
        rows.append((doc_id, 0, main, sure, bool(mixed), main is not None and code != main))
        if mixed:
            for j in parts:
                if headings[j] and accepted[j]:
                    h, _ = model.entropies([bodies[j]])
                    best[j] = int(np.where(weight > 0, h[0], np.inf).argmin())
                own = accepted[j]
                rows.append((doc_id, number[j], LANGUAGES[best[j]] if own else main, float(confidence[j]) if own else 0.0, True, True))
    return pd.DataFrame(rows, columns=["doc_id", "seg_no", "lang", "confidence", "mixed", "found"])


def label_documents(documents: DataFrame, doc_id: str, text: str, label: str, model: Model | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, mixed, found): segment 0 is the document, 1.. the paragraphs of mixed ones.

    ``found`` marks segment 0 where the label is missing or another language, and every other segment.
    """
    ship_package(documents.sparkSession)
    model = model or train(documents, doc_id, text, label)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, labels = batch["doc_id"].tolist(), batch["text"].tolist(), batch["label"].tolist()
            at = 0
            while at < len(ids):  # by text size, not by rows
                end, room = at, 0
                while end < len(ids) and (end == at or room + len(texts[end] or "") <= CHUNK // 4):
                    room += len(texts[end] or "")
                    end += 1
                yield _label(shared.value, ids[at:end], texts[at:end], labels[at:end])
                at = end

    picked = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    return picked.mapInPandas(run, f"doc_id {kind}, seg_no int, lang string, confidence double, mixed boolean, found boolean")
