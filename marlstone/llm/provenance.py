"""Generated, minified, vendored and data files among hand-written source.

What a file says of itself decides first: a notice in its own comments (never
in its strings), or a place or name that sets it apart. Everything else is
decided by a random forest over features from which notices and paths are
hidden: compression ratio, token entropy, identifier lengths, comment density,
line lengths, shares of characters, the share inside string literals.

The forest is labelled by notices. Files with a notice have ordinary bodies
where a program wrote ordinary code, and minified and data files carry no
notice, so notices alone can't show it what such bodies look like. Each file
of the training sample therefore also gives one made copy, which is labelled
because this module wrote it: its code minified, or its content encoded or
turned into a table. No threshold of a feature is written down here.

The training sample is bounded (``SAMPLE_ROWS`` files, drawn by a hash of the
id, and their copies); features and scores cover every file and its whole
content. Entries of the plan are hints only and enter as a feature.

Defined cases: a NULL content counts as empty; an empty file is a case only by
its path; a NULL path has no place; several plan entries of a file count once,
entries without a status not at all; repeated files are scored each; JSON is
data by its language, so only its notice or place decides; where no
file can be drawn the evidence alone decides; empty tables give empty results;
extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.lexers import language_of
from marlstone.session import materialize, ship_package

SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 40, 6, 11
#: Least share of the training rows in a leaf: unlabelled minified and data files, which count as written by hand there, are too few to fill one.
LEAF = 0.02
SURE = 0.87
#: Characters described at once.
CHUNK = 2_000_000

#: Directories of machine output and of third-party code (fixed values).
GENERATED_DIRS = {"generated", "__generated__", "gen", "autogen"}
VENDOR_DIRS = {"vendor", "third_party", "third-party", "thirdparty", "node_modules", "bower_components"}
#: A generated name: the marker stands before the last extension.
GENERATED_NAME = re.compile(r"(?:[._-](?:gen|generated|pb|autogen|g)|_pb2(?:_grpc)?)\.[a-z]+$|^(?:zz_generated|generated_)", re.I)
MINIFIED_NAME = re.compile(r"[.-]min\.[cm]?js$", re.I)

_MARK = r"^[\s*/#!;<>-]*"
GENERATED_NOTICE = re.compile(
    _MARK
    + r"""(?:@generated\b
 |auto-?\s?generated\b
 |(?:this\s+(?:file|code|source|module)\s+(?:is|was|has\s+been)\s+|code\s+|file\s+|automatically\s+)?(?:automatically\s+|auto-?|machine-?)?generated\s+(?:by|from|with|at|on|using|automatically)\b
 |(?:this\s+(?:file|code)\s+(?:is|was)\s+)?machine-?(?:made|generated|written)\b
 |output\s+of\s+\S+.*\bregenerate\b
 |(?:warning[:,]?\s+)?do\s+not\s+(?:edit|modify)(?:\s+(?:by\s+hand|manually|this\s+file|directly)|\s*[.!;,-]|\s*$)
 |diese\s+datei\s+wurde\s+automatisch\b|automatisch\s+(?:erzeugt|generiert)\b
 |(?:ce\s+)?fichier\s+g[ée]n[ée]r[ée]\s+automatiquement|(?:este\s+)?archivo\s+generado\s+autom|arquivo\s+gerado\s+autom|file\s+generato\s+autom|automatisch\s+gegenereerd
)""",
    re.I | re.X,
)
VENDOR_NOTICE = re.compile(
    _MARK
    + r"""(?:bundled\s+(?:here|from|with)\b|copied\s+(?:verbatim\s+|unchanged\s+|unmodified\s+)?from\s+\S+|imported\s+(?:unmodified\s+|verbatim\s+|unchanged\s+)?from\s+the\b|vendored\s+(?:from|copy)\b
 |use\s+of\s+this\s+source\s+.*\bupstream\b|\S+\s+v?\d[\w.]*\s+-\s+released\s+under\b|third-?party\s+(?:code|copy)\b)""",
    re.I | re.X,
)

#: A notice holds one of these; most comments don't, and are not searched further.
_NOTICE_WORDS = re.compile(r"generat|machine|output of|do\s+not|automati|g[ée]n[ée]r|generad|gerado|bundled|copied|imported|vendored|upstream|released|third", re.I)

_BLOCK_COMMENT = r"/\*(?:[^*]++|\*(?!/))*+\*/"
_QUOTED = r"""\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:[^'\\\n]++|\\[\s\S])*+'"""
_TRIPLE = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
_COMMENT_C = re.compile(rf"(?P<com>//[^\n]*+|{_BLOCK_COMMENT})|{_QUOTED}|`(?:[^`\\]++|\\[\s\S])*+`")
_COMMENT_GO = re.compile(rf"(?P<com>//[^\n]*+|{_BLOCK_COMMENT})|{_QUOTED}|`[^`]*+`")
_COMMENT_JAVA = re.compile(rf"(?P<com>//[^\n]*+|{_BLOCK_COMMENT})|{_TRIPLE}|{_QUOTED}")
_COMMENT_PY = re.compile(rf"(?P<com>\#[^\n]*+)|{_TRIPLE}|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|{_QUOTED}")
COMMENTS = {"go": _COMMENT_GO, "java": _COMMENT_JAVA, "python": _COMMENT_PY}

FEATURES = [
    "compression", "entropy", "identifier_mean", "identifier_short", "comment_density", "line_mean", "line_max",
    "digit_share", "punct_share", "space_share", "string_share", "distinct_share", "plan_hint",
]
#: Kinds of made copies.
COPIES = ["minified", "encoded", "wrapped", "numbers", "records"]


def place(path: str | None) -> str | None:
    """Evidence of a path: machine output, third-party code or a minified name."""
    if not path:
        return None
    *dirs, name = path.replace("\\", "/").lower().split("/")
    if VENDOR_DIRS.intersection(dirs):
        return "vendored place"
    if GENERATED_DIRS.intersection(dirs) or GENERATED_NAME.search(name):
        return "generated place"
    if MINIFIED_NAME.search(name):
        return "minified place"
    return None


def split_comments(text: str, language: str) -> tuple[list[str], str, int]:
    """(comments, text without them, characters inside strings); strings are left whole."""
    comments: list[str] = []
    parts: list[str] = []
    at = quoted = 0
    for m in COMMENTS.get(language, _COMMENT_C).finditer(text):
        if m.lastgroup == "com":
            comments.append(m.group())
            parts += [text[at : m.start()], " "]
            at = m.end()
        else:
            quoted += m.end() - m.start()
    parts.append(text[at:])
    return comments, "".join(parts), quoted


def notice(comments: list[str]) -> str | None:
    """Evidence of a file's own comments."""
    for c in comments:
        if _NOTICE_WORDS.search(c) is None:
            continue
        for line in c.strip("/").split("\n") if c.startswith("/*") else [c]:
            line = line.strip()
            if GENERATED_NOTICE.search(line):
                return "generated notice"
            if VENDOR_NOTICE.search(line):
                return "vendored notice"
    return None


def made_copy(code: str, kind: str) -> str:
    """A labelled example of a kind of body, made from the code of a file; its own bytes choose the style."""
    raw = code.encode("utf-8", "replace")
    packed = zlib.compress(raw)
    style = zlib.crc32(raw)
    pick = lambda n, *of: of[(style >> n) % len(of)]
    if kind == "minified":
        names: dict[str, str] = {}

        def short(m: re.Match) -> str:
            n = names.setdefault(m.group(), "")
            if not n:
                i = len(names)
                n = names[m.group()] = chr(97 + i % 26) + (chr(97 + i // 26 % 26) if i >= 26 else "")
            return n

        # words of the language and member names stay, as a minifier leaves them
        renamed = re.sub(r"(?<![\w.$\"'`])[A-Za-z_$][\w$]{3,}(?=[ ,;)\]=.\[]|$)", lambda m: m.group() if m.group() in _KEPT else short(m), code)
        dense = re.sub(r" ?([^\w$\s]) ?", r"\1", re.sub(r"\s+", " ", renamed))
        return pick(0, "", "", "/*! v1 */\n", "/* lib 1.2.3 */") + dense + pick(4, "", "\n", "\n//# map=x.map\n")
    opening = pick(0, "var table = ", "export const table = ", "table = ", "package a\n\nvar table = ", "package a.b;\n\nclass Table {\n    static final Object DATA = ")
    if kind == "encoded":
        return f'{opening}"{base64.b64encode(packed).decode() if style & 64 else packed.hex()}"\n'
    if kind == "wrapped":
        body, wide, margin = base64.b64encode(packed).decode(), pick(8, 60, 64, 76, 100, 120), pick(12, "    ", "\t", "  ")
        return f"{opening}(\n" + "".join(f'{margin}"{body[i : i + wide]}"{pick(16, "", " +", ",")}\n' for i in range(0, len(body), wide)) + ")\n"
    numbers = np.frombuffer(packed, np.uint8).astype(np.int64)
    pairs = numbers[: len(numbers) // 2 * 2].reshape(-1, 2) @ np.array([389, 1])
    if kind == "numbers":
        row, margin = pick(8, 8, 10, 12, 14, 16, 20), pick(12, "    ", "\t", "  ", "        ")
        form = pick(16, lambda i: str(pairs[i]), lambda i: str(pairs[i] if numbers[i] > 25 else -pairs[i]), lambda i: f"0x{numbers[i]:02x}", lambda i: f"{numbers[i]}.{pairs[i]}")
        cells = [form(i) for i in range(len(pairs))]
        return f"{opening}{pick(20, '[', '{', '(')}\n" + "".join(margin + pick(24, ", ", ", ", ",").join(cells[i : i + row]) + ",\n" for i in range(0, len(cells), row)) + "]\n"
    letters = np.array(list("aeiourstlnmdgkvz"))
    words = ["".join(letters[numbers[i : i + 4 + numbers[i] % 6] & 15]) for i in range(0, len(pairs) - 1, 2)]
    form = pick(8, '  {{ id: {}, w: 0.{}, k: "{}" }},\n', '\t{{"{2}", {0}, {1}}},\n', '    ("{2}", {0}, {1}),\n', '    "{2};{0};{1}",\n')
    return f"{opening}[\n" + "".join(form.format(pairs[2 * j] * 7, pairs[2 * j + 1], w) for j, w in enumerate(words)) + "]\n"


_KEPT = frozenset("return function const class this throw catch else while break switch case default typeof import export from async await yield null true false undefined static public private protected void final func package range struct interface".split())

#: Character classes of bytes: 0 blank, 1 letter, 2 digit, 3 other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_CLASS[48:58] = 2
_MIX = np.random.default_rng(SEED).integers(1, 2**63, (256, 32)).astype(np.uint64)


def body_features(bodies: list[str]) -> np.ndarray:
    """A row per body: compression, entropy, identifier_mean, identifier_short, line_mean, line_max, digits, other, blanks, distinct_share."""
    n = len(bodies)
    raw = [b.encode("utf-8", "replace") + b"\n" for b in bodies]
    sizes = np.array([len(r) for r in raw], np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(raw), np.uint8)
    kind = _CLASS[text]

    def per_body(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), ends - sizes)

    out = np.zeros((n, 10))
    out[:, 0] = [len(zlib.compress(r, 1)) for r in raw] / sizes
    out[:, 6], out[:, 7], out[:, 8] = per_body(kind == 2) / sizes, per_body(kind == 3) / sizes, per_body(kind == 0) / sizes
    breaks = np.flatnonzero(text == 10)
    lengths = np.diff(breaks, prepend=-1) - 1
    owner = np.searchsorted(ends, breaks, "right")
    lines = np.bincount(owner[lengths > 0], minlength=n)
    out[:, 4] = np.bincount(owner, lengths, n) / np.maximum(lines, 1)
    np.maximum.at(out[:, 5], owner, lengths)
    # tokens: runs of letters and digits, and every other character that is no blank
    place = np.flatnonzero(kind)
    if not len(place):
        return out
    k, b = kind[place], text[place]
    first = np.ones(len(place), bool)
    first[1:] = (k[1:] == 3) | (k[:-1] == 3) | (place[1:] != place[:-1] + 1)
    starts = np.flatnonzero(first)
    length = np.diff(starts, append=len(place))
    offset = np.arange(len(place)) - np.repeat(starts, length)
    # long tokens are told apart by all their bytes too: the weights repeat with another factor in each round
    weight = _MIX[b, offset & 31] * (2 * (offset >> 5) + 1).astype(np.uint64)
    of = np.searchsorted(ends, place[starts], "right")
    token = np.add.reduceat(weight, starts) ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, counts = np.unique(token, return_index=True, return_counts=True)
    total = np.bincount(of, minlength=n)
    p = counts / total[of[at]]
    out[:, 1] = np.bincount(of[at], -p * np.log2(p), n)
    out[:, 9] = np.bincount(of[at], minlength=n) / np.maximum(total, 1)
    name = k[starts] == 1
    names = np.maximum(np.bincount(of[name], minlength=n), 1)
    out[:, 2] = np.bincount(of[name], length[name], n) / names
    out[:, 3] = np.bincount(of[name & (length <= 2)], minlength=n) / names
    return out


def describe(files: list[tuple[str | None, str | None, str | None, str | None]]) -> list[tuple]:
    """(number of the file, evidence, made, code, features but the plan's) of each (path, language, content, kind of copy or NULL) and of its copy."""
    rows, bodies = [], []
    for i, (path, language, content, kind) in enumerate(files):
        lang = language_of(path, language)
        comments, code, quoted = split_comments((content or "").replace("\r\n", "\n"), lang)
        said = [notice([c]) for c in comments]
        versions = [(next((s for s in said if s), None) or place(path), False, [c for c, s in zip(comments, said) if s is None], code, quoted)]
        if kind is not None and lang != "json" and code.strip():
            versions.append(("made", True, *split_comments(made_copy(code, kind if kind != "minified" or lang != "python" else "numbers"), "javascript")))
        for evidence, made, plain, body, inside in versions:  # notices are hidden: their comments are left out of the features
            commented = sum(map(len, plain))
            size = max(len(body) + commented, 1)
            rows.append((i, evidence, made, lang != "json", commented / size, inside / size))
            bodies.append(body + "\n".join(plain))
    if not rows:
        return []
    x = body_features(bodies)
    return [(i, e, made, code, x[j, 0], x[j, 1], x[j, 2], x[j, 3], commented, x[j, 4], x[j, 5], x[j, 6], x[j, 7], x[j, 8], quoted, x[j, 9]) for j, (i, e, made, code, commented, quoted) in enumerate(rows)]


def described(files: DataFrame, plan: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(file_id, evidence, drawn, made, code, features...) of every file and of the made copies; written once, so contents are read once."""
    ship_package(files.sparkSession)
    n = files.count()
    limit = min(int(min(1.0, sample_rows / max(n, 1)) * 2**63) * 2 - 2**63, 2**63 - 1)
    h = F.xxhash64(F.lit(SEED), "file_id")
    copy = F.when(h <= limit, F.element_at(F.array(*map(F.lit, COPIES)), (F.pmod(F.xxhash64(F.lit(SEED + 1), "file_id"), F.lit(len(COPIES))) + 1).cast("int")))
    picked = files.select("file_id", F.col("path").alias("_path"), F.col("language").alias("_language"), F.col("content").alias("_content"), copy.alias("_copy"))
    kind = dict(files.dtypes)["file_id"]
    names = ["evidence", "made", "code", *FEATURES[:-1]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["file_id"].tolist()
            every = list(zip(b["_path"], b["_language"], b["_content"], b["_copy"]))
            at = 0
            while at < len(every):  # by text size, not by rows
                end, room = at, 0
                while end < len(every) and (end == at or room + len(every[end][2] or "") <= CHUNK):
                    room += len(every[end][2] or "")
                    end += 1
                rows = describe(every[at:end])
                out = pd.DataFrame([r[1:] for r in rows], columns=names)
                out.insert(0, "file_id", [ids[at + r[0]] for r in rows])
                out.insert(2, "drawn", [every[at + r[0]][3] is not None for r in rows])
                yield out
                at = end

    table = picked.mapInPandas(run, f"file_id {kind}, evidence string, drawn boolean, made boolean, code boolean, " + ", ".join(f"{f} double" for f in FEATURES[:-1]))
    if plan is None:
        return materialize(table.withColumn("plan_hint", F.lit(0.0)))
    # the plan meets the features, so contents are never shuffled
    hints = plan.filter(F.col("status").isNotNull()).groupBy("file_id").agg(F.max((F.col("status") != "clean").cast("double")).alias("plan_hint"))
    return materialize(table.join(hints, "file_id", "left").withColumn("plan_hint", F.coalesce("plan_hint", F.lit(0.0))))


def scored(table: DataFrame) -> DataFrame:
    """The files of table (no copies) with ``score``, the forest's probability that nobody wrote the file by hand.

    Trained on the drawn files and their copies; files that only their place sets apart are neither examples nor counterexamples.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    label = F.when(F.col("made") | F.col("evidence").endswith("notice"), 1.0).when(F.col("evidence").isNull(), 0.0)
    drawn = table.filter("drawn and code").withColumn("label", label).filter("label is not null")
    real = table.filter("not made")
    sizes = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        return real.withColumn("score", F.lit(0.0))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.6", minInstancesPerNode=max(5, int(LEAF * n)), seed=SEED, probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw")
    model = forest.fit(vectors.transform(drawn).select("_features", "label"))
    done = model.transform(vectors.transform(real)).withColumn("score", vector_to_array("_probability")[1])
    return done.select(*table.columns, "score")


def classify(files: DataFrame, plan: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(file_id, found, evidence, score, features...): found where the file says so itself, or where the forest does."""
    table = scored(described(files, plan, sample_rows))
    return table.withColumn("found", F.col("evidence").isNotNull() | (F.col("code") & (F.col("score") >= SURE)))
