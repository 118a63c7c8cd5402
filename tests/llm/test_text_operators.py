"""Text operators against brute force, exact round trips and held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import components, docpairs, fmindex, language, leakage, lexers, mixture, provenance, syntax


# --- connected groups
def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _consolidate(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return {r.name: r.group_name for r in components.consolidate(df, components.file_key(F.col("a")), components.file_key(F.col("b"))).collect()}


def test_groups_against_union_find(spark):
    rng = random.Random(1)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    star = [("hub", f"s{i}") for i in range(60)]
    loose = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(40)]
    pairs = chain + star + loose + [(b, a) for a, b in chain[:5]] + [("self", "self")]
    rng.shuffle(pairs)
    assert _consolidate(spark, pairs) == _groups(pairs)


def test_groups_name_forms_and_gaps(spark):
    got = _consolidate(spark, [(".\\b\\x", "./a/x"), ("b/x", "C"), (None, "z"), ("", "y"), ("  ", "w"), ("q", "q")])
    assert got == {"b/x": "C", "a/x": "C", "C": "C", "q": "q"}
    assert _consolidate(spark, []) == {}


# --- mixing
def test_mix_meets_budgets(spark):
    rng = random.Random(2)
    rows = [(i, "big" if i % 3 else "small", rng.randint(1, 40), rng.getrandbits(60)) for i in range(900)] + [(10**6, None, 5, 1), (10**6 + 1, "other", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long, h long")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.6, 2), ("absent", 0.1, 4)], "source string, target_share double, max_repeats int")
    chosen, plan = mixture.mix(docs, targets)
    got = {r.doc_id: r.copies for r in chosen.collect()}
    total = sum(r[2] for r in rows if r[1] in ("big", "small"))
    for source, share, most in (("big", 0.3, 1), ("small", 0.6, 2)):
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: r[3])
        have = sum(r[2] for r in mine)
        budget = min(int(share * total), have * most)
        whole, rest = divmod(budget, have)
        want, used = {}, 0
        for r in mine:
            if used + r[2] > rest:
                break
            used += r[2]
            want[r[0]] = 1
        for r in mine:
            assert got.get(r[0], 0) == whole + want.get(r[0], 0) <= most
    report = {r.source: r for r in mixture.shares(chosen, plan).collect()}
    assert report["absent"].selected == 0 and report[None].target_share is None and report["other"].selected == 0
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)


def test_mix_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, tokens long, h long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, plan = mixture.mix(docs, targets)
    assert chosen.count() == 0 and mixture.shares(chosen, plan).count() == 1


def _whole_count(text):
    import base64

    import tiktoken

    with open(mixture.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    return len(tiktoken.Encoding("whole", pat_str=mixture.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))


def test_pieces_give_the_tokens_of_the_whole_text(monkeypatch):
    import base64

    import tiktoken

    with open(mixture.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    encode = tiktoken.Encoding("pieces", pat_str=mixture.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    monkeypatch.setattr(mixture, "PIECE", 40)
    rng = random.Random(6)
    parts = ["a", "it's", "\n", "\n\n", "  ", " ", "\t", "12", "x9y", "'s", "('ve", "!?", "\u4e2d\u6587", "\u00e9", "\u00a0", "\x1c", "longerword", "\r\n", "=" * 50, "z" * 90]
    cut = 0
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 120)))
        pieces = list(mixture._pieces(text))
        cut += len(pieces) > 1
        assert "".join(pieces) == text
        assert [t for p in pieces for t in encode(p)] == encode(text)
    assert cut > 300 and list(mixture._pieces("q" * 500)) == ["q" * 500]


def test_shares_against_an_independent_computation(spark):
    """Budgets, thresholds and shares worked out by sorting each source by its hash."""
    rng = random.Random(12)
    names = ["big", "mid", "small", "tiny", "none", None]
    docs = [(i, rng.choices(names, [60, 20, 10, 2, 5, 3])[0], rng.choice([0, 1, 5, 40, 400]), rng.randrange(2**60)) for i in range(3000)]
    targets = [("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.3, 4), ("tiny", 0.05, 3), ("absent", 0.05, 2)]
    chosen, plan = mixture.mix(spark.createDataFrame(docs, "doc_id long, source string, tokens long, h long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    got = {r.doc_id: r.copies for r in chosen.collect()}
    total = sum(t for _, s, t, _ in docs if s in {x[0] for x in targets})
    want = {}
    for source, share, repeats in targets:
        mine = sorted((h, i, t) for i, s, t, h in docs if s == source)
        have = sum(t for _, _, t in mine)
        budget = min(int(share * total), have * repeats)
        whole = budget // have if have else 0
        rest = budget - whole * have
        for h, i, t in mine:
            once = rest >= 0 and t <= rest
            rest = rest - t if once else -1
            if whole + once:
                want[i] = whole + once
    assert got == want
    shares = {r.source: r for r in mixture.shares(chosen, plan).collect()}
    used = {s: sum(want.get(i, 0) * t for i, x, t, _ in docs if x == s) for s in [*names, "absent"]}
    everything = sum(used.values())
    for s, r in shares.items():
        assert r.selected == used[s] and abs(r.actual_share - used[s] / everything) < 1e-12


def test_token_counts_are_whole(spark):
    docs = spark.createDataFrame([(1, "hello world", "a"), (2, None, "a"), (3, "", None), (4, "word " * 300_000, "a")], "doc_id long, text string, source string")
    got = {r.doc_id: r.tokens for r in mixture.sized(docs, "doc_id", "text", "source").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] == _whole_count('word ' * 300_000)


# --- leakage
def test_fm_index_against_search():
    rng = np.random.default_rng(0)
    for _ in range(60):
        seq = np.append(rng.integers(0, 4, rng.integers(1, 50)), 0)
        index = fmindex.FMIndex(seq, 4, 4)
        patterns = rng.integers(1, 4, (12, 3))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]


@pytest.mark.parametrize(("block", "shard"), [(1 << 20, 10**6), (40, 50)])
def test_leaks_against_brute_force(spark, block, shard):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Größe", "ça"]
    cases = [(f"c{i}", " ".join(rng.choices(vocabulary, k=20))) for i in range(8)] + [("short", "a b c"), ("none", None), ("twin", None)]
    cases[-1] = ("twin", cases[0][1])
    docs = []
    for i in range(40):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 3 == 0:
            source = cases[rng.randrange(8)][1].split()
            a = rng.randint(0, 8)
            at = rng.randint(0, len(words))
            words[at:at] = source[a : a + rng.choice([11, 12, 14])]
        docs.append((i, rng.choice([" ", "\n\n", ", ", "-"]).join(words).upper() if i % 2 else " ".join(words)))
    docs += [(100, None), (101, ""), (102, cases[1][1])]
    held = {}
    for c, p in cases:
        w = leakage.words_of(p)
        for i in range(len(w) - 11):
            held.setdefault(tuple(w[i : i + 12]), set()).add(c)
    brute = {(d, c) for d, t in docs for w in [leakage.words_of(t)] for i in range(len(w) - 11) for c in held.get(tuple(w[i : i + 12]), ())}
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, case_id string")
    c = spark.createDataFrame(cases, "case_id string, passage string")
    found = leakage.leaks(d, "doc_id", "text", c, "case_id", "passage", block_bytes=block, shard_words=shard)
    rows = found.collect()
    assert {(r.doc_id, r.case_id) for r in rows} == brute
    texts = dict(docs)
    for r in rows:
        assert len(leakage.words_of(texts[r.doc_id][r.start : r.end])) >= 12
    assert leakage.removal_spans(found).groupBy("doc_id").count().count() == len({b[0] for b in brute})


def test_stored_index_takes_other_passages_and_keeps_the_texts_offsets(spark):
    base = "Alpha beta, gamma-delta epsilon zeta eta theta iota kappa lambda mu"
    texts = {1: "\u0130stanbul'da \u0130\u0130 x " + base + " end", 2: base.upper() + " nu xi", 3: "\u039f\u0394\u039f\u03a3'\u0391 one two three four five six seven eight nine ten"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = leakage.build_index(docs, "doc_id", "text", 8)
    cases = lambda *p: spark.createDataFrame([(str(i), x) for i, x in enumerate(p)], "case_id string, passage string")
    got = leakage.search_index(index, "bigint", cases(base), "case_id", "passage").collect()
    assert {(r.doc_id, texts[r.doc_id][r.start : r.end].lower()) for r in got} == {(1, base.lower()), (2, base.lower())}
    # the same index, another set of passages, without the texts
    got = leakage.search_index(index, "bigint", cases("x", base + " NU", "\u03bf\u03b4\u03bf\u03c2 \u03b1 ONE two three four five six seven eight nine ten"), "case_id", "passage").collect()
    assert {(r.doc_id, r.case_id) for r in got} == {(1, "1"), (2, "1"), (3, "2")}
    assert leakage.search_index(index, "bigint", cases(), "case_id", "passage").count() == 0


def test_words_and_spans_agree():
    rng = random.Random(2)
    alphabet = ["a", "B", "\u0130", "\u03a3", "\u00df", "_", " ", "'", "7", "\u0301", "\u4e2d", "\U0001d7d8", "\u00b2", "\ud800"]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        begins, ends = leakage.spans_of(text)
        assert [text[a:b].lower() for a, b in zip(begins, ends)] == leakage.words_of(text)


# --- language
SENTENCES = {
    "en": "the quick review of this change should keep every line of the report and nothing else is needed here",
    "de": "die schnelle prüfung dieser änderung behält jede zeile des berichts und sonst wird hier nichts gebraucht",
    "fr": "la relecture rapide de cette modification conserve chaque ligne du rapport et rien d'autre n'est nécessaire ici",
    "es": "la revisión rápida de este cambio conserva cada línea del informe y aquí no hace falta nada más",
    "pt": "a revisão rápida desta mudança mantém cada linha do relatório e aqui não é preciso mais nada",
    "nl": "de snelle controle van deze wijziging bewaart iedere regel van het verslag en verder is hier niets nodig",
    "it": "la revisione rapida di questa modifica conserva ogni riga del rapporto e qui non serve altro",
}


def _text(rng, lang, n=25):
    return " ".join(rng.choices(SENTENCES[lang].split(), k=n)).capitalize() + "."


def test_language_accuracy_and_cases(spark):
    rng = random.Random(6)
    rows = [(i, _text(rng, l, 40), l) for i in range(30) for l in language.LANGUAGES]
    rows = [(k, t, l) for k, (_, t, l) in enumerate(rows)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(train, "doc_id", "text", "lang")
    held = [(t, i) for i, l in enumerate(language.LANGUAGES) for t in (language.prose(_text(rng, l)) for _ in range(30))]
    best, _, _ = model.decide([t for t, _ in held])
    assert np.mean([b == i for b, (_, i) in zip(best, held)]) > 0.97
    mixed = _text(rng, "en") + "\n\n```\ncode(1)\n```\n\n" + _text(rng, "de") + "\n\n" + _text(rng, "en")
    docs = [(1, _text(rng, "fr"), None), (2, _text(rng, "fr"), "fr-CA"), (3, _text(rng, "fr"), "German"), (4, mixed, "EN"), (5, None, "en"), (6, "", None), (7, "`x`", "en"), (8, _text(rng, "nl"), "xx")]
    got = {(r.doc_id, r.seg_no): r for r in language.label_documents(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "doc_id", "text", "lang", model).collect()}
    assert [got[(d, 0)].found for d in range(1, 9)] == [True, False, True, False, False, False, False, True]
    assert [got[(4, s)].lang for s in range(5)] == ["en", "en", "en", "de", "en"]
    assert got[(5, 0)].lang is None and (5, 1) not in got


def test_kneser_ney_sums_to_one():
    model = language.fit([["abab abba baab"], ["cdcd"], [], [], [], [], []])
    codes = [language._CODES[ord(c)] for c in language.LETTERS]
    for context in ("", "a", "ab", "aba"):
        total = sum(_probability(model, context, code) for code in [*codes, len(language.LETTERS)])
        assert total == pytest.approx(1, abs=1e-4)


def _probability(model, context, code):
    key = 0
    chars = [language._CODES[ord(c)] for c in (" " * 4 + context)[-4:]]
    for c in [*chars, code]:
        key = (key << language.BITS) | int(c)
    carried = 0.0
    for n in range(language.ORDER, 0, -1):
        k = np.array([key & ((1 << (language.BITS * n)) - 1)])
        at = model.tables[n - 1].find(k)
        if at[0] >= 0:
            return float(np.exp(carried + model.logs[n - 1][at[0]][0]))
        if n > 1:
            c = model.contexts[n - 2].find(k >> language.BITS)
            carried += model.weights[n - 2][c[0]][0] if c[0] >= 0 else 0.0
    return float(np.exp(carried + model.floor[0]))


def test_hash_array_finds_what_it_has():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 30, 5000))
    table = language.HashArray(keys)
    assert (table.keys[table.find(keys)] == keys).all()
    other = np.setdiff1d(rng.integers(0, 1 << 30, 5000), keys)
    assert (table.find(other) == -1).all()


def test_long_noise_is_linear():
    assert language.prose("aB" * 400_000) == "" and language.prose("a1" * 400_000) == ""


# --- syntax
GOOD = {
    "go": "package a\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n\tA int `json:\"a\"`\n}\n\nvar x = map[string]int{\"a\": 1}\n\n// F does.\nfunc (t *T) F(a int, b ...string) (int, error) {\n\tfor i, v := range b {\n\t\tif v == \"<<<<<<<\" && i >= -1 {\n\t\t\tcontinue\n\t\t}\n\t}\n\tdefer func() { fmt.Println(`\n<<<<<<< ours\n`) }()\n\treturn a &^ 1, nil\n}\n",
    "python": "def f(a, *, b=1) -> dict:\n    return {a: b}\n",
    "javascript": "#!/usr/bin/env node\nimport { a } from './a';\nexport const f = async (x, y = 1) => {\n  const re = /[/]\\//g;\n  const t = `a ${x ? `${y}` : { z: 1 }.z} b`;\n  label: for (const k of [1, , 2]) { if (k) continue label; else x++; }\n  switch (x) { case 1: break; default: x = -x; }\n  return { a, get b() { return 1 }, [x]: 2, ...y, async *g() {} };\n};\nclass A extends B { static x = 1; #p = 2; constructor() { super(); } async m() { await this.#p; } }\n!function (a) { a.b = 1 }(window)\n",
    "typescript": "import type { A } from './a';\nexport interface R<T> { a?: string; readonly b: number | null; f(x: T): void }\ntype U = | 'a' | 'b';\nfunction g<T extends R<T>>(x: T, y?: Array<string>): x is T { return x!.a as any; }\nexport const h = (a: any[], n = 1): number => a.filter((x) => x.a > n).length;\nenum E { A = 1, B }\nabstract class C implements D { private readonly x: number = 1; constructor(public y: string) { super() } get z(): string { return this.y } }\n",
    "java": "package a.b;\nimport java.util.*;\n\n@Service(\"x\")\npublic class A<T extends B> {\n    static final int[] W = {1, 2};\n    String s = \"<<<<<<< ours\\n\";\n    @Override\n    public Map<String, List<T>> f(final String a, int... b) throws E {\n        for (int i = 0; i < 3; i++) { if (a == null) throw new X(\"a\"); else i--; }\n        Runnable r = () -> { g(); };\n        int y = a > 0 ? (int) b[0] : -1;\n        try (R q = open()) { h(q); } catch (X | Y e) { } finally { }\n        switch (y) { case 1: break; default: y++; }\n        return new HashMap<>();\n    }\n    enum E { A, B }\n}\n",
    "json": '{"a": [1, 2.5e3, null, "x"]}',
}
BAD = {
    "go": ["", "func f() {}\n", "package a\n\nfunc f() {\n", "package a\n\nfunc f( {\n}\n", "package a\n<<<<<<< HEAD\n", "package a\n\nfunc f() {\n\tx := \"abc\n}\n", "package a\n\nfunc\n", "package a\n\nfunc f() {\n{{ x }} = {% raw %}\n}\n", "package a\n}\n", "package a;\nimport x.y;\n", "# Title\n\ntext here\n", "package a\n\nvar x =\n"],
    "python": ["def f(:\n", "def f()\n    pass\n", "x = '''a\n", "if x:\n", "<<<<<<< HEAD\nx = 1\n"],
    "javascript": ["function f( {}\n", "export const\n", "const a\n", "let x = ;\n", "f(a b)\n", "const s = 'abc\n", "const t = `abc\n", "try { a() }\n", "import { a } from\n", "interface A { b: string }\n", "function f(a: string) {}\n", "=======\n", "if (x\n", "/* open\n", "def f(a):\n    return 1\n", "{{ a }} = {% raw %}\n"],
    "typescript": ["function f(a: number {\n}\n", "interface A {\n", "const x: number\n\"\n", "export class\n", "package a\n"],
    "java": ["public class A {\n", "public class A { void f() { int x = 1 } }\n", "import a.b\n", "class A { String s = \"a; }\n", "package a\n\nimport (\n\"x\"\n)\n", "public class\n"],
    "json": ["", "{a: 1}", "[1,]", "{\"a\": NaN}", "// c\n{}", "{} {}"],
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_sound_and_broken_files(lang):
    assert lexers.check(GOOD[lang], lang) is None
    assert lexers.check(GOOD[lang].replace("\n", "\r\n"), lang) is None
    for bad in BAD[lang]:
        assert lexers.check(bad, lang) is not None, bad


@pytest.mark.parametrize("lang", ["go", "javascript", "typescript", "java"])
def test_cut_inside_a_body_is_found(lang):
    text = GOOD[lang]
    start = text.index("{", len(text) // 2) + 1
    assert lexers.check(text[:start], lang) is not None


def test_faults_and_rates(spark):
    rows = [(1, "r", "a.go", "go", "package a\n", "s", "x"), (2, "r", "b.py", "PYTHON", "def f(:\n", "s", "x"), (3, "r", None, "json", "{", "s", "x"), (4, "r", "c.md", "markdown", "#", "s", "x"), (5, "r", "d.py", None, None, "s", "x"), (6, None, "E.PY", None, "", "s", "x")]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, language string, content string, snapshot_id string, fault string")
    checked = syntax.faults(files, keep=["repo", "snapshot_id"])
    assert {r.file_id: r.fault is not None for r in checked.collect()} == {1: False, 2: True, 3: True, 6: False}
    cover = {r.repo: r for r in syntax.coverage(checked, ["repo"]).collect()}
    assert cover["r"].failures_by_language == {"python": 1, "json": 1} and cover["r"].files_scanned == 3 and cover[None].failures_by_language == {}
    assert syntax.faults(files.limit(0)).count() == 0


# --- documented functions
PAIRS = {
    "go": ("package a\n\n// Fold walks the tree and stops early.\nfunc Fold(a int) int {\n\treturn 1\n}\n\n// far away comment with many words\n\nfunc A() {}\n\n//go:noinline\nfunc B() {}\n\n// TODO later we do it properly\nfunc C() {}\n\n/*\nD reads all of it again.\n//nolint\n*/\nfunc (t *T) D() {}\n\nconst s = `\n// Fake walks the tree and stops.\nfunc Fake() {}\n`\n", [("Fold", 4), ("D", 22)]),
    "python": ('def a(x):\n    """Reads every block of input."""\n    def b():\n        \'\'\'Inner one has words too.\'\'\'\n\nclass C:\n    @cached\n    async def c(self,\n                y) -> dict:\n        """C function."""\n\n    def d(self):\n        """\n        Args:\n            x: some words go here\n        """\n\ns = """\ndef fake():\n    \'\'\'Not a real one at all.\'\'\'\n"""\n', [("a", 1), ("b", 3)]),
    "javascript": ("/**\n * Keeps only newest entry per key.\n * @param a b\n */\nexport const foldAll = async (a) => {\n  /** Inner doc with enough words here. */\n  function inner() {}\n};\n\n/* not a doc comment for this */\nfunction no() {}\n\nclass A {\n  /**\n   * Reads one block at once.\n   */\n  static async read(a, b = {}) {\n    if (a) { return 1 }\n  }\n  /** Fold all. */\n  foldAll() {}\n}\n", [("foldAll", 5), ("inner", 7), ("read", 17)]),
    "typescript": ("/** Sorts all of the rows quickly. */\nfunction t(): void {}\n/**\n * Sorts all of the rows.\n */\nexport function u<T>(a: any[], b: { c: number }): Promise<T> {\n}\n/**\n * Sorts all of them again.\n */\nconst v = (a: any[]): number => {\n};\n", [("t", 2), ("u", 6), ("v", 11)]),
    "java": ("package a;\n\npublic class A {\n    /**\n     * Waits until all inputs end.\n     * @return x\n     */\n    @Override\n    @SuppressWarnings(\"unchecked\")\n    protected static <T> List<T> wait(String a, int b) throws E {\n        run(a);\n        return x;\n    }\n    /** Builds a new empty one. */\n    public A(int x) {}\n    //noinspection unchecked\n    int none() { return 1; }\n}\n", [("wait", 10), ("A", 15)]),
}


@pytest.mark.parametrize("lang", sorted(PAIRS))
def test_documented_functions(lang):
    text, want = PAIRS[lang]
    assert lexers.check(text, lang) is None
    for t in (text, text.replace("\n", "\r\n")):
        assert [(n, l) for n, l, _, d, _ in docpairs.captures(t, lang) if not docpairs.trivial(d, n)] == want


def test_documented_frame(spark):
    rows = [(1, "a.py", "python", PAIRS["python"][0], "x"), (2, "b.py", "python", "def f(:\n", "x"), (3, None, None, None, "x"), (4, "c.go", None, "", "x")]
    files = spark.createDataFrame(rows, "file_id long, path string, language string, content string, name string")
    got = docpairs.documented(files).collect()
    assert {(r.file_id, r.name, r.start_line) for r in got} == {(1, "a", 1), (1, "b", 3)}
    assert got[0].code.startswith("def a(x):") and got[0].doc == "Reads every block of input."


# --- provenance
def test_evidence_and_mentions():
    d = lambda p, c, l=None: provenance.describe([(p, l, c, None)])[0][1]
    code = "package a\n\nfunc f() int {\n\treturn 1\n}\n"
    assert d("a.go", code) is None and d("a.go", "") is None and d(None, None) is None
    assert d("a.go", "// Code generated by x. DO NOT EDIT.\n" + code) == "generated notice"
    assert d("a.go", code + "\n// @generated\n") == "generated notice"
    assert d("a.go", code + "\n// the rows are generated by the caller, not here\n// do not edit the list above without telling us\n") is None
    assert d("a.go", 'package a\n\nconst s = "// Code generated by x. DO NOT EDIT."\n') is None
    assert d("vendor/x/a.go", code) == "vendored place" and d("internal/vendors/a.go", code) is None
    assert d("a_pb2.py", "x = 1\n") == "generated place" and d("internal/generate/a.go", code) is None
    assert d("a.js", "function f(){}\n// Copied from abc v1.2.3, keep in step with upstream.\n") == "vendored notice"


def test_classify_with_hints(spark):
    code = "package a\n\nfunc f(x int) int {\n\treturn x + 1\n}\n"
    rows = [(i, f"p/a{i}.go", "go", ("// Code generated by x. DO NOT EDIT.\n" if i % 5 == 0 else "") + code * (1 + i % 3), "e") for i in range(40)] + [(99, None, None, None, "e")]
    files = spark.createDataFrame(rows, "file_id long, path string, language string, content string, evidence string")
    plan = spark.createDataFrame([(1, "clean"), (1, "delete"), (2, None)], "file_id long, status string")
    got = {r.file_id: r for r in provenance.classify(files, plan).collect()}
    assert {k for k, r in got.items() if r.found} == set(range(0, 40, 5)) and len(got) == 41
    assert got[1].plan_hint == 1.0 and got[2].plan_hint == 0.0
    assert provenance.classify(files.limit(0), plan).count() == 0


def _written(rng, name):
    """A file as a person would write it."""
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9)))
    parts = []
    for _ in range(rng.randint(3, 12)):
        f, x, y = word(), word(), word()
        parts.append(f"// {word()} {word()} {word()} by {word()}\nexport function {f}({x}, {y}) {{\n\tconst {word()} = {x}.{word()} + {rng.randint(1, 900)};\n\tif ({x} > {y}) {{\n\t\treturn {word()}('{word()} {word()}', {x});\n\t}}\n\treturn {y};\n}}\n")
    table = "const t = [\n\t1, 2, 3, 4,\n];\n" if rng.random() < 0.2 else ""
    return f"// {name}\n" + "\n".join(parts) + table


def test_forest_decides_minified_and_data_bodies(spark):
    """No minified or data file carries a notice; the forest learns them from made copies."""
    rng = random.Random(8)
    rows = [(i, f"src/a{i}.js", "javascript", ("// Code generated by x. DO NOT EDIT.\n" if i % 9 == 0 else "") + _written(rng, i)) for i in range(400)]
    dense = lambda n: "".join(f"function a{i}(x,y){{return x.b>{i}?y:x+1}}" for i in range(n))
    numbers = "export const t = [\n" + "".join("\t" + ", ".join(str(rng.randint(0, 99999)) for _ in range(11)) + ",\n" for _ in range(40)) + "];\n"
    base64 = "var s = (\n" + "".join('    "' + "".join(rng.choices("ABCDEFabcdefghiklmnopqrstuvwxyz0123456789+/", k=70)) + '"\n' for _ in range(40)) + ")\n"
    records = "export const t = [\n" + "".join(f'  {{ key: "{rng.randint(0, 9**9):x}", v: {rng.random():.5f}, n: {rng.randint(0, 9999)} }},\n' for _ in range(60)) + "];\n"
    odd = {1000: dense(40), 1001: dense(90), 1002: numbers, 1003: base64, 1004: records}
    rows += [(i, f"src/b{i}.js", "javascript", c) for i, c in odd.items()] + [(2000, "a.json", "json", "[" + "1234, " * 300 + "1]")]
    got = {r.file_id: r for r in provenance.classify(spark.createDataFrame(rows, "file_id long, path string, language string, content string")).collect()}
    assert {i for i, r in got.items() if r.found and r.evidence is None} == set(odd)
    assert len(got) == len(rows) and not got[2000].found


def test_body_features_by_hand():
    x = provenance.body_features(["ab ab 12;\n", "", "x" * 100 + "y", "x" * 101])
    assert x[0, 9] == 3 / 4 and abs(x[0, 1] - 1.5) < 1e-9 and x[0, 2] == 2.0 and x[0, 3] == 1.0
    assert x[1, 1] == 0 and x[2, 2] == 101 and x[0, 6] == 2 / 11
    both = provenance.body_features([" ".join(["x" * 100 + "y", "x" * 101])])
    assert both[0, 9] == 1.0


# --- confidence
def test_confidence_is_reliable_on_held_out_pieces():
    """The share of right answers follows the confidence in every bin, wrong answers included."""
    rng = random.Random(21)
    samples = [[_text(rng, l, rng.randint(6, 30)).lower() for _ in range(40)] for l in language.LANGUAGES]
    held = [(_text(rng, l, rng.randint(4, 20)).lower(), k) for k, l in enumerate(language.LANGUAGES) for _ in range(30)]
    # one label in twenty is wrong
    model = language.calibrate(language.fit(samples), [(t, k if rng.random() > 0.05 else rng.randrange(7)) for t, k in held])
    tests = [(" ".join(rng.sample(SENTENCES[l].split(), k=rng.choice([1, 1, 2, 3]))), k) for k, l in enumerate(language.LANGUAGES) for _ in range(200)]
    tests = [(t, k) for t, k in tests if len(t) >= language.LEAST_LETTERS]
    best, confidence, _ = model.decide([t for t, _ in tests])
    right = best == np.array([k for _, k in tests])
    for low, high in ((0.0, 0.6), (0.6, 0.9), (0.9, 0.99), (0.99, 1.01)):
        inside = (confidence >= low) & (confidence < high)
        if inside.sum() >= 30:
            assert abs(right[inside].mean() - confidence[inside].mean()) < 0.2
    assert 0 < model.temper <= 8 and 1 / 7 <= model.least <= 1


def test_training_takes_whole_documents_and_any_order(spark):
    rng = random.Random(5)
    rows = [(i % 50, " ".join(_text(rng, l) for _ in range(4)), l) for l in language.LANGUAGES for i in range(80)]
    models = []
    for order in (rows, rng.sample(rows, len(rows))):
        models.append(language.train(spark.createDataFrame(order, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 20))
    a, b = models
    assert a.temper == b.temper and all((x == y).all() for x, y in zip(a.logs, b.logs))


# --- JSON by its stack
def test_json_stack_agrees_with_the_parser():
    import json

    rng = random.Random(17)
    parts = ["{", "}", "[", "]", ",", ":", '"a"', '"\\n"', '"\\x"', '"', "1", "-0.5e3", "01", "true", "nul", " ", "\n", "NaN", "{}", "[1]", '{"k": 2}', "<<<<<<< a"]
    seen = [0, 0]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 7)))
        try:
            json.loads(text, parse_constant=lexers._refuse)
            sound = True
        except ValueError:
            sound = False
        seen[sound] += 1
        assert (lexers._json_stack(text) is None) == sound, text
    assert min(seen) > 150
    assert lexers._json_stack("[" * 50_000 + "]" * 50_000) is None


def test_a_stored_model_answers_alike(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(_text(rng, l) for _ in range(3)), l) for l in language.LANGUAGES for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, "doc_id", "text", "lang", 20)
    language.store(model, spark, str(tmp_path / "model"))
    again = language.restore(spark, str(tmp_path / "model"))
    a, b = (sorted(map(tuple, language.label_documents(docs, "doc_id", "text", "lang", m).collect()), key=str) for m in (model, again))
    assert a == b and len(a) >= len(rows)
