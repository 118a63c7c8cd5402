"""Functions and methods paired with their documentation.

Recursive patterns capture comment, signature and balanced body together;
string literals and comments are matched as wholes first, so code inside them
is never seen. A capture is dropped where its documentation is trivial: it
starts with TODO, FIXME or XXX, or has fewer than ``LEAST_WORDS`` words besides
comment marks, tag lines, ``Args:`` sections, tool directives and the words of
the function's own name. Python captures are then checked against the
interpreter's own parser.

Files that do not parse give nothing. Defined cases: NULL and empty contents
give nothing; a language without patterns gives nothing; several functions of
one name come out each; repeated rows are captured each; very long texts are
read whole; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.lexers import check, language_of
from marlstone.session import ship_package

LEAST_WORDS = 4

_C_PARTS = r"""(?(DEFINE)
 (?<str>"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+'|`(?:[^`\\]++|\\[\s\S])*+`)
 (?<com>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)
 (?<paren>\((?:[^()"'`/]++|(?&str)|(?&com)|/|(?&paren))*+\))
 (?<body>\{(?:[^{}"'`/]++|(?&str)|(?&com)|(?&re)|/|(?&body))*+\})
 (?<re>(?<=[(,=:\[!&|?{};]\s?)/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/)
)"""
_GO_PARTS = r"""(?(DEFINE)
 (?<str>"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+'|`[^`]*+`)
 (?<com>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)
 (?<paren>\((?:[^()"'`/]++|(?&str)|(?&com)|/|(?&paren))*+\))
 (?<square>\[(?:[^\[\]"'`/]++|(?&str)|(?&square))*+\])
 (?<body>\{(?:[^{}"'`/]++|(?&str)|(?&com)|/|(?&body))*+\})
)"""
_JAVA_PARTS = r'''(?(DEFINE)
 (?<str>"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+')
 (?<com>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)
 (?<paren>\((?:[^()"'/]++|(?&str)|(?&com)|/|(?&paren))*+\))
 (?<angle><(?:[^<>;{}()]++|(?&angle))*+>)
 (?<body>\{(?:[^{}"'/]++|(?&str)|(?&com)|/|(?&body))*+\})
 (?<note>@[\w.]++(?:[ \t]*+(?&paren))?+)
)'''
_JSDOC = r"(?:(?<doc>/\*\*(?!/)(?:[^*]++|\*(?!/))*+\*/)[ \t]*+\n(?:[ \t]*+@[\w.]++(?&paren)?+[ \t]*+\n)*+)?+"
_WORD = r"[\p{L}_$][\w$]*+"
_ARROW_TYPE = r"(?:\s*+:\s*+[^{}=;\n]++(?:\{[^{}]*+\}[\[\]]*+)?+)?+"
_JS_TYPE = r"(?:\s*+:\s*+(?:[^{=;\n]|=>)++(?:\{[^{}]*+\}[\[\]]*+(?=\s*+\{))?+)?+"

_SCRIPT = regex.compile(
    _C_PARTS
    + rf"""(?:^[ \t]*+{_JSDOC}[ \t]*+(?:@[\w.]++(?&paren)?+[ \t]++)*+(?<head>
   (?:export\s++(?:default\s++)?)?(?:declare\s++)?(?:async\s++)?function\b\s*+\*?\s*+(?<name>{_WORD})\s*+(?:<[^()]*>)?+\s*+(?&paren){_JS_TYPE}
  |(?:export\s++(?:default\s++)?)?(?:const|let|var)\s++(?<name>{_WORD})\s*+(?::(?:[^=\n]|=>)++)?+=\s*+(?:async\b\s*+)?(?:function\b\s*+\*?\s*+(?:{_WORD})?+\s*+(?&paren){_JS_TYPE}|(?:<[^()]*>)?+(?&paren){_ARROW_TYPE}\s*+=>|{_WORD}\s*+=>)
  |(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s++)*+\*?\s*+(?<name>(?!(?:if|for|while|switch|catch|with|return|function|new|do|else|typeof|await|super|this)\b)\#?{_WORD})\s*+\??(?:<[^()]*>)?+\s*+(?&paren){_JS_TYPE}(?=\s*+\{{)
 )\s*+(?<code>(?&body))?+)|(?<skip>(?&com)|(?&str)|(?&re))""",
    regex.M | regex.X | regex.V1,
)
_GO = regex.compile(
    _GO_PARTS
    + rf"""(?:(?:^(?<doc>(?:[ \t]*+//[^\n]*+\n|[ \t]*+/\*(?:[^*]++|\*(?!/))*+\*/[ \t]*+\n)++))?+^(?<head>func\b\s*+(?:(?&paren)\s*+)?+(?<name>{_WORD})\s*+(?&square)?+\s*+(?&paren)[^\n{{"`']*+)(?<code>(?&body))?+)|(?<skip>(?&com)|(?&str))""",
    regex.M | regex.X | regex.V1,
)
_JAVA = regex.compile(
    _JAVA_PARTS
    + rf"""(?:^[ \t]*+(?:(?<doc>/\*\*(?!/)(?:[^*]++|\*(?!/))*+\*/)[ \t]*+\n)?+(?:\s*+(?&note)(?=\s))*+\s*+(?<head>
   (?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s++)*+
   (?:(?&angle)\s*+)?+(?!(?:return|new|throw|else|case|assert|yield|package|import|goto|class|interface|enum|record|extends|implements|instanceof|if|for|while|switch|try|do|catch|finally)\b)
   (?:[\p{{L}}_$][\w$.]*+(?:\s*+(?&angle))?+(?:\.[\w$]++)?+(?:\s*+\[\s*+\])*+\s++|(?&angle)\s*+)?(?<name>(?!(?:if|for|while|switch|catch|synchronized|return|new|super|this|throw|else|try)\b){_WORD})\s*+(?&paren)(?:\s*+throws\s++[\w$.,\s]++)?+)\s*+(?:(?<code>(?&body))|;))|(?<skip>(?&com)|(?&str))""",
    regex.M | regex.X | regex.V1,
)
_PYTHON = regex.compile(
    r'''(?(DEFINE)
 (?<str>[A-Za-z]{0,2}(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^'\\]|\\[\s\S]|'(?!''))*+\'\'\'|"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+'))
 (?<com>\#[^\n]*+)
 (?<paren>\((?:[^()"'\#]++|(?&str)|(?&com)|(?&paren))*+\))
 (?<square>\[(?:[^\[\]"'\#]++|(?&str)|(?&com)|(?&square))*+\])
)(?:^(?<indent>[ \t]*+)(?<head>(?:async[ \t]++)?def[ \t]++(?<name>\w++)[ \t]*+(?&square)?+[ \t]*+(?&paren)(?:[ \t]*+->(?:[^:\n\['"]|(?&square)|(?&str))++)?+[ \t]*+:)
 (?:[ \t]*+(?&com)?+\n)*+[ \t]*+(?<doc>(?&str)(?=[ \t]*+(?:;|\#|\n|\Z)))?+(?<code>[^\n]*+(?:\n(?:[ \t]*+(?=\n|\Z)|(?P=indent)[ \t]++[^\n]*+))*+))|(?<skip>(?&com)|(?&str))''',
    regex.M | regex.X | regex.V1,
)
_COMMENT = r"(?P<com>//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)"
_QUOTED = r"""\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:[^'\\\n]++|\\[\s\S])*+'"""
_TRIPLE = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
#: Comments and literals, one behind the other: a linear scan finds where a declaration can stand.
_LITERALS = {
    "go": re.compile(rf"{_COMMENT}|{_QUOTED}|`[^`]*+`"),
    "java": re.compile(rf"{_COMMENT}|{_TRIPLE}|{_QUOTED}"),
    "javascript": re.compile(rf"{_COMMENT}|{_QUOTED}|`(?:[^`\\]++|\\[\s\S])*+`|(?:(?<=[(,=:\[!&|?{{}};])|(?<=[(,=:\[!&|?{{}};]\s))/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/"),
    "python": re.compile(rf"(?P<com>\#[^\n]*+)|{_TRIPLE}|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|{_QUOTED}"),
}
_LITERALS["typescript"] = _LITERALS["javascript"]
_HEADS = {"go": re.compile(r"^func\b", re.M), "python": re.compile(r"^[ \t]*+(?:async[ \t]++)?+def[ \t]", re.M)}
PATTERNS = {"javascript": _SCRIPT, "typescript": _SCRIPT, "go": _GO, "java": _JAVA, "python": _PYTHON}

_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_NAME_PART = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{Lu}+")
_MARKS = regex.compile(r"^[ \t]*(?://+!?|/\*+|\*+/|\*(?!/))?[ \t]?")
_ARGS = regex.compile(r"^([ \t]*)Args:[ \t]*$")
_STARTS = regex.compile(r"\s*(?:TODO|FIXME|XXX)")


def description(doc: str, language: str) -> str:
    """Text of a documentation comment without its marks, tag lines, ``Args:`` sections and tool directives."""
    lines = doc.split("\n")
    out: list[str] = []
    if language != "python":
        plain = []
        for line in lines:
            stripped = line.strip()
            if stripped.startswith(("//go:", "//nolint", "// nolint", "//lint:", "//line ", "//export ", "// +build")):
                continue
            text = _MARKS.sub("", line, count=1)
            plain.append(regex.sub(r"[ \t]*\*+/[ \t]*$", "", text))
        lines = plain
    section: int | None = None
    for line in lines:
        if section is not None:
            if not line.strip() or len(line) - len(line.lstrip()) > section:
                continue
            section = None
        if m := _ARGS.match(line):
            section = len(m.group(1))
            continue
        if line.lstrip().startswith("@"):
            continue
        out.append(line.strip())
    return "\n".join(out).strip()


def trivial(text: str, name: str, least: int = LEAST_WORDS) -> bool:
    """The text says no more than the name does."""
    if _STARTS.match(text):
        return True
    own = {p.lower() for p in _NAME_PART.findall(name)} | {w.lower() for w in _LETTERS.findall(name)}
    return sum(w.lower() not in own for w in _LETTERS.findall(text)) < least


def _places(text: str, language: str) -> Iterator[int]:
    """Line starts where a documented declaration can begin: at a ``/**`` comment, at the comments above a func, at a def."""
    heads = _HEADS.get(language)
    inside: list[tuple[int, int]] = []
    comments: dict[int, int] = {}
    for m in _LITERALS[language].finditer(text):
        if heads is None:
            if m.lastgroup == "com" and text.startswith("/**", m.start()):
                line = text.rfind("\n", 0, m.start()) + 1
                if not text[line : m.start()].strip(" \t"):
                    yield line
        else:
            inside.append(m.span())
            if m.lastgroup == "com":
                comments[m.end()] = m.start()
    if heads is None:
        return
    k = 0
    for m in heads.finditer(text):
        while k < len(inside) and inside[k][1] <= m.start():
            k += 1
        if k < len(inside) and inside[k][0] < m.start():
            continue
        top = m.start()
        if language == "go":
            while top:
                end = top - 1
                while end not in comments and end and text[end - 1] in " \t":
                    end -= 1
                if end not in comments:
                    break
                line = text.rfind("\n", 0, comments[end]) + 1
                if text[line : comments[end]].strip(" \t"):
                    break
                top = line
            if top == m.start():
                continue
        yield top


def _functions(tree: ast.AST) -> Iterator[ast.AST]:
    """Function nodes of a tree; they stand in lists of statements only."""
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield node
        for part in ("body", "orelse", "finalbody", "handlers", "cases"):
            if isinstance(below := getattr(node, part, None), list):
                stack += below


def captures(text: str, language: str, tree: ast.AST | None = None) -> Iterator[tuple[str, int, str, str, str]]:
    """(name, line, signature, description, code) of each function that carries a comment at its place, trivial or not.

    The recursive pattern is tried only where a linear scan of comments and literals leaves room for a documented declaration.
    """
    pattern = PATTERNS.get(language)
    if pattern is None:
        return
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    nodes = {n.lineno: n for n in _functions(tree)} if tree is not None else None
    line, counted = 1, 0
    for place in _places(text, language):
        m = pattern.match(text, place)
        if m is None or m.group("name") is None or not m.group("doc"):
            continue
        line += text.count("\n", counted, m.start("name"))
        counted = m.start("name")
        doc, code = m.group("doc"), text[m.start("head") : m.end()]
        if language == "python":
            body = doc.lstrip("rRuU")
            quote = 3 if body[:3] in ('"""', "'''") else 1
            said: str | None = body[quote:-quote] if body[:1] in "\"'" else None
            if nodes is not None:
                node = nodes.get(line)
                said = ast.get_docstring(node, clean=True) if node is not None and node.name == m.group("name") else None
        else:
            said = doc
        if said is not None:
            yield m.group("name"), line, m.group("head").strip(), description(said, language), code


def pairs(text: str, language: str, least: int = LEAST_WORDS) -> list[tuple[str, int, str, str, str]]:
    """Captures of a file that are really documented; none of a file that doesn't parse.

    Python is parsed once, for its docstrings too; the lexers of the other languages run where there is a capture to confirm.
    """
    tree = None
    if language == "python":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError):
                return []
            except (RecursionError, MemoryError):
                pass
    found = [c for c in captures(text, language, tree) if not trivial(c[3], c[0], least)]
    return found if found and (tree is not None or check(text, language) is None) else []


def documented(files: DataFrame, file_id: str = "file_id", path: str = "path", language: str = "language", content: str = "content", least: int = LEAST_WORDS) -> DataFrame:
    """(file_id, language, name, start_line, signature, doc, code) of every function that is really documented, of files that parse."""
    ship_package(files.sparkSession)
    kind = dict(files.dtypes)[file_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, p, l, text in zip(batch["file_id"].tolist(), batch["_path"], batch["_language"], batch["_content"]):
                lang = language_of(p, l)
                if not text or lang not in PATTERNS:
                    continue
                rows += [(f, lang, *pair) for pair in pairs(text, lang, least)]
            yield pd.DataFrame(rows, columns=["file_id", "language", "name", "start_line", "signature", "doc", "code"])

    picked = files.select(F.col(file_id).alias("file_id"), F.col(path).alias("_path"), F.col(language).alias("_language"), F.col(content).alias("_content"))
    return picked.mapInPandas(run, f"file_id {kind}, language string, name string, start_line int, signature string, doc string, code string")
