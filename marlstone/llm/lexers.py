"""Lexers with a pushdown stack that tell whether a file is syntactically sound.

One pass per file turns the text into tokens and runs a stack of open
delimiters. Faults are: conflict markers, unterminated literals and comments,
characters no token starts with, unbalanced delimiters, ends where more must
follow, and neighbours no grammar of the language allows (two operands side by
side, an operator without operand, a header without its parts). Python and
JSON files are then checked exactly by this interpreter's own parsers.
"""

from __future__ import annotations

import ast
import json
import re
import warnings

#: Languages of path extensions.
EXTENSIONS = {
    "go": "go", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "json": "json",
}

MARKER = re.compile(r"^(?:<{7}|>{7}|\|{7})(?:[ \t].*)?$|^={7}[ \t]*\r?$", re.M)
OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {")", "]", "}"}

_SPACE = r"(?P<ws>[\s﻿]++)?+"
_LINE = r"(?P<lc>//[^\n]*)"
_BLOCK = r"(?P<bc>/\*[\s\S]*?\*/)"
_ID = r"(?P<id>[^\W\d]\w*)"
_STRING = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
_CHAR = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
_NUMBER = r"0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?"

TOKENS = {
    "go": re.compile(rf"{_SPACE}(?:{_LINE}|{_BLOCK}|{_ID}|(?P<str>{_STRING}|`[^`]*`|{_CHAR})|(?P<num>(?:{_NUMBER})i?(?!\w))|(?P<p>&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{{}},;.:~])|(?P<end>\Z))"),
    "java": re.compile(rf'{_SPACE}(?:{_LINE}|{_BLOCK}|(?P<id>(?:[^\W\d]|\$)[\w$]*)|(?P<str>"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{_STRING}|{_CHAR})|(?P<num>(?:{_NUMBER})[lLfFdD]?(?![\w$]))|(?P<p>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^<>=!()\[\]{{}},;.:?@~])|(?P<end>\Z))'),
    "javascript": re.compile(rf"{_SPACE}(?:{_LINE}|{_BLOCK}|(?P<id>#?(?:[^\W\d]|\$)[\w$]*)|(?P<str>{_STRING}|{_CHAR})|(?P<num>(?:{_NUMBER})n?(?![\w$]))|(?P<p>>>>=|\*\*=|&&=|\|\|=|\?\?=|===|!==|<<=|>>=|>>>|\.\.\.|=>|\*\*|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^<>=!()\[\]{{}},;.:?@~`])|(?P<end>\Z))"),
}
TOKENS["typescript"] = TOKENS["javascript"]
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")

KEYWORDS = {
    "go": set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "java": set("abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while".split()),
    "javascript": set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split()),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"]

OPERAND_WORDS = {"this", "super", "null", "true", "false"}
#: Words that may stand before or behind another word although they are no reserved ones.
SOFT = set("async of as from get set static let await yield".split())
SOFT_TS = SOFT | set("type interface namespace module declare abstract readonly public private protected keyof infer is asserts unique override satisfies implements accessor out global".split())
#: Operators that need an operand on the left in every language.
BINARY = set("= == != === !== <= >= && || ?? += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= ** >> >>> << % / := &^ &^= | ? instanceof => . ?. ->".split())
PREFIX = set("+ - ! ~ ++ -- ... * & <- ^ < @".split())
CONTROL = {"if", "while", "for", "switch", "catch", "with", "synchronized"}

Fault = tuple[str, int]


class _Frame:
    __slots__ = ("open", "line", "kind", "ternary", "label", "head")

    def __init__(self, open_: str, line: int, kind: str, head: str):
        self.open, self.line, self.kind, self.head = open_, line, kind, head
        self.ternary = 0
        self.label = False


def tokenize(text: str, language: str) -> tuple[list[tuple], Fault | None]:
    """(kind, text, offset, newline before) of each token but comments, and the first fault of the lexer.

    Kinds: id, kw, num, str, p (punctuation); a template literal is a str, its embedded code is tokenized between ``${`` and ``}``.
    """
    match, words = TOKENS[language].match, KEYWORDS[language]
    script = language in ("javascript", "typescript")
    out: list[tuple] = []
    add = out.append
    at, size, newline = 0, len(text), True
    braces: list[int] = []  # depth of { inside each open template expression
    depth = 0
    if script and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else size
    markers = {m.start() for m in MARKER.finditer(text)}
    while at < size:
        m = match(text, at)
        if m is None:
            at += len(text[at:]) - len(text[at:].lstrip("\ufeff \t\r\n\f\v"))
            if at in markers:
                return out, ("conflict", at)
            if text.startswith("/*", at) or text[at] in "\"'`":
                return out, ("literal", at)
            return out, ("character", at)
        kind, end = m.lastgroup, m.end()
        start = m.end("ws")
        if start > at:
            newline = newline or "\n" in m.group("ws")
        else:
            start = at
        if start in markers:
            return out, ("conflict", start)
        at = end
        if kind == "id":
            t = text[start:end]
            add(("kw" if t in words else "id", t, start, newline))
        elif kind == "p":
            t = text[start:end]
            if t == "{":
                depth += 1
            elif t == "}":
                if braces and depth == braces[-1]:
                    add(("p", "}", start, newline))
                    braces.pop()
                    t = "`"
                else:
                    depth -= 1
            if script:
                if t == "`":
                    opening = text[start] == "`"
                    at = _CHUNK.match(text, start + 1).end()
                    if at >= size:
                        return out, ("literal", start)
                    if text[at] == "`":
                        add(("str" if opening else "tail", "`", start, newline))
                        at += 1
                    else:  # ${
                        add(("head" if opening else "middle", "`", start, newline))
                        add(("p", "${", at, False))
                        braces.append(depth)
                        at += 2
                    newline = False
                    continue
                if t in ("/", "/=") and start + 1 < size and text[start + 1] not in "/*" and (not out or _regex_may_follow(out[-1])):
                    m = _REGEX.match(text, start)
                    if m is None:
                        return out, ("literal", start)
                    add(("str", "/re/", start, newline))
                    at, newline = m.end(), False
                    continue
            add(("p", t, start, newline))
        elif kind == "lc" or kind == "end":
            continue
        elif kind == "bc":
            newline = newline or "\n" in text[start:end]
            continue
        else:
            add((kind, text[start:end] if kind == "num" else "str", start, newline))
        newline = False
    if braces:
        return out, ("unbalanced", size)
    return out, None


def _regex_may_follow(last: tuple) -> bool:
    kind, t = last[0], last[1]
    if kind in ("id", "num", "str", "tail"):
        return False
    if kind == "kw":
        return t not in OPERAND_WORDS
    return t not in (")", "]", "}", "++", "--")


def _operand_end(kind: str, t: str) -> bool:
    return kind in ("id", "num", "str", "tail") or t in (")", "]", "}") or t in OPERAND_WORDS


def structure(tokens: list[tuple], language: str, size: int) -> Fault | None:
    """First structural fault of the tokens."""
    script, ts, java, go = language in ("javascript", "typescript"), language == "typescript", language == "java", language == "go"
    soft = SOFT_TS if ts else SOFT
    stack: list[_Frame] = []
    n = len(tokens)
    pk, pt = "", ""  # previous token
    closed: _Frame | None = None  # frame that the previous token closed
    top_label = top_ternary = 0
    statement = True  # the token starts a statement
    for i in range(n):
        kind, t, at, newline = tokens[i]
        frame = stack[-1] if stack else None
        nk, nt = (tokens[i + 1][0], tokens[i + 1][1]) if i + 1 < n else ("end", "")
        member = pt in (".", "?.")
        starts = statement
        statement = False
        # --- what the closed header demands
        if closed is not None and closed.kind == "function" and t != "{" and not (ts and t in (":", ";")) and not (ts and newline):
            return ("header", at)
        if closed is not None and closed.head == "try" and closed.open == "{" and t not in ("catch", "finally"):
            return ("header", at)
        if kind in ("id", "num", "str", "head", "kw"):
            operand = kind != "kw" or t in OPERAND_WORDS or t in ("function", "new", "typeof", "class", "delete", "void", "func", "struct", "map")
            if operand and not member:
                if script:
                    if not newline and pk in ("id", "num", "str", "tail") and not (pk == "id" and pt in soft) and not (kind == "id" and t in soft):
                        return ("neighbours", at)
                    if not newline and (pt == "]" or pt in OPERAND_WORDS) and kind != "kw" and not (kind == "id" and t in soft) and not (ts and closed is not None and closed.open == "["):
                        return ("neighbours", at)
                    if not newline and pt == ")" and closed is not None and closed.kind == "call" and kind != "kw" and not (kind == "id" and t in soft) and not ts:
                        return ("neighbours", at)
                elif pk in ("num", "str") and not (newline and go):
                    return ("neighbours", at)
                elif java and pk == "id" and kind in ("num", "str") and pt not in ("yield", "when"):
                    return ("neighbours", at)
                elif java and pt == ")" and closed is not None and closed.kind == "call" and kind != "kw" and pk != "kw":
                    return ("neighbours", at)
                elif go and pk == "id" and kind == "num" and not newline:
                    return ("neighbours", at)
            # --- headers
            if kind == "kw" and not member and nt != ":" and not (script and nt == "(" and t not in CONTROL and t != "function" and t != "import" and t != "catch"):
                fault = _header(tokens, i, language, starts, frame)
                if fault:
                    return fault
        elif kind == "p":
            if t in ("(", "[", "{", "${"):
                head = ""
                if t == "(":
                    if pk == "kw" and pt in CONTROL and not (i > 1 and tokens[i - 2][1] in (".", "?.")):
                        sort = "control"
                    elif script and (pt == "function" or (pk == "id" and i > 1 and tokens[i - 2][1] in ("function",)) or (pk == "id" and i > 2 and tokens[i - 2][1] == "*" and tokens[i - 3][1] == "function") or (pt == "*" and i > 1 and tokens[i - 2][1] == "function")):
                        sort = "function"
                    elif java and pk == "id" and i > 1 and _annotated(tokens, i - 1):
                        sort = "annotation"
                    elif java and pk == "kw" and pt in ("try",):
                        sort = "control"
                    elif pk == "id" or pt in (")", "]"):
                        sort = "call"
                    else:
                        sort = "group"
                elif t == "{":
                    head = pt if pk == "kw" else ("try" if java and pt == ")" and closed is not None and closed.head == "resources" else "")
                    if pt in (")", ";", "{", "}", "=>", "->", "") or pt in ("else", "try", "finally", "do", "static") or starts:
                        sort = "block" if not (java and frame is not None and frame.kind == "list") else "list"
                    elif java and pt in ("=", "]", ",", "("):
                        sort = "list"
                    else:
                        sort = "other"
                    if pt in (";", "{", "}", "") and sort == "block" and starts:
                        sort = "bare"
                else:
                    sort = t
                stack.append(_Frame(t, at, sort, "resources" if java and t == "(" and pt == "try" else head))
                if t == "{" and sort in ("block", "bare", "other"):
                    statement = True
            elif t in CLOSE:
                if frame is None or OPEN.get("{" if frame.open == "${" else frame.open) != t:
                    return ("unbalanced", at)
                if pt in BINARY and not (pt == "?" and (ts or java)) and not (go and pt == ".") and not (java and t == ")" and pt == "->") or (pt in ("+", "-", "~") and not (ts and t == "]")) or (pt == "!" and not ts):
                    return ("operator", at)
                if t == "}" and java and frame.kind in ("block", "bare") and pt not in (";", "{", "}") and not (pt == ")" and closed is not None and closed.kind == "annotation"):
                    return ("end of statement", at)
                if pt == "," and t == ")" and java:
                    return ("operator", at)
                stack.pop()
                pk, pt, closed = kind, t, frame
                if t == "}" and frame.open == "{" and frame.kind in ("block", "bare"):
                    statement = True
                if t == ")" and frame.kind == "control":
                    statement = True
                continue
            elif t == ";":
                if pt in BINARY and pt not in (".",) and not (ts and pt == "?") or pt in ("+", "-", "~"):
                    return ("operator", at)
                statement = True
            elif t == ":":
                if script and not ts:
                    holder = frame
                    ternary = holder.ternary if holder else top_ternary
                    if ternary:
                        if holder:
                            holder.ternary -= 1
                        else:
                            top_ternary -= 1
                    elif (holder.label if holder else top_label) or pt == "default":
                        if holder:
                            holder.label = False
                        else:
                            top_label = 0
                        statement = True
                    elif holder is not None and holder.open == "{" and (holder.kind != "bare" and holder.kind != "block" or pk in ("id", "str", "num", "kw")):
                        pass
                    elif not (holder is None and pk == "id" and (i == 1 or tokens[i - 2][1] in (";", "}"))):
                        return ("operator", at)
                else:
                    statement = True
            elif t in BINARY or t in ("*", "&", "^", "<", ">"):
                unary = t in ("*", "&", "^", "<", ">") or t == "."
                if not _operand_end(pk, pt) and not unary:
                    allowed = (
                        (pk == "kw" and (pt in KEYWORDS[language]) and (member or t in (".", "?.", "=", "=>") or (ts and t in ("?", "|")) or java and t in (".", "?", "->", "=") or script and t == "=" or go and t in ("=", ":=", "==")))
                        or (ts and t in ("|", "?", "=", "&", "=>") and pt in ("=", ":", "(", "<", ",", "|", "=>", ">", "?", "!", "&", "{", "[", "+", "-"))
                        or (java and t in ("?", "=", "->", ".") and pt in ("<", ",", ">", "?"))
                        or (pt in ("++", "--"))
                        or (pt == ">" and (ts or java))
                        or (ts and pt == "!")
                        or (go and t == "=" and pt == ",")
                        or (go and t == "." and pt in (".",))
                        or (go and t == "|" and pt == "~")
                        or (script and t == "/" and False)
                    )
                    if not allowed:
                        return ("operator", at)
                if not unary and pt == "}" and closed is not None and closed.kind == "bare" and closed.open == "{":
                    return ("operator", at)
                if t == "=" and pt == "}" and (go or java):
                    return ("operator", at)
                if t in ("*", "^", ">") and pt in ("", ";", "{", "}") and script and not (frame is not None and frame.open == "{" and t == "*"):
                    return ("operator", at)
                if t == "<" and script and not ts and not _operand_end(pk, pt):
                    return ("operator", at)
                if t == "?" and script and not ts:
                    if frame:
                        frame.ternary += 1
                    else:
                        top_ternary += 1
            elif t == "," and (pt in BINARY and not ((ts or java) and pt == "?") or pt in ("+", "-", "(") and not (ts and pt in ("+", "-")) or pt == "," and not script):
                return ("operator", at)
        elif kind in ("tail", "middle"):
            pass
        if kind == "kw" and t == "case":
            if frame:
                frame.label = True
            else:
                top_label = 1
        pk, pt, closed = kind, t, None
    if stack:
        return ("unbalanced", stack[-1].line)
    if n:
        if pt in BINARY or pt in ("+", "-", "~", "(", ",", "!", "*", "&", "<", "...", "@") and pk == "p":
            return ("end", size)
        if closed is not None and (closed.kind == "function" or closed.kind == "control" or closed.head == "try" and closed.open == "{"):
            return ("end", size)
    return None


def _annotated(tokens: list[tuple], i: int) -> bool:
    """The (dotted) name that ends at i stands behind an @."""
    while i >= 2 and tokens[i - 1][1] == "." and tokens[i - 2][0] == "id":
        i -= 2
    return i >= 1 and tokens[i - 1][1] == "@"


def _header(tokens: list[tuple], i: int, language: str, starts: bool, frame: _Frame | None) -> Fault | None:
    """Fault of the header that the keyword at i begins, as far as its own tokens tell."""
    _, t, at, _ = tokens[i]
    end = ("end", "", at, False)

    def tok(k: int) -> tuple:
        return tokens[i + k] if i + k < len(tokens) else end

    script, ts, java = language in ("javascript", "typescript"), language == "typescript", language == "java"
    one, two = tok(1), tok(2)
    if script:
        if t in ("if", "while", "switch", "with") and one[1] != "(":
            return ("header", at)
        if t == "for" and not (one[1] == "(" or one[1] == "await" and two[1] == "("):
            return ("header", at)
        if t == "catch" and one[1] not in ("(", "{"):
            return ("header", at)
        if t in ("try", "finally") and one[1] != "{":
            return ("header", at)
        if t == "function":
            k = 2 if one[1] == "*" else 1
            if tok(k)[0] in ("id", "kw"):
                k += 1
            if tok(k)[1] != "(" and not (ts and tok(k)[1] == "<"):
                return ("header", at)
        if t == "class" and one[0] in ("id",) and two[1] not in ("{", "extends") and not (ts and two[1] in ("<", "implements")):
            return ("header", at)
        if t == "class" and one[0] not in ("id",) and one[1] not in ("{", "extends"):
            return ("header", at)
        if t in ("const", "var") and not (one[0] == "id" or one[1] in ("[", "{") or (ts and one[1] in ("enum",))) and not (ts and tokens[i - 1][1] in ("as", "<", ",")):
            return ("header", at)
        if t == "const" and one[0] == "id" and not (ts and tokens[i - 1][1] in ("as", "<", ",", "declare")) and two[1] not in ("=", "of", "in") and not (ts and (two[1] == ":" or one[1] == "enum" or tokens[i - 1][1] == "declare")):
            return ("header", at)
        if t == "import" and frame is None:
            if not (one[0] in ("id", "str") or one[1] in ("{", "*", "(", ".")):
                return ("header", at)
            if one[0] == "id" and two[1] not in (",", "from", "=") and not (ts and one[1] == "type"):
                return ("header", at)
            if one[1] == "{":
                k = 2
                while tok(k)[1] not in ("}", "") and tok(k)[0] != "end":
                    k += 1
                if tok(k + 1)[1] != "from" or tok(k + 2)[0] != "str":
                    return ("header", at)
            if one[1] == "*" and not (two[1] == "as" and tok(3)[0] == "id" and tok(4)[1] == "from" and tok(5)[0] == "str"):
                return ("header", at)
            if two[1] == "from" and tok(3)[0] != "str":
                return ("header", at)
        if t == "export" and frame is None and not (one[1] in ("default", "const", "let", "var", "function", "class", "async", "{", "*") or (ts and one[1] in ("type", "interface", "enum", "declare", "abstract", "namespace", "import", "=", "as", "@"))):
            return ("header", at)
        if t in ("enum",) and not ts:
            return ("header", at)
    elif java:
        if t in ("if", "while", "switch", "for", "synchronized", "catch") and one[1] != "(" and not (t == "synchronized" and (one[0] in ("id", "kw"))):
            return ("header", at)
        if t in ("try",) and one[1] not in ("{", "("):
            return ("header", at)
        if t in ("finally", "do") and one[1] != "{" and t == "finally":
            return ("header", at)
        if t == "class" and tokens[i - 1][1] != "." and one[0] != "id":
            return ("header", at)
    else:
        if t == "else" and one[1] not in ("{", "if"):
            return ("header", at)
        if t == "func" and one[0] not in ("id",) and one[1] != "(":
            return ("header", at)
        if t in ("defer", "go") and one[0] not in ("id",) and one[1] not in ("func", "(", "<-", "*", "["):
            return ("header", at)
    return None


def _top_go(tokens: list[tuple], size: int) -> Fault | None:
    """Top level of a Go file: package clause, imports, declarations with their parts."""
    if len(tokens) < 2 or tokens[0][1] != "package" or tokens[1][0] != "id":
        return ("top level", tokens[0][2] if tokens else 0)
    i, n = 2, len(tokens)

    def skip(i: int) -> int:
        """Index behind the balanced group that starts at i."""
        depth = 0
        while i < n:
            t = tokens[i][1] if tokens[i][0] == "p" else ""
            depth += t in OPEN
            depth -= t in CLOSE
            i += 1
            if not depth:
                break
        return i

    def line_end(i: int) -> int:
        """Index of the first token behind the statement: newlines end it after an operand, outside of groups."""
        while i < n:
            kind, t, _, newline = tokens[i]
            if t == ";" and kind == "p":
                return i + 1
            pk, pt = tokens[i - 1][0], tokens[i - 1][1]
            if newline and (pk in ("id", "num", "str") or pt in (")", "]", "}", "++", "--", "return", "break", "continue", "fallthrough")):
                return i
            i = skip(i) if kind == "p" and t in OPEN else i + 1
        return i

    while i < n:
        kind, t, at, newline = tokens[i]
        if t == ";" and kind == "p":
            i += 1
            continue
        if kind != "kw" or t not in ("import", "func", "type", "var", "const") or not (newline or tokens[i - 1][1] == ";"):
            return ("top level", at)
        if i + 1 >= n:
            return ("end", size)
        k = i + 1
        if t == "func":
            if tokens[k][1] == "(":
                k = skip(k)
            if k >= n or tokens[k][0] != "id":
                return ("header", at)
            k += 1
            if k < n and tokens[k][1] == "[":
                k = skip(k)
            if k >= n or tokens[k][1] != "(":
                return ("header", at)
            k = skip(k)
            i = line_end(k)
            continue
        if tokens[k][1] == "(" and tokens[k][0] == "p":
            i = line_end(k)
            continue
        if t == "import":
            k += tokens[k][0] == "id" or tokens[k][1] == "."
            if k >= n or tokens[k][0] != "str":
                return ("header", at)
        elif tokens[k][0] != "id":
            return ("header", at)
        elif (e := line_end(k + 1)) == k + 1:  # a name alone
            return ("header", at)
        i = line_end(k + 1)
    return None


_JAVA_TOP = set("public protected private abstract final static strictfp class interface enum record sealed non".split())


def _top_java(tokens: list[tuple], size: int) -> Fault | None:
    """Top level of a Java file: package, imports, types."""
    i, n = 0, len(tokens)
    while i < n:
        kind, t, at, _ = tokens[i]
        if t == ";":
            i += 1
            continue
        if t in ("package", "import"):
            k = i + 1
            if k < n and tokens[k][1] == "static":
                k += 1
            word = False
            while k < n and tokens[k][1] != ";":
                ok = tokens[k][0] == "id" or (tokens[k][1] == "*" and t == "import") if not word else tokens[k][1] == "."
                if not ok:
                    return ("header", tokens[k][2])
                word = not word
                k += 1
            if k >= n or not word:
                return ("end", size)
            i = k + 1
            continue
        if t not in _JAVA_TOP and t != "@" and not (t in ("module", "open")):
            return ("top level", at)
        named = False
        depth = 0
        k = i
        while k < n:
            u = tokens[k][1] if tokens[k][0] != "str" else ""
            if u in ("class", "interface", "enum", "record", "module") and k + 1 < n and tokens[k + 1][0] == "id" and not depth:
                named = True
            if u == "(":
                depth += 1
            elif u == ")":
                depth -= 1
            elif u == "{" and not depth:
                break
            elif u == ";" and not depth:
                return ("header", tokens[k][2])
            k += 1
        if k >= n:
            return ("end", size)
        if not named:
            return ("header", at)
        depth = 0
        while k < n:
            u = tokens[k][1] if tokens[k][0] == "p" else ""
            depth += u == "{"
            depth -= u == "}"
            k += 1
            if not depth:
                break
        i = k
    return None


_PY = re.compile(
    r"""(?P<c>\#[^\n]*+)|(?P<str>'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''|\"\"\"(?:[^"\\]++|\\[\s\S]|"(?!""))*+\"\"\"|'(?!'')(?:[^'\\\n]++|\\[\s\S])*+'|"(?!"")(?:[^"\\\n]++|\\[\s\S])*+")|(?P<p>[()\[\]{}])|(?P<q>['"])"""
)


def _python_stack(text: str) -> Fault | None:
    """Conflict markers, unterminated strings and unbalanced brackets of Python source."""
    stack: list[tuple[str, int]] = []
    markers = [m.start() for m in MARKER.finditer(text)]
    for m in _PY.finditer(text):
        kind = m.lastgroup
        while markers and markers[0] <= m.start():
            return ("conflict", markers[0])
        if kind == "q":
            return ("literal", m.start())
        if kind == "p":
            t = m.group()
            if t in OPEN:
                stack.append((t, m.start()))
            elif not stack or OPEN[stack.pop()[0]] != t:
                return ("unbalanced", m.start())
        else:  # markers inside of a literal are text
            while markers and markers[0] < m.end():
                del markers[0]
    if markers:
        return ("conflict", markers[0])
    return ("unbalanced", stack[-1][1]) if stack else None


_JSON = re.compile(r"""[ \t\r\n]*+(?:(?P<str>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+")|(?P<num>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+)|(?P<word>true|false|null)|(?P<p>[\[\]{},:])|(?P<end>\Z))""")


def _json_stack(text: str) -> Fault | None:
    """First fault of strict JSON: a lexer, and a stack of open objects and arrays."""
    stack: list[str] = []
    want = "value"  # value, first (a value or the end of an array), key, name (a key or the end of an object), colon, more
    at, size = 0, len(text)
    match = _JSON.match
    while True:
        m = match(text, at)
        if m is None:
            blank = at
            while blank < size and text[blank] in " \t\r\n":
                blank += 1
            return ("conflict" if MARKER.match(text, blank) else "literal" if text[blank] == '"' else "character", blank)
        kind = m.lastgroup
        start, at = m.start(kind), m.end()
        if kind == "end":
            return None if want == "more" and not stack else ("unbalanced" if stack else "end", size)
        t = m.group("p") if kind == "p" else ""
        if want in ("value", "first") and (kind != "p" or t in "[{"):
            if t:
                stack.append(t)
                want = "first" if t == "[" else "name"
            else:
                want = "more"
        elif want in ("key", "name") and kind == "str":
            want = "colon"
        elif want == "colon" and t == ":":
            want = "value"
        elif want == "more" and t == "," and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif t == "]" and stack and stack[-1] == "[" and want in ("first", "more") or t == "}" and stack and stack[-1] == "{" and want in ("name", "more"):
            stack.pop()
            want = "more"
        else:
            return ("unbalanced" if t in ("]", "}") and want == "more" else "grammar", start)


def _refuse(name: str):
    raise ValueError(name)


def check(text: str, language: str) -> Fault | None:
    """First fault (kind, 1-based line) of a file of a language; NULL for a sound one and for an unknown language."""
    fault: Fault | None = None
    if language == "python":
        fault = _python_stack(text)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            fault = None
        except SyntaxError as e:
            if fault is None:
                return ("grammar", e.lineno or 1)
        except ValueError:
            return ("character", 1)
        except (RecursionError, MemoryError):
            pass  # too deeply nested for the exact check: the stack decides
    elif language == "json":
        fault = _json_stack(text)
        try:
            json.loads(text, parse_constant=_refuse)
            fault = None
        except json.JSONDecodeError as e:
            fault = fault or ("grammar", e.pos)
        except ValueError:
            fault = fault or ("grammar", 0)
        except RecursionError:
            pass
    elif language in TOKENS:
        tokens, fault = tokenize(text, language)
        if fault is None:
            fault = structure(tokens, language, len(text))
        if fault is None and language == "go":
            fault = _top_go(tokens, len(text))
        if fault is None and language == "java":
            fault = _top_java(tokens, len(text))
    return None if fault is None else (fault[0], text.count("\n", 0, fault[1]) + 1)


def language_of(path: str | None, language: str | None) -> str:
    """Language of a path's extension; the label, in lower case, where the extension is unknown."""
    name = (path or "").rsplit("/", 1)[-1]
    known = EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
    return known or (language or "").strip().lower()
