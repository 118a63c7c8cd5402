"""Term, token and excerpt functions on text columns; all built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no search terms.
STOPWORDS = ["the", "and", "for", "with", "into", "that", "this", "from", "add", "fix"]
SPACE = " \t\r\n\f\u000b"


def trimmed(column: Column) -> Column:
    """Text without outer white space."""
    return F.btrim(column, F.lit(SPACE))


def bytes_of(column: Column) -> Column:
    """UTF-8 length."""
    return F.octet_length(column).cast("long")


def token_estimate(column: Column) -> Column:
    """Tokens of a text at four bytes each, rounded up."""
    return F.floor((bytes_of(column) + 3) / 4).cast("long")


def bm25_tokens(column: Column) -> Column:
    """Runs of ASCII letters, digits and underscores of the lower-case text."""
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9_]+"), F.lit(0))


def split_identifier(token: Column) -> Column:
    """Lower-case identifier, followed by its parts where it has at least two.

    An underscore divides; else a change from lower case or digit to upper
    case does, and the last capital of a run before a lower-case letter.
    """
    lower = F.lower(token)
    camel = F.regexp_replace(token, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    parts = F.filter(F.split(F.lower(F.when(token.contains("_"), token).otherwise(camel)), "_"), lambda p: p != "")
    return F.when(F.size(parts) < 2, F.array(lower)).otherwise(F.concat(F.array(lower), parts))


def path_terms(path: Column) -> Column:
    """Terms of all path segments, without their extensions."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
    stems = F.transform(F.filter(F.split(clean, "/"), lambda s: ~s.isin("", ".", "..")), lambda s: F.regexp_replace(s, r"\.[^.]*$", ""))
    return F.flatten(F.transform(F.filter(stems, lambda s: s != ""), split_identifier))


def expand_terms(column: Column, least: int = 3) -> Column:
    """Distinct lower-case terms of free text in order of appearance, each with its identifier parts."""
    fields = F.regexp_extract_all(column, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    every = F.flatten(F.transform(fields, split_identifier))
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    return F.array_distinct(F.filter(every, lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t)))


def match_part(parts: Column, term: Column, exact: Column, half: Column) -> Column:
    """``exact`` where a part equals the term but for underscores, ``half`` where one is a prefix of the other (3 bytes at least), else 0."""
    bare = F.replace(term, F.lit("_"), F.lit(""))
    same = F.exists(parts, lambda p: (p == term) | (F.replace(p, F.lit("_"), F.lit("")) == bare))
    near = F.exists(parts, lambda p: (F.least(F.octet_length(p), F.octet_length(term)) >= 3) & (F.startswith(p, term) | F.startswith(term, p)))
    return F.when(same, exact).when(near, half).otherwise(F.lit(0))


def excerpt(column: Column, limit: int = 160) -> Column:
    """White space collapsed, cut to a number of characters with dots."""
    flat = trimmed(F.regexp_replace(column, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def kebab(column: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.lower(F.regexp_replace(F.regexp_replace(column, r"([a-z0-9])([A-Z])", "$1-$2"), r"[^A-Za-z0-9]+", "-"))


def round2(column: Column) -> Column:
    """Two digits, half away from zero."""
    return F.round(column, 2)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def shell_quoted(column: Column) -> Column:
    """Text as one word of a POSIX shell: bare where it is safe, else in single quotes."""
    quote = F.lit("'")
    inner = F.replace(column, quote, F.lit("'\\''"))
    return F.when(column.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), column).otherwise(F.concat(quote, inner, quote))
