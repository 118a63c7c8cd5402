"""Canonical forms of message and record identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer blanks of an identifier.
BLANKS = " \t\r\n\f\u000b"


def digest_key(column: Column) -> Column:
    """Binary key of a ``sha256:<64 hex>`` identifier; NULL for NULL or blank text.

    Letter case, outer blanks and the ``sha256:`` prefix don't count. A text
    without 64 hex digits keeps its lower-case bytes, so it only equals itself.
    """
    text = F.lower(F.btrim(column, F.lit(BLANKS)))
    bare = F.btrim(F.when(text.startswith("sha256:"), F.substring(text, 8, 1 << 30)).otherwise(text), F.lit(BLANKS))
    return F.when(F.length(text) == 0, F.lit(None)).when(bare.rlike("^[0-9a-f]{64}$"), F.unhex(bare)).otherwise(F.to_binary(text, F.lit("utf-8")))


def instant(column: Column) -> Column:
    """Instant of an RFC 3339 text with any offset and precision; NULL where there is none."""
    return F.try_to_timestamp(F.btrim(column, F.lit(BLANKS)))
