"""Source files that do not parse, per file and as rates per repository and language.

Each file is checked whole by the lexers of its path's language. Defined
cases: a NULL content was not captured, so it is no failure and not scanned; an
empty one is sound but for Go and JSON, which need something; a language
without a lexer is not scanned; very long texts are checked whole; repeated
rows are checked each; empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.lexers import TOKENS, check, language_of
from marlstone.session import ship_package

CHECKED = {*TOKENS, "python", "json"}


def faults(files: DataFrame, file_id: str = "file_id", path: str = "path", language: str = "language", content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """(file_id, checked_language, fault, line) of every file that can be checked; fault is NULL for a sound one."""
    ship_package(files.sparkSession)
    keep = keep or []
    kinds = dict(files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, (p, l, text) in enumerate(zip(batch["_path"], batch["_language"], batch["_content"])):
                lang = language_of(p, l)
                if text is None or lang not in CHECKED:
                    continue
                fault = check(text, lang)
                rows.append((i, lang, *(fault or (None, None))))
            out = pd.DataFrame(rows, columns=["_i", "checked_language", "fault", "line"])
            out["line"] = out["line"].astype("Int64")
            left = batch.drop(columns=["_path", "_language", "_content"]).iloc[out["_i"].astype(int).to_numpy()].reset_index(drop=True)
            yield pd.concat([left, out.drop(columns="_i")], axis=1)

    picked = files.select(F.col(file_id).alias("file_id"), *[F.col(k).alias(k) for k in keep], F.col(path).alias("_path"), F.col(language).alias("_language"), F.col(content).alias("_content"))
    schema = ", ".join([f"file_id {kinds[file_id]}", *[f"`{k}` {kinds[k]}" for k in keep], "checked_language string", "fault string", "line long"])
    return picked.mapInPandas(run, schema)


def rates(checked: DataFrame, by: list[str]) -> DataFrame:
    """Files scanned, failures and their rate per group and language."""
    grouped = checked.groupBy(*by, "checked_language").agg(F.count(F.lit(1)).alias("files_scanned"), F.count("fault").alias("parse_failures"))
    return grouped.withColumn("failure_rate", F.col("parse_failures") / F.col("files_scanned"))


def coverage(checked: DataFrame, by: list[str]) -> DataFrame:
    """Per group: files_scanned, parse_failures and the map failures_by_language (only languages with failures)."""
    return (
        rates(checked, by)
        .groupBy(*by)
        .agg(
            F.sum("files_scanned").alias("files_scanned"),
            F.sum("parse_failures").alias("parse_failures"),
            F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("parse_failures") > 0, F.struct("checked_language", "parse_failures"))))).alias("failures_by_language"),
        )
    )
