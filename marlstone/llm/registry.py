"""Queries of the training-text problems and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import components, docpairs, language, leakage, mixture, provenance, syntax
from marlstone.session import load


def _faults(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    return syntax.faults(load(spark, sf_dir, "source_files"), keep=keep)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a syntax error for the language of their path."""
    return _faults(spark, sf_dir).filter(F.col("fault").isNotNull()).select("file_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse failures per repository and language."""
    return syntax.rates(_faults(spark, sf_dir, ["repo"]), ["repo"])


def p2_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files scanned, parse failures and failures by language of each snapshot."""
    return syntax.coverage(_faults(spark, sf_dir, ["snapshot_id", "repo"]), ["snapshot_id", "repo"])


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.classify(load(spark, sf_dir, "source_files"), load(spark, sf_dir, "clean_plan"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand here."""
    return _classified(spark, sf_dir).filter("found").select("file_id")


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and score of every file."""
    return _classified(spark, sf_dir).select("file_id", "found", "evidence", "score")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods that are really documented."""
    return docpairs.documented(load(spark, sf_dir, "source_files")).select("file_id", "name", "start_line")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of each documented function."""
    return docpairs.documented(load(spark, sf_dir, "source_files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the clone pairs with the name of its group."""
    pairs = load(spark, sf_dir, "clone_pairs")
    groups = components.consolidate(pairs, components.file_key(F.col("first_file_name")), components.file_key(F.col("second_file_name")))
    return groups.select(F.col("name").alias("file_name"), "group_name")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = mixture.sized(load(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixture.mix(docs, load(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected documents with the number of copies to use."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.shares(*_mixed(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_cases"), "case_id", "passage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items found in them."""
    return _leaks(spark, sf_dir).select("doc_id", "case_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans to remove from each affected document."""
    return leakage.removal_spans(_leaks(spark, sf_dir))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.label_documents(load(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a missing or wrong label, and the paragraphs of mixed ones, with their language."""
    return _languages(spark, sf_dir).filter("found").select("doc_id", "seg_no", "lang")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and every paragraph of a mixed one, with language and confidence."""
    return _languages(spark, sf_dir).select("doc_id", "seg_no", "lang", "confidence")


def queries() -> dict:
    """Query name to callable(spark, sf_dir)."""
    return {"p2_found": p2_found, "p2_rates": p2_rates, "p2_snapshots": p2_snapshots, "p3_found": p3_found, "p3_files": p3_files, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_found": p6_found, "p7_found": p7_found, "p7_spans": p7_spans, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_languages": p9_languages}


_NAME = "regexp_replace(replace({c}, '\\', '/'), '^(\\./)+', '')"
ORACLES = {
    "p6_found": f"""WITH RECURSIVE p AS (SELECT {_NAME.format(c="first_file_name")} AS a, {_NAME.format(c="second_file_name")} AS b FROM clone_pairs
  WHERE trim(first_file_name, ' \t\r\n') <> '' AND trim(second_file_name, ' \t\r\n') <> ''),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(x, y) AS (SELECT a, a FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y)
SELECT x AS file_name, min(y) AS group_name FROM r GROUP BY x""",
    "p7_found": r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM documents),
c AS (SELECT case_id, list_transform(regexp_extract_all(passage, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM eval_cases),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
cg AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM c WHERE len(w) >= 12)
SELECT DISTINCT doc_id, case_id FROM dg JOIN cg USING (g)""",
}


def oracles() -> dict:
    """Query name to SQL."""
    return dict(ORACLES)
