"""Collects the queries of all plan modules."""

from __future__ import annotations

from marlstone.plans import code_graph, data_quality, files, reports, retrieval, samples, scans, structure

MODULES = [data_quality, files, scans, code_graph, retrieval, reports, structure, samples]
FLAGSHIP = "bm25_topk"


def queries() -> dict:
    """Query name to callable(spark, sf_dir)."""
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict:
    """Query name to SQL."""
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
