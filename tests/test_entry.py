"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def _core():
    from marlstone.plans import registry

    return registry


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(_core().oracles()) & set(_core().queries())))
def test_query_matches_sql(spark, con, name):
    df = _core().queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = con.execute(_core().oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_llm_is_not_imported_by_the_rest():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "marlstone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "marlstone.llm" not in p.read_text()
