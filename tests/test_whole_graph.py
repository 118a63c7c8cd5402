"""The trade graph queries cover every order, against brute force on the smallest tables."""

import os
from collections import defaultdict

import pytest

from marlstone.plans import code_graph

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def trades(spark):
    orders = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect():
        orders[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_suppkey))
    return [(a[2], b[2]) for lines in orders.values() for a, b in zip(sorted(lines), sorted(lines)[1:])]


def _steps(edges, start):
    nxt = defaultdict(set)
    for a, b in edges:
        nxt[a].add(b)
    seen, front = {start: 0}, [start]
    while front:
        front = [b for b in {b for a in front for b in nxt[a]} if b not in seen and not seen.update({b: seen[front[0]] + 1})]
    return seen


def test_importers_and_reach_of_every_order(spark, trades):
    sources = defaultdict(set)
    for a, b in trades:
        sources[b].add(a)
    want = {b: (len(s), len(s) * 10 if len(s) <= 8 else 72 + len(s)) for b, s in sources.items()}
    assert {r.node: (r.importers, r.score) for r in code_graph.importer_scores(spark, SF).collect()} == want
    assert {r.node: r.steps for r in code_graph.reach(spark, SF).collect()} == _steps(set(trades), min(a for a, _ in trades))


def test_components_and_cycles_of_every_order(spark, trades):
    pairs = set(trades)
    to = {n: set(_steps(pairs, n)) for n in {x for p in pairs for x in p}}
    want = {n: min(m for m in to[n] if n in to[m]) for n in to}
    assert {r.node: r.component for r in code_graph.strong_components(spark, SF).collect()} == want
    size = defaultdict(int)
    for c in want.values():
        size[c] += 1
    cyclic = {c: n for c, n in size.items() if n > 1 or (c, c) in pairs}
    assert {r.component: r.nodes for r in code_graph.graph_cycles(spark, SF).collect()} == cyclic


def test_pagerank_weighs_every_order(spark, trades):
    count = defaultdict(int)
    for a, b in trades:
        if a != b:
            count[a, b] += 1
    got = {(r.src, r.dst): r.weight for r in code_graph._weighted(spark, SF).collect()}
    assert got == pytest.approx({p: n**0.5 for p, n in count.items()})
    assert {r.node for r in code_graph.pagerank_bonus(spark, SF).collect()} == {b for _, b in count}
