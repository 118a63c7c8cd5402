"""Chains end no sooner than their nodes."""

import pytest

from marlstone.operators import graphs


def test_no_node_of_a_chain_is_dropped_silently(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 10)] + [(10, 9)], "src int, dst int")
    want = {i: min(i, 9) for i in range(1, 11)}
    assert {r.node: r.component for r in graphs.strong_components(e).collect()} == want
    # few rounds although the ids ascend; one component a round would need nine
    assert {r.node: r.component for r in graphs.strong_components(e, 6).collect()} == want
    with pytest.raises(RuntimeError):
        graphs.strong_components(e, 1)
    start = spark.createDataFrame([(1,)], "node int")
    assert {r.node: r.steps for r in graphs.reachable(e, start).collect()} == {i: i - 1 for i in range(1, 11)}
    with pytest.raises(RuntimeError):
        graphs.reachable(e, start, 5)
