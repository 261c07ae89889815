"""Blocks of shingle sets and forests against plain loops."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spikeloom.llm import near_dup
from spikeloom.llm.components import components, forest_roots

sets = st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=8)


@given(sets, sets)
@settings(max_examples=80, deadline=None)
def test_block_links_are_exact(a, b):
    left = [{"key": i, "root": i, "shingles": np.array(sorted(x))} for i, x in enumerate(a)]
    right = [{"key": 100 + i, "root": 100 + i, "shingles": np.array(sorted(x))} for i, x in enumerate(b)]
    expected = {(i, 100 + j) for i, x in enumerate(a) for j, y in enumerate(b) if 100 * len(x & y) >= 75 * len(x | y)}
    found = near_dup.links_of_blocks(left, right, 75, columns=7)
    assert found <= expected and groups(found) == groups(expected)


def groups(links):
    out = []
    for a, b in links:
        touched = [g for g in out if a in g or b in g]
        out = [g for g in out if g not in touched] + [{a, b}.union(*touched)]
    return sorted(map(sorted, out))


def test_forest_and_components(spark):
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 20)] + [(31, 30)], "node long, parent long")
    assert {(r.node, r.root) for r in forest_roots(parents).collect()} == {(i, 0) for i in range(1, 20)} | {(31, 30)}
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(31, 30)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(21)} | {(30, 30), (31, 30)}
    assert components(edges.limit(0)).count() == 0
