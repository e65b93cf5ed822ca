"""Components of links against a plain union of sets."""

import numpy as np
import pytest

from helixquery.llm import components


def brute(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


ORDER = np.random.default_rng(0).permutation(400).tolist()
CASES = {"empty": [], "loop and repeats": [(3, 3), (1, 2), (2, 1)], "path": list(zip(ORDER, ORDER[1:])), "star": [(999, i) for i in range(300)]}


@pytest.mark.parametrize("name", CASES)
def test_star_forest(name):
    a, b = np.array(CASES[name], dtype=np.int64).reshape(-1, 2).T
    root, node = components.star_forest(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == brute(CASES[name])


@pytest.mark.parametrize("name", CASES)
def test_components_equal_brute_force(spark, name):
    df = spark.createDataFrame(CASES[name], "a long, b long").repartition(8)  # no task holds a component whole
    assert {r.node: r.root for r in components.components(df).collect()} == brute(CASES[name])
