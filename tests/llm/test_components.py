"""Connected components against a union-find."""

import random

import pytest

from tessera.llm.components import components


@pytest.mark.parametrize("kind", ["none", "stars", "path", "random"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {
        "none": [(4, 4)],
        "stars": [(9, 1), (8, 1), (7, 2), (7, 2)],
        "path": [(i, i + 1) for i in rng.sample(range(60), 60)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
    }[kind]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    expected = {(x, root(x)) for x in parent if root(x) != x}
    out = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(out) == len(expected) and {tuple(r) for r in out} == expected
