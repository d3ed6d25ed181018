import random

import pytest

from cairn.operators.components import connected_components


def slow(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("small", [0, 20, 1 << 18])
def test_against_union_find(spark, small):
    rng = random.Random(small)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randrange(1, 60)) for _ in range(80)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)] + [(-5, -9), (300, 300), (300, 300)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3), (7, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, small).collect()}
    assert got == slow(edges)


@pytest.mark.parametrize("small", [0, 100])
def test_no_edges(spark, small):
    assert connected_components(spark.createDataFrame([], "a long, b long"), small).collect() == []
