import random

import pytest

from sparkwarden.llm.components import components


@pytest.mark.parametrize("seed", range(2))
def test_against_union_find(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(7, None), (9, 9)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: find(x) for x in root}


def test_star_and_nothing(spark):
    star = spark.createDataFrame([(500, i) for i in range(300)], "x long, y long")
    assert {r.component for r in components(star).collect()} == {0}
    assert components(star.limit(0)).count() == 0
