from __future__ import annotations

import random

import pytest

from stridelake.llm.components import components
from stridelake.llm.shared import Workspace


@pytest.mark.parametrize("pairs", [[], [(5, 1), (5, 2)], [(k, k + 1) for k in range(12)], [(0, k) for k in range(1, 9)] + [(9, 9)], "random"])
def test_components(spark, pairs):
    if pairs == "random":
        rng = random.Random(3)
        pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for u, v in pairs:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.root for r in components(Workspace(spark, "t"), spark.createDataFrame(pairs, "u long, v long"), "c").collect()}
    assert got == {x: find(x) for u, v in pairs if u != v for x in (u, v)}
