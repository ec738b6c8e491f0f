"""Connected components by contraction and in one task."""

from __future__ import annotations

import random

import pytest

from textloom.llm import components as C
from textloom.shipping import ship


@pytest.mark.parametrize("one_task", [0, 5, 1_000_000])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, monkeypatch, one_task, kind):
    ship(spark)
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    rng = random.Random(5)
    order = rng.sample(range(60), 60)
    edges = {"chain": list(zip(order, order[1:], strict=False)), "star": [(7, x) for x in order], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(50)], "none": []}[kind]
    top = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in top:
        for a, b in edges:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    got = {r["node"]: r["label"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == top
