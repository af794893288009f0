"""Strongly connected components against reachability."""

from __future__ import annotations

import random

import pytest

from fieldloom.operators import cycles


def plain(edges):
    """{node: (least node of its component, members, on a cycle)} and {(root, node): depth} between components."""
    nodes = sorted({n for e in edges for n in e})
    out = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(start):
        seen, new = set(), {start}
        while new:
            new = {b for a in new for b in out[a]} - seen
            seen |= new
        return seen

    far = {n: reach(n) for n in nodes}
    own = {n: {m for m in far[n] if n in far[m]} | {n} for n in nodes}
    return {n: (min(own[n]), len(own[n]), n in far[n]) for n in nodes}, {(min(own[a]), min(own[b])) for a in nodes for b in far[a] if own[a] != own[b]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_includes(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(a, rng.randrange(n)) for a in range(n) for _ in range(rng.choice([0, 1, 1, 1, 2]))] + [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(200 + k, 201 + k) for k in range(9)] + [(7, 7), (300, 300), (400, 401), (401, 400), (401, 7)]
    df = spark.createDataFrame([*edges, edges[0], (None, 3), (3, None)], "src long, dst long")
    members, between = cycles.condensed(df.filter("src IS NOT NULL AND dst IS NOT NULL"))
    want, pairs = plain(set(edges))
    assert {r.node: (r.component, r.n_members, r.is_cycle) for r in members.collect()} == want
    assert {(r.root, r.node) for r in between.collect()} == pairs
    if seed == 1:
        assert {r.node: r.component for r in cycles.strong_components(df, worth=2.0).collect()} == {k: v[0] for k, v in want.items()}


def test_a_cycle_of_five_thousand_files(spark):
    """With a way in and a way out; rows grow with the files."""
    edges = [(k, (k + 1) % 5000) for k in range(5000)] + [(6000, 17), (4000, 7000), (7000, 7001)]
    members, between = cycles.condensed(spark.createDataFrame(edges, "src long, dst long"))
    rows = members.collect()
    assert len(rows) == 5003 and {(r.component, r.n_members, r.is_cycle) for r in rows if r.node < 5000} == {(0, 5000, True)}
    assert sorted((r.root, r.node, r.depth) for r in between.collect()) == [(0, 7000, 1), (0, 7001, 2), (6000, 0, 1), (6000, 7000, 2), (6000, 7001, 3), (7000, 7001, 1)]


def test_no_includes(spark):
    assert cycles.strong_components(spark.createDataFrame([], "src string, dst string")).count() == 0
