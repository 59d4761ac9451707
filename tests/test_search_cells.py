"""Least-time trees within one cell take one round, and ways over several cells stay right."""

import random

import pytest
from test_search import dijkstra

from geoweft.operators import roads


def network(apart):
    r, n, rows, by = random.Random(apart), 14, [], {}
    for k in range(n * n):
        for to in (k + 1, k - 1, k + n, k - n):
            if 0 <= to < n * n and abs(to % n - k % n) <= 1 and r.random() < 0.8:
                cost = 10 + r.random() * 30
                by.setdefault(k * apart, []).append((to * apart, cost))
                rows.append(("CAR", len(rows), k * apart, to * apart, cost))
    pairs = [(i, r.randrange(n * n) * apart, r.randrange(n * n) * apart, "CAR") for i in range(40)] + [(40, 7 * apart, None, "CAR"), (41, 5 * apart, apart * n * n + 3, "CAR")]
    return rows, by, pairs


@pytest.mark.parametrize("apart", [41, 1300])
def test_rounds_follow_cells(spark, apart):
    """8,036 node numbers lie in one cell, so that one round settles every tree; 254,800 lie in eight."""
    rows, by, pairs = network(apart)
    cost = spark.createDataFrame(rows, "mode string, edge_id long, src long, dst long, cost double")
    od = spark.createDataFrame(pairs, "od_id long, src long, dst long, mode string")
    trees = roads.search(od, cost, max_rounds=1 if apart == 41 else 100)
    want = {i: dijkstra(by, s).get(d) for i, s, d, _ in pairs if d is not None}
    got = {x.od_id: x.g for x in roads.reached(od, trees).collect()}
    assert set(got) == {i for i, g in want.items() if g is not None}
    assert all(abs(g - want[i]) < 1e-6 for i, g in got.items())
    every = {}
    for x in roads.labels(trees).collect():
        every.setdefault(x.src, {})[x.node] = x.g
    for src, found in every.items():  # what a tree holds is right up to its dearest target, also where it ends before the last node
        right = dijkstra(by, src)
        upto = max((right[d] for _, s, d, _ in pairs if s == src and d in right), default=0)
        assert all(abs(g - right[k]) < 1e-6 for k, g in found.items() if g <= upto or src == 7 * apart or apart == 41)
    assert set(every[7 * apart]) == set(dijkstra(by, 7 * apart))
    steps = {}
    for x in roads.paths(od.where("dst is not null"), trees).collect():
        steps.setdefault(x.od_id, []).append((x.back, x.edge_id))
    for i, s, d, _ in pairs:
        if i in got and s != d:
            way = [rows[e] for _, e in sorted(steps[i], reverse=True)]
            assert way[0][2] == s and way[-1][3] == d and all(a[3] == b[2] for a, b in zip(way, way[1:])) and abs(sum(e[4] for e in way) - got[i]) < 1e-6
