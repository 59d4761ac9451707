"""Trees over several cells against Dijkstra's method, plain and goal-directed."""

import heapq
import random

import pytest

from geoweft.operators import roads


def dijkstra(edges, src):
    best, heap = {src: 0.0}, [(0.0, src)]
    while heap:
        g, n = heapq.heappop(heap)
        if g > best[n]:
            continue
        for to, c in edges.get(n, ()):
            if g + c < best.get(to, float("inf")):
                best[to] = g + c
                heapq.heappush(heap, (g + c, to))
    return best


@pytest.mark.parametrize("apart", [1, 41])
def test_trees_equal_dijkstra(spark, apart):
    """Node numbers of one cell, and of eight."""
    r = random.Random(apart)
    n, rows, by = 14, [], {"CAR": {}, "WALK": {}}
    place = {(y * n + x) * apart: (127 + x * 0.001 + r.random() * 1e-4, 37 + y * 0.001 + r.random() * 1e-4) for x in range(n) for y in range(n)}
    for mode, edges in by.items():
        for k in place:
            for to in (k + apart, k - apart, k + n * apart, k - n * apart):
                if to in place and abs(to // apart % n - k // apart % n) <= 1 and r.random() < 0.8:
                    c = 10 + r.random() * 30
                    edges.setdefault(k, []).append((to, c))
                    rows.append((mode, len(rows), k, to, c))
    cost = spark.createDataFrame(rows, "mode string, edge_id long, src long, dst long, cost double")
    pairs = [(i, r.randrange(n * n) * apart, r.randrange(n * n) * apart, r.choice(["CAR", "WALK"])) for i in range(40)] + [(40, 5 * apart, 5 * apart, "CAR"), (41, 7 * apart, None, "CAR"), (42, None, 3, "CAR"), (43, 10**6, 3, "WALK"), (44, 3 * apart, 10**6, "CAR")]
    od = spark.createDataFrame(pairs, "od_id long, src long, dst long, mode string")
    nodes = spark.createDataFrame([(k, *p) for k, p in place.items()], "node_seq long, lon double, lat double")
    vmax = spark.createDataFrame([("CAR", 20.0), ("WALK", 20.0)], "mode string, vmax double")
    trees = {7 * apart: dijkstra(by["CAR"], 7 * apart)}
    want = {i: dijkstra(by[m], s).get(d) for i, s, d, m in pairs if s is not None and d is not None}
    reach = {i for i, g in want.items() if g is not None}
    if apart == 1:
        both = {x.od_id: x for x in roads.compared(od, cost, nodes, vmax).collect()}
        assert set(both) == reach and all(abs(x.cost_a - want[i]) < 1e-6 and abs(x.cost_b - want[i]) < 1e-6 and x.nodes_b <= x.nodes_a for i, x in both.items())
        return
    for name, found in (("plain", roads.search(od, cost)), ("goal", roads.search(od, cost, nodes, vmax))):
        got = {x.od_id: x.g for x in roads.reached(od, found).collect()}
        assert set(got) == reach
        assert all(abs(g - want[i]) < 1e-6 for i, g in got.items())
        steps = {}
        for x in roads.paths(od, found).collect():
            steps.setdefault(x.od_id, []).append((x.back, x.edge_id))
        for i, s, d, m in pairs:
            if i in got and s != d:
                way = [rows[e] for _, e in sorted(steps[i], reverse=True)]
                assert way[0][2] == s and way[-1][3] == d and all(a[3] == b[2] for a, b in zip(way, way[1:])) and all(e[0] == m for e in way)
                assert abs(sum(e[4] for e in way) - got[i]) < 1e-6 and [b for b, _ in sorted(steps[i])] == list(range(len(way)))
        assert 40 not in steps
        every = {x.node: x.g for x in roads.labels(found.where(f"src = {7 * apart} and mode = 'CAR'")).collect()}
        assert set(every) == set(trees[7 * apart]) and all(abs(g - trees[7 * apart][k]) < 1e-6 for k, g in every.items()), name
