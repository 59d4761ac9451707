"""Least costs by elimination against Dijkstra's method, and searches of closed cells that keep no tree."""

import heapq

import numpy as np
import pytest

from geoweft import tables
from geoweft.operators import elimination, roads
from geoweft.operators.elimination import Network


def dijkstra(n, src, dst, cost, start):
    best, heap = [float("inf")] * n, [(0.0, start)]
    best[start] = 0.0
    while heap:
        g, node = heapq.heappop(heap)
        for a, b, c in zip(src, dst, cost):
            if a == node and g + c < best[b]:
                best[b] = g + c
                heapq.heappush(heap, (best[b], b))
    return best


def network(seed, n=60, m=150):
    rng = np.random.default_rng(seed)
    src, dst = rng.integers(0, n, m), rng.integers(0, n - 8, m)  # loops, repeats, and nodes that nothing leads to
    return n, src, dst, rng.integers(1, 40, m) / 8


@pytest.mark.parametrize("seed", range(4))
def test_equals_dijkstra(seed):
    n, src, dst, cost = network(seed)
    found = Network.of(n, src, dst, cost).costs(np.arange(n))
    assert (found == np.array([dijkstra(n, src.tolist(), dst.tolist(), cost.tolist(), k) for k in range(n)])).all()


def test_too_dense_is_left_alone(monkeypatch):
    monkeypatch.setattr(elimination, "MOST_EDGES", 50)
    assert Network.of(*network(0)) is None
    assert Network.of(3, *(np.zeros(0, np.int64),) * 2, np.zeros(0)).costs(np.array([1])).tolist() == [[np.inf, 0.0, np.inf]]


@pytest.mark.parametrize("few", [1, 1000])
def test_closed_cells_write_no_trees(spark, monkeypatch, few):
    """Two networks in cells of their own; pairs from one to the other, without source, of one node, and twice."""
    monkeypatch.setattr(roads, "FEW", few)
    cell, (n, src, dst, cost) = roads.CELL, network(7)
    edges = [(m, 1000 * c + k, int(a) + c * cell, int(b) + c * cell, float(x)) for m in ("CAR", "BIKE") for c in (0, 2) for k, (a, b, x) in enumerate(zip(src, dst, cost))]
    costs = spark.createDataFrame(edges, "mode string, edge_id long, src long, dst long, cost double")
    od = [(i, (i * 7) % n + i % 2 * 2 * cell, (i * 11) % n + i % 2 * 2 * cell, ("CAR", "BIKE")[i % 3 % 2]) for i in range(400)]
    od += [(900, 1, 2 * cell + 1, "CAR"), (901, None, 3, "CAR"), (902, 5, None, "CAR"), (903, 5, 5, "CAR"), (904, 5, 5, "CAR"), (905, cell + 3, cell + 3, "CAR"), (906, cell + 3, 4, "CAR")]
    od = spark.createDataFrame(od, "od_id long, src long, dst long, mode string")
    trees = roads.search(od, costs)
    want = {r.od_id: r.g for r in roads.reached(od, trees).collect()}
    every = {(r.src, r.mode, r.node): r.g for r in roads.labels(roads.search(od.withColumn("dst", od.dst * None), costs)).collect()}
    written, write = [], tables.materialize
    monkeypatch.setattr(roads, "materialize", lambda df, name, **k: written.append(name) or write(df, name, **k))
    got = {r.od_id: r.g for r in roads.times(od, costs).collect()}
    assert got == want and got[903] == got[904] == got[905] == 0.0 and not {900, 901, 902, 906} & got.keys()
    assert {(r.src, r.mode, r.node): r.g for r in roads.one_to_all(od, costs).collect()} == every
    assert set(written) == {"asked"}


@pytest.mark.parametrize("few", [1, 1000])
def test_ways_lead_from_source_to_target(spark, monkeypatch, few):
    monkeypatch.setattr(roads, "FEW", few)
    n, src, dst, cost = network(3)
    edges = {k: (int(a), int(b), float(c)) for k, (a, b, c) in enumerate(zip(src, dst, cost))}
    costs = spark.createDataFrame([("CAR", k, *e) for k, e in edges.items()], "mode string, edge_id long, src long, dst long, cost double")
    od = {i: ((i * 7) % n, (i * 11) % n) for i in range(300)}
    goal, steps = roads.ways(spark.createDataFrame([(i, *p, "CAR") for i, p in od.items()], "od_id long, src long, dst long, mode string"), costs)
    walked = {}
    for r in steps.orderBy("od_id", "back").collect():
        walked.setdefault(r.od_id, []).append(r.edge_id)
    got = {r.od_id: r.g for r in goal.collect()}
    assert got == {i: g for i, (a, b) in od.items() if (g := dijkstra(n, src.tolist(), dst.tolist(), cost.tolist(), a)[b]) < float("inf")}
    for i, g in got.items():
        at, total = od[i][1], 0.0
        for k in walked.get(i, []):
            assert edges[k][1] == at
            at, total = edges[k][0], total + edges[k][2]
        assert (at, total) == (od[i][0], g)


def test_requests_alike_share_a_route(spark, monkeypatch):
    nodes = spark.createDataFrame([(0, 127.0, 37.5), (1, 127.01, 37.5)], "node_seq long, lon double, lat double")
    links = spark.createDataFrame([(5, 0, 1, "primary", 60, False, 882.0, "a", [(127.0, 37.5), (127.01, 37.5)])], "link_id long, from_node long, to_node long, road_class string, max_speed_kph int, oneway boolean, length_m double, road_name string, geom array<struct<x: double, y: double>>")
    rides = [(i, "WALK" if i == 3 else "CAR", 127.0, 37.5, 127.01, 40.0 if i == 4 else 37.5) for i in range(5)]
    asked, ways = [], roads.ways
    monkeypatch.setattr(roads, "ways", lambda od, *a: asked.append(od.count()) or ways(od, *a))
    headers, segments, steps = roads.routed(spark.createDataFrame(rides, "od_id long, mode string, from_lon double, from_lat double, to_lon double, to_lat double"), links, nodes)
    got = {r.od_id: (r.status, r.route_id, r.distance_m) for r in headers.collect()}
    assert got == {i: ("OK", 0, 882.0) for i in range(3)} | {3: ("OK", 3, 882.0), 4: ("UNSNAPPED", None, None)} and asked == [2]
    assert sorted((r.route_id, r.edge_id) for r in steps.collect()) == [(0, 10), (3, 10)] == sorted((r.route_id, 10) for r in segments.collect())
