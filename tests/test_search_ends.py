"""Targets that can't be reached don't carry a search over the whole network."""

import pytest

from geoweft.operators import roads


@pytest.mark.parametrize("goal", [False, True])
def test_unreachable_targets_end_with_their_cell(spark, monkeypatch, goal):
    cell = roads.CELL
    at = lambda k: k * (cell // 4)  # noqa: E731  four nodes a cell, twelve cells in a row
    both = [(a, b) for k in range(47) for a, b in ((k, k + 1), (k + 1, k))]
    edges = [("CAR", i, at(a), at(b), 1.0) for i, (a, b) in enumerate(both)] + [("CAR", 500, 5, at(0), 1.0), ("CAR", 501, at(4) + 7, at(4) + 8, 2.0), ("CAR", 502, at(4), at(4) + 8, 9.0)]
    costs = spark.createDataFrame(edges, "mode string, edge_id long, src long, dst long, cost double")
    # 5 is left only, 6 has no edge, the pocket behind at(4) + 7 is entered by at(4), itself not at all
    pairs = [(1, at(0), at(2)), (2, at(0), 5), (3, at(1), 6), (4, 5, at(1)), (5, 5, 5), (6, at(5), at(4) + 7), (7, at(4) + 7, at(4) + 8), (8, at(1), 5)]
    od = spark.createDataFrame([(i, a, b, "CAR") for i, a, b in pairs], "od_id long, src long, dst long, mode string")
    nodes = spark.createDataFrame([(n, 0.00001 * n / cell, 0.0) for n in {x for e in edges for x in e[2:4]} | {6}], "node_seq long, lon double, lat double")
    vmax = spark.createDataFrame([("CAR", 100.0)], "mode string, vmax double")
    trees = roads.search(od, costs, *((nodes, vmax) if goal else ()), max_rounds=3)
    assert {r.od_id: r.g for r in roads.reached(od, trees).collect()} == {1: 2.0, 4: 2.0, 5: 0.0, 7: 2.0}
    assert trees.agg({"cell": "max"}).first()[0] <= 2
    assert {(r.od_id, r.edge_id) for r in roads.paths(od, trees).collect()} == {(1, 0), (1, 2), (4, 500), (4, 0), (7, 501)}
