from geoweft.functions import geo
from geoweft.operators import roads, spatial
from geoweft.operators.spatial import Grid


def test_a_request_is_one_row_of_the_join(spark, monkeypatch):
    exploded, covering = [], Grid.covering
    monkeypatch.setattr(Grid, "covering", lambda self, boxes, *sides: exploded.append(boxes.columns) or covering(self, boxes, *sides))
    # on a leaf's edge, beyond reach, outside the range, without a place, and one between two nodes that are as near
    step = 500.0 / geo.M_PER_DEG_LAT
    asked = spark.createDataFrame([(1, 100 * step, 50 * step), (2, 10.0, 10.0), (3, 500.0, 0.0), (4, None, 1.0), (5, 0.001, 0.0)], "qid long, lon double, lat double")
    nodes = spark.createDataFrame([(9, 100 * step - 0.001, 50 * step), (8, 100 * step, 50 * step - 0.0009), (7, 0.002, 0.0), (6, 0.0, 0.0)], "node_seq long, lon double, lat double")
    assert {r.qid: r.node_seq for r in spatial.snap_join(asked, nodes).collect()} == {1: 8, 2: None, 3: None, 4: None, 5: 6}
    assert exploded and all("qid" not in columns for columns in exploded)


def test_pairs_without_nodes_stay(spark):
    rides = spark.createDataFrame([(1, "CAR", 0.0, 0.0, 0.001, 0.0), (2, "CAR", 5.0, 5.0, 0.0, 0.0), (3, "WALK", 5.0, 5.0, 6.0, 6.0)], "od_id long, mode string, from_lon double, from_lat double, to_lon double, to_lat double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0011, 0.0)], "node_seq long, lon double, lat double")
    assert {r.od_id: (r.src, r.dst) for r in roads.snapped_pairs(rides, nodes).collect()} == {1: (1, 2), 2: (None, 1), 3: (None, None)}


def test_candidates_are_not_sorted_for_the_least(spark):
    """Only what is left after the least distance is known is put in order: the aggregate over all candidates is by hash."""
    asked, nodes = spark.createDataFrame([(1, 0.0, 0.0)], "qid long, lon double, lat double"), spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0)], "node_seq long, lon double, lat double")
    found = spatial.nearest_nodes(asked, nodes)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and found.count() == 1
