import inspect

from pyspark.sql import functions as F

from geoweft.functions import geo
from geoweft.operators import spatial
from geoweft.tables import spread


def test_rows_of_one_file_are_dealt_over_all_cores(spark):
    one = spark.range(1000).coalesce(1)
    n = 2 * spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() == n and sorted(r.id for r in spread(one).collect()) == list(range(1000))
    many = spark.range(0, 1000, 1, n)
    assert spread(many) is many


def test_nearest_places_look_at_few(spark):
    """Few places a leaf where none are asked for; a limit within a radius gives what ranking all pairs gives."""
    assert inspect.signature(spatial.knn_join).parameters["most"].default <= 1000
    q = spark.range(40).select(F.col("id").alias("qid"), (127 + F.col("id") % 7 * 0.003).alias("lon"), (37.5 + F.col("id") % 5 * 0.004).alias("lat"))
    p = spark.range(3000).select(F.col("id").alias("poi_id"), (127 + F.col("id") * 7919 % 211 / 10000).alias("lon"), (37.5 + F.col("id") * 104729 % 199 / 10000).alias("lat"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("category"))
    every = sorted((r.qid, r.distance_m, r.poi_id) for r in spatial.radius_join(q, p, 300.0, category=F.col("category") == "a").collect())
    want, seen = set(), {}
    for qid, _, poi in every:
        seen[qid] = seen.get(qid, 0) + 1
        if seen[qid] <= 4:
            want.add((qid, seen[qid], poi))
    few = spatial.radius_join(q, p, 300.0, limit=4, category=F.col("category") == "a")
    assert {(r.qid, r.rank, r.poi_id) for r in few.collect()} == want and want
    assert {r.category for r in few.collect()} == {"a"}


def test_spheroid_distance_of_a_batch(spark):
    rows = [(0.0, 0.0, 1.0, 0.0), (127.0, 37.5, 127.0, 37.5), (127.0, 37.5, None, 37.5)]
    got = [r.d for r in spark.createDataFrame(rows, "a double, b double, c double, d double").coalesce(1).select(geo.spheroid_distance("a", "b", "c", "d").alias("d")).collect()]
    assert abs(got[0] - 111319.491) < 1e-3 and got[1:] == [0.0, None]
