from pyspark.sql import functions as F

from geoweft.operators import lines, raster


def scans(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def vertices(spark, tmp_path):
    rows = [(1, 0, 127.0, 37.5), (1, 1, 127.0, 37.5), (1, 2, 127.003, 37.5), (1, 3, 127.003, 37.5), (1, 4, 127.003, 37.502), (2, 0, 127.1, 37.5)]
    spark.createDataFrame(rows, "line_id long, seq int, lon double, lat double").write.parquet(f"{tmp_path}/v")
    return spark.read.parquet(f"{tmp_path}/v")


def test_lines_are_read_and_put_in_order_once(spark, tmp_path):
    found = lines.sampled(vertices(spark, tmp_path), 100.0)
    assert scans(found, "Relation") == 1 and scans(found, "Aggregate") == 0
    rows = found.orderBy("line_id", "distance_m").collect()
    whole = [r.distance_m for r in rows if r.line_id == 1]
    assert len(whole) == len(set(whole)) and whole[:3] == [0.0, 100.0, 200.0] and len(whole) == 3 + 3 - 1 + 2 and [r.distance_m for r in rows if r.line_id == 2] == [0.0]


def test_points_are_read_once_on_seams_and_beside_missing_tiles(spark, tmp_path):
    pixels = spark.range(16).select(F.lit("d").alias("dataset"), F.lit(0).alias("level"), F.lit(1).alias("band"), (F.col("id") % 4).cast("int").alias("col"), F.floor(F.col("id") / 4).cast("int").alias("row"), F.col("id").cast("double").alias("value"))
    tiles = raster.tiles_of(pixels, 2)
    meta = spark.createDataFrame([("d", 4, 4, [0.0, 1.0, 0.0, 4.0, 0.0, -1.0], -1.0)], "dataset string, raster_width int, raster_height int, gt array<double>, nodata double")
    spark.createDataFrame([(1, "d", 2.0, 2.0), (2, "d", 2.0, 3.25), (3, "d", 9.0, 9.0), (4, "d", 0.75, 2.0), (5, "d", 2.25, 2.25), (6, "d", 3.9, 0.1)], "qid long, dataset string, lon double, lat double").write.parquet(f"{tmp_path}/q")
    points = spark.read.parquet(f"{tmp_path}/q")
    found = raster.bilinear(points, tiles, meta, 2)
    assert scans(found, "Relation") == 1
    assert {r.qid: r.elevation for r in found.collect()} == {1: 7.5, 2: 2.5, 3: None, 4: 6.25, 5: 6.75, 6: 15.0}
    fewer = {r.qid: r.elevation for r in raster.bilinear(points, tiles.where("not (tile_col = 0 and tile_row = 0)"), meta, 2).collect()}
    assert fewer == {1: 10.0, 2: 2.0, 3: None, 4: 8.0, 5: 6.0, 6: 15.0}
