import json

from pyspark.sql import functions as F

from geoweft.sources import vector
from geoweft.streaming import ingest


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


def test_geojson_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Point", [1.0, 2.0], NAME="x", Y=None), feature("Polygon", [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]), {"type": "Feature", "properties": {}, "geometry": None}]}))
    (d / "bad.geojson").write_text("{nothing")
    found, bad = vector.read_collections(spark, str(d))
    rows = found.orderBy("feature_no").collect()
    assert rows[0].attrs == {"name": "x", "y": None} and tuple(rows[0].parts[0][0]) == (1.0, 2.0) and len(rows[1].parts[0]) == 3 and rows[2].parts is None
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.geojson"]
    files = {r.name: r for r in vector.file_listing(spark, str(d)).collect()}
    assert files["bad.geojson"].bytes == 8 and len(files["a.geojson"].sha256) == 64 and files["a.geojson"].extension == ".geojson"


def test_snapshots_are_replaced_by_partition(spark, tmp_path):
    out = str(tmp_path / "nodes")
    rows = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 1, 0), ("b", 1, 2)], "dataset string, version_no int, node_seq long")
    vector.write_snapshot(rows, out, ["node_seq"])
    vector.write_snapshot(rows.where("dataset = 'a'"), out)
    assert vector.read_snapshot(spark, out, "a", 1).count() == 2 and spark.read.parquet(out).count() == 4
    assert {r.dataset: r.contiguous for r in vector.contiguous(spark.read.parquet(out)).collect()} == {"a": True, "b": False}


def test_stream_of_files(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "good@1.geojsonl").write_text("\n".join(json.dumps(feature("Point", [127.0 + i / 100, 37.0], name=f"p{i}")) for i in range(4)))
    (src / "torn@1.geojsonl").write_text(json.dumps(feature("Point", [127.0, 37.0], name="p")) + "\n{nothing\n\n")
    found, bad = vector.read_lines(spark, str(src / "torn@1.geojsonl"))
    assert found.count() == 1 and [r.lines for r in bad.collect()] == [1]
    (src / "bad@1.geojsonl").write_text("\n".join(json.dumps(feature("Point", [127.0, 37.0])) for i in range(4)))
    ingest.ingest(spark, str(src), out, str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.dataset, r.name) for r in spark.read.parquet(f"{out}/poi").collect()} == {("good", f"p{i}") for i in range(4)}
    assert spark.read.parquet(f"{out}/validation").where("severity = 'ERROR'").select("dataset").distinct().orderBy("dataset").collect() == [("bad",), ("torn",)]
    assert [r.rule_code for r in spark.read.parquet(f"{out}/validation").where("dataset = 'torn'").collect()] == ["READABLE"]


def test_live_views(spark, tmp_path):
    rows = [(1, 1, "UPLOADED", 1, "x"), (1, 1, "VALIDATING", 2, "x"), (1, 1, "PUBLISHED", 3, "y"), (2, 1, "PUBLISHED", 1, "x"), (2, 2, "PUBLISHED", 5, "z")]
    src = str(tmp_path / "events")
    spark.createDataFrame(rows, "dataset long, version_no int, to_status string, changed_at int, checksum string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(ingest.live_active(stream()), "complete", "live") == [(1, 1), (2, 2)]
    assert run(ingest.first_files(stream()).select("dataset", "checksum"), "append", "firsts") == [(1, "x"), (1, "y"), (2, "x"), (2, "z")]
    assert run(ingest.illegal_transitions(stream()), "append", "illegal") == [(1, 1, "VALIDATING", "PUBLISHED")]
    assert ingest.live_active(spark.read.parquet(src)).where(F.col("dataset") == 2).first().version_no == 2
