"""A directory of all three types, one bad file each, killed between stages and run again."""

import json

import pytest
from pyspark.sql import functions as F

from geoweft.operators.batch import Run


def feature(kind, coordinates, **properties):
    return json.dumps({"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}})


def grid(n, m, cell=0.001, x=127.0, y=37.0, values=None, nodata=-9999):
    rows = values or [[r * m + c for c in range(m)] for r in range(n)]
    return f"ncols {m}\nnrows {n}\nxllcorner {x}\nyllcorner {y}\ncellsize {cell}\nNODATA_value {nodata}\n" + "\n".join(" ".join(map(str, r)) for r in rows) + "\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    line = lambda a, b: [[127.0 + a / 1000, 37.0], [127.0 + b / 1000, 37.0]]
    (d / "sub").mkdir()
    texts = {
        "city@1.poi.geojsonl": "\n".join(feature("Point", [127.0 + k / 100, 37.0], name=f"p{k}", category="x") for k in range(4)),
        "nameless@1.poi.geojsonl": "\n".join(feature("Point", [127.0, 37.0]) for _ in range(4)),
        "torn@2.poi.geojsonl": feature("Point", [127.0, 37.0], name="p") + "\n{nothing",
        "nothing@1.poi.geojsonl": "",
        "net@1.roads.geojsonl": "\n".join(feature("LineString", line(k, k + 1), highway="primary", maxspeed="50", link_id=f"l{k}") for k in range(5)),
        "net@2.roads.geojsonl": "\n".join(feature("LineString", line(k, k + 1), highway="primary", maxspeed="50") for k in (0, 1)),
        "points@1.roads.geojsonl": feature("Point", [127.0, 37.0]),
        "hill@1.asc": grid(5, 7), "sub/far@3.asc": grid(2, 2, x=10.0, y=50.0), "short@1.asc": grid(2, 2, values=[[1, 2], [3]]), "holes@1.asc": grid(2, 2, values=[[-9999, -9999], [-9999, 4]]), "noise@1.txt": "not a dataset", "headless@1.asc": "1 2 3\n",
    }
    for name, text in texts.items():
        (d / name).write_text(text)
    return str(d)


def tables(spark, out):
    read = lambda t, *c: sorted(map(tuple, spark.read.parquet(f"{out}/{t}").select(*c).collect()), key=str)
    return {
        "poi": read("poi", "dataset", "version_no", "name", "lon"), "node": read("node", "dataset", "version_no", "node_seq", "lon"), "link": read("link", "dataset", "version_no", "link_id", "from_node", "to_node", "max_speed_kph"),
        "raster": read("raster", "dataset", "version_no", "level", "tile_col", "tile_row", F.array_join("data", ",")), "validation": read("validation", "dataset", "version_no", "rule_code", "severity"),
    }


def test_a_killed_run_ends_like_a_whole_one(spark, files, tmp_path):
    Run(spark, files, str(tmp_path / "whole"), "a", size=4).run()
    want = tables(spark, str(tmp_path / "whole"))
    errors = {(d, v, r) for d, v, r, s in want["validation"] if s == "ERROR"}
    assert errors == {("nameless", 1, "POI_NAME"), ("torn", 2, "READABLE"), ("points", 1, "GEOMETRY_TYPE"), ("points", 1, "ROAD_CONNECTIVITY"), ("far", 3, "WITHIN_SERVICE_AREA"), ("short", 1, "READABLE"), ("headless", 1, "READABLE")}
    assert ("holes", 1, "RASTER_NODATA_RATIO", "WARN") in want["validation"]
    assert [r[:3] for r in want["poi"]] == [("city", 1, f"p{k}") for k in range(4)]
    assert [r[:3] for r in want["node"]] == [("net", 1, k) for k in range(6)] + [("net", 2, k) for k in range(3)]
    assert [r[2:5] for r in want["link"]] == [(k + 1, k, k + 1) for k in range(5)] + [(k + 1, k, k + 1) for k in range(2)]
    hill = {r[2:5]: r[5] for r in want["raster"] if r[0] == "hill"}
    assert set(hill) == {(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1), (1, 0, 0)} and hill[0, 1, 1] == "32.0,33.0,34.0" and hill[1, 0, 0].startswith("4.0,6.0,8.0,9.5,")
    assert {r[0] for r in want["raster"]} == {"hill", "holes"}

    class Killed(Exception):
        pass

    def kill(at):
        def after(stage):
            if stage == at:
                raise Killed
        return after

    out = str(tmp_path / "killed")
    for stage in ("read", "validate"):
        with pytest.raises(Killed):
            Run(spark, files, out, "b", size=4).run(after=kill(stage))
    # killed inside a stage: what it has written so far is written again
    torn = Run(spark, files, out, "b", size=4)
    torn.publish()
    assert torn.done("validate") and not torn.done("publish")
    Run(spark, files, out, "b", size=4).run()
    assert tables(spark, out) == want
