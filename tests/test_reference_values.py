"""Closed-form expectations on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoweft.functions import geo
from geoweft.functions import roads as rules
from geoweft.operators import catalog, lines, quality, raster, roads, spatial
from geoweft.sources import vector


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def xy(*points):
    return F.array(*[geo.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_distances_and_projections(spark):
    r = one(spark, a=geo.haversine(F.lit(127.0), F.lit(37.0), F.lit(127.0), F.lit(38.0)), s=geo.spheroid_distance(F.lit(127.0), F.lit(37.0), F.lit(127.0), F.lit(38.0)), n=geo.haversine(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)), p=geo.transform_crs(F.lit(127.0), F.lit(38.0), 4326, 5186), k=geo.transform_crs(F.lit(129.0756), F.lit(35.1796), 4326, 5179))
    assert abs(r.a - 111195) < 100 and abs(r.s - 110_985) < 30 and r.n is None
    assert abs(r.p.x - 200000) < 0.01 and abs(r.p.y - 600000) < 0.01 and 1.1e6 < r.k.x < 1.2e6
    for lon, lat in ((126.978, 37.5665), (129.0756, 35.1796), (126.5312, 33.4996)):
        for code in geo.TRANSVERSE_MERCATOR:
            q = geo.transform_crs(F.lit(lon), F.lit(lat), 4326, code)
            b = one(spark, b=geo.transform_crs(q["x"], q["y"], code, 4326)).b
            assert abs(b.x - lon) < 1e-8 and abs(b.y - lat) < 1e-8
    with pytest.raises(ValueError):
        geo.transform_crs(F.lit(1.0), F.lit(1.0), 4326, 99999)


def test_spheroid_against_published_lengths(spark):
    """A degree of the equator and a quarter of a meridian on WGS 84."""
    f = lambda *x: geo.spheroid_distance(*[F.lit(float(c)) for c in x])
    r = one(spark, degree=f(10, 0, 11, 0), quarter=f(20, 0, 20, 90), same=f(127, 37, 127, 37))
    assert abs(r.degree - 111319.490793) < 1e-3 and abs(r.quarter - 10001965.7293) < 1e-3 and r.same == 0


def test_attributes_and_rules(spark):
    r = one(spark, mph=rules.speed_kph(F.lit("30 mph")), no=rules.speed_kph(F.lit("none")), zero=rules.speed_kph(F.lit("0")), km=rules.speed_kph(F.lit("50 km/h")), back=rules.direction(F.lit("-1")), both=rules.direction(F.lit(None).cast("string")), walk=rules.walk_allowed(F.lit(" Motorway ")), bike=rules.bike_allowed(F.lit("steps")), car=rules.car_allowed(F.lit("footway")), speed=rules.car_speed_kph(F.lit("103"), F.lit(None).cast("int")), tobler=rules.tobler_kph(F.lit(-0.05)), up=rules.bike_kph(F.lit(0.5)), down=rules.bike_kph(F.lit(-0.5)), ext=rules.extension(F.lit("A.b.GeoJSON")), ok=rules.allowed_extension(F.lit("RASTER"), F.lit("x.TIF")), pc=rules.percent(F.lit(0.1234)))
    assert (r.mph, r.no, r.zero, r.km, r.back, r.both) == (48, None, None, 50, "REVERSE", "BOTH")
    assert not r.walk and not r.bike and not r.car and r.speed == 60 and r.tobler == 6.0 and r.up == 3.0 and r.down == 30.0
    assert r.ext == ".geojson" and r.ok and r.pc == "12.3%"


def test_geometry_validity_and_geojson(spark):
    r = one(spark, good=geo.valid_ring(xy((0, 0), (1, 0), (1, 1), (0, 0))), bow=geo.valid_ring(xy((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))), open=geo.valid_ring(xy((0, 0), (1, 0), (1, 1))), dot=geo.valid_line(xy((0, 0), (0, 0))), line=geo.valid_line(xy((0, 0), (1, 0))), j=vector.to_geojson(F.lit("LineString"), F.array(xy((0, 1), (2, 3)))), n=vector.to_geojson(F.lit("Point"), F.lit(None).cast("array<array<struct<x:double,y:double>>>")))
    assert r.good and not r.bow and not r.open and not r.dot and r.line and r.n is None
    assert r.j == '{"type":"LineString","coordinates":[[0.0,1.0],[2.0,3.0]]}'


def dem(spark):
    p = spark.range(160_000).select(F.lit("d").alias("dataset"), F.lit(0).alias("level"), F.lit(1).alias("band"), (F.col("id") % 400).cast("int").alias("col"), F.floor(F.col("id") / 400).cast("int").alias("row"))
    p = p.withColumn("value", F.when((F.col("col") < 10) & (F.col("row") < 10), -9999.0).otherwise(50 + 0.5 * F.col("col")))
    meta = spark.createDataFrame([("d", 400, 400, [200000.0, 30.0, 0.0, 550000.0, 0.0, -30.0], -9999.0)], "dataset string, raster_width int, raster_height int, gt array<double>, nodata double")
    return raster.tiles_of(p, 128), meta


def test_raster(spark):
    tiles, meta = dem(spark)
    at = lambda col, row: (200000 + 30 * col, 550000 - 30 * row)
    points = [(1, *at(37.5, 12.5)), (2, *at(100.5, 50.5)), (3, *at(101, 50.5)), (4, *at(-1, 3)), (5, *at(3.5, 3.5)), (6, *at(399.9, 399.9))]
    q = spark.createDataFrame([(i, "d", float(x), float(y)) for i, x, y in points], "qid long, dataset string, lon double, lat double")
    assert {r.qid: r.value for r in raster.pixel_values(q, tiles, meta, 128).collect()} == {1: 68.5, 2: 100.0, 3: 100.5, 4: None, 5: None, 6: 249.5}
    assert {r.qid: r.elevation for r in raster.bilinear(q, tiles, meta, 128).collect()} == {1: 68.5, 2: 100.0, 3: 100.25, 4: None, 5: None, 6: 249.5}
    s = raster.statistics(tiles, meta).first()
    assert (s.n_pixels, s.min_value, s.max_value) == (160000, 50.0, 249.5) and abs(s.nodata_ratio - 100 / 160000) < 1e-12
    assert raster.overviews(tiles, meta, 128, most=120).select("level").distinct().count() == 3
    ring = one(spark, f=raster.footprint(F.array(*map(F.lit, (200000.0, 30.0, 0.0, 550000.0, 0.0, -30.0))), F.lit(400), F.lit(400), 5186)).f
    assert len(ring) == 33 and ring[0] == ring[-1]


def test_line_sampling(spark):
    v = spark.createDataFrame([(1, 0, 127.0, 37.0), (1, 1, 127.0, 37.01), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0)], "line_id long, seq int, lon double, lat double")
    n = {r.line_id: r["count"] for r in lines.sampled(v, 100.0).groupBy("line_id").count().collect()}
    assert n == {1: 13, 2: 1}


def grid(spark, n, lon=127.02, lat=37.49):
    rows = []
    for r in range(n):
        for c in range(n):
            p = (lon + c * 0.001, lat + r * 0.001)
            for kind, q in (("residential", (c + 1, r)), ("secondary", (c, r + 1))):
                if q[0] < n and q[1] < n:
                    rows.append((len(rows), "LineString", [[p, (lon + q[0] * 0.001, lat + q[1] * 0.001)]], {"highway": kind, "maxspeed": "30" if kind == "residential" else "50"}))
    return spark.createDataFrame(rows, "feature_id long, geom_type string, parts array<array<struct<x: double, y: double>>>, attrs map<string, string>")


def test_topology_and_route_on_a_grid(spark):
    nodes, links = roads.topology(grid(spark, 4))
    assert nodes.count() == 16 and links.count() == 24 and roads.dangling(nodes, links).count() == 0
    c = roads.connectivity(nodes, links).first()
    assert (c.component_count, c.largest, c.ratio) == (1, 16, 1.0)
    corner = nodes.orderBy(F.col("lat") + F.col("lon")).first().node_seq, nodes.orderBy(F.desc(F.col("lat") + F.col("lon"))).first().node_seq
    od = spark.createDataFrame([(1, *corner, "CAR"), (2, corner[0], corner[0], "WALK"), (3, corner[0], None, "BIKE")], "od_id long, src long, dst long, mode string")
    e = roads.edges(links)
    plain = roads.search(od.where("od_id < 3"), roads.costs(e))
    goal = roads.search(od.where("od_id < 3"), roads.costs(e), nodes, roads.max_speed_mps(e))
    h = geo.haversine(F.lit(127.02), F.lit(37.49), F.lit(127.023), F.lit(37.49))
    v = geo.haversine(F.lit(127.02), F.lit(37.49), F.lit(127.02), F.lit(37.493))
    want = one(spark, t=h / (30 / 3.6) + v / (50 / 3.6), d=h + v)
    headers, segments = roads.routes(od, goal, roads.paths(od.where("od_id < 3"), goal), e, links, nodes)
    by = {r.od_id: r for r in headers.collect()}
    assert abs(by[1].duration_s - want.t) < 0.1 and abs(by[1].distance_m - want.d) < 1 and by[1].ascent_m is None and len(by[1].line) == 7
    assert by[2].duration_s == 0 and by[2].distance_m == 0 and len(by[2].line) == 2 and by[3].status == "UNSNAPPED"
    n = {k: {(r.src, r.mode): r.visited for r in roads.visited(x).collect()} for k, x in (("plain", plain), ("goal", goal))}
    assert n["goal"][corner[0], "CAR"] <= n["plain"][corner[0], "CAR"]
    assert abs(roads.labels(plain).where(f"mode = 'CAR' and node = {corner[1]}").first().g - by[1].duration_s) < 1e-9
    assert segments.where("od_id = 1").count() >= 2


def test_rules(spark):
    m = spark.createDataFrame([("a", 1, "RASTER", None, None, 0.9995, 30.0, None), ("b", 1, "RASTER", "WKT", [127.0, 0.1, 0.0, 37.0, 0.0, -0.1], None, 5000.0, 5186)], "dataset string, version_no int, type string, srs string, gt array<double>, nodata_ratio double, resolution_m double, epsg int")
    found = {(r.dataset, r.rule_code): r.severity for r in quality.run(m).collect()}
    assert found["a", "RASTER_CRS"] == found["a", "RASTER_GEOREFERENCE"] == found["a", "RASTER_NODATA_RATIO"] == "ERROR"
    assert found["b", "RASTER_CRS"] == found["b", "RASTER_NODATA_RATIO"] == "INFO" and found["b", "RASTER_RESOLUTION"] == "WARN" and len(found) == 10
    d = {r.dataset: r for r in quality.decide(quality.run(m)).collect()}
    assert d["a"].status == "REJECTED" and d["a"].reason.count(" / ") == 2 and d["b"].status == "VALIDATED" and d["b"].reason is None


def test_knn_against_brute_force(spark):
    r = random.Random(3)
    places = [(i, 127 + r.random() * 0.2, 37 + r.random() * 0.2) for i in range(400)]
    asked = [(i, 127 + r.random() * 0.3, 37 + r.random() * 0.3) for i in range(30)]
    got = {}
    for x in spatial.knn_join(spark.createDataFrame(asked, "qid long, lon double, lat double"), spark.createDataFrame(places, "poi_id long, lon double, lat double"), 3).collect():
        got.setdefault(x.qid, {})[x.rank] = x.poi_id

    def hav(a, b):
        s = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(s))

    for q in asked:
        best = sorted(places, key=lambda p: (hav(q, p), p[0]))[:3]
        assert [got[q[0]][k] for k in (1, 2, 3)] == [p[0] for p in best]


def test_catalogue_publish(spark):
    v = spark.createDataFrame([(1, 1, "ARCHIVED", 1), (1, 2, "PUBLISHED", 2), (2, 1, "PROCESSED", 1), (3, 1, "REJECTED", 1), (4, 1, "PUBLISHED", 1)], "dataset long, version_no int, status string, changed_at int")
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1)], "dataset long, target int")
    rows = {tuple(r) for r in catalog.publish(v, asked).collect()}
    assert rows == {(1, 1, "ARCHIVED", "PUBLISHED"), (1, 2, "PUBLISHED", "ARCHIVED"), (2, 1, "PROCESSED", "PUBLISHED"), (3, 1, "REJECTED", "ERROR"), (5, 1, None, "ERROR")}
