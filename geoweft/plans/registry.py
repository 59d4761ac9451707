"""Every registered query by name, with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoweft.functions import geo, polygons
from geoweft.functions import roads as rules
from geoweft.operators import catalog, lines, quality, raster, roads, spatial
from geoweft.operators.components import components
from geoweft.plans import fixtures as fx
from geoweft.plans.fixtures import derive, hav
from geoweft.sources import vector
from geoweft.tables import materialize, shared_dir, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def metres(c) -> F.Column:
    return F.round(c, 3)


# --- scalar functions -------------------------------------------------------------------------------------------


@query("p01_p09_point_scalars", f"""
select poi_id, round({hav('127e0', '37.5e0', 'lon', 'lat')}, 3) distance_m, cast(floor(lon/0.005e0) as bigint) cx, cast(floor(lat/0.005e0) as bigint) cy,
  cast(floor(lon*1e7+0.5e0) as bigint) kx, cast(floor(lat*1e7+0.5e0) as bigint) ky, round(500e0/(111320e0*cos(radians(abs(lat)+500e0/110574e0))), 9) lon_deg, lon between -180 and 180 and lat between -90 and 90 as in_range,
  case when lon < 127e0 then 127e0 when lon > 127.05e0 then 127.05e0 else lon end clamped from ({fx.POI}) p""")
def point_scalars(spark, d):
    lon, lat = F.col("lon"), F.col("lat")
    return derive(spark, d, fx.POI).select(
        "poi_id", metres(geo.haversine(F.lit(127.0), F.lit(37.5), lon, lat)).alias("distance_m"), geo.cell(lon, 0.005).alias("cx"), geo.cell(lat, 0.005).alias("cy"), geo.snapped(lon).alias("kx"), geo.snapped(lat).alias("ky"),
        F.round(geo.lon_degrees(F.lit(500.0), lat), 9).alias("lon_deg"), geo.in_lon_lat_range(lon, lat).alias("in_range"), geo.clamp(lon, F.lit(127.0), F.lit(127.05)).alias("clamped"))


@query("p02_spheroid_distance", f"select poi_id, true as close_to_sphere from ({fx.POI}) p")
def spheroid(spark, d):
    s, e = geo.haversine(F.lit(127.0), F.lit(37.5), F.col("lon"), F.col("lat")), geo.spheroid_distance(F.lit(127.0), F.lit(37.5), F.col("lon"), F.col("lat"))
    return spread(derive(spark, d, fx.POI)).select("poi_id", (F.abs(s - e) <= 0.006 * s + 1e-6).alias("close_to_sphere"))


@query("p10_p14_affine", f"""
select poi_id, round((lon-126.95e0)/0.0005e0, 6) px, round((37.57e0-lat)/0.0003e0, 6) py,
 (lon-126.95e0)/0.0005e0 >= 0 and (lon-126.95e0)/0.0005e0 < 400 and (37.57e0-lat)/0.0003e0 >= 0 and (37.57e0-lat)/0.0003e0 < 400 as inside, round(lon, 9) lon, round(lat, 9) lat from ({fx.POI}) p""")
def affine(spark, d):
    gt = F.array(*map(F.lit, fx.DEM_GT))
    p = derive(spark, d, fx.POI).withColumn("p", geo.to_pixel(gt, F.col("lon"), F.col("lat")))
    back = geo.apply_transform(gt, F.col("p.x"), F.col("p.y"))
    return p.select("poi_id", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), geo.in_raster(F.col("p.x"), F.col("p.y"), F.lit(400), F.lit(400)).alias("inside"), F.round(back["x"], 9).alias("lon"), F.round(back["y"], 9).alias("lat"))


@query("p15_crs_round_trip", f"select poi_id, round(lon, 8) lon, round(lat, 8) lat, round(lon, 8) lon2, round(lat, 8) lat2 from ({fx.POI}) p")
def crs(spark, d):
    p = derive(spark, d, fx.POI).withColumn("a", geo.transform_crs(F.col("lon"), F.col("lat"), 4326, 5186)).withColumn("b", geo.transform_crs(F.col("a.x"), F.col("a.y"), 5186, 5179))
    p = p.withColumn("c", geo.transform_crs(F.col("b.x"), F.col("b.y"), 5179, 4326)).withColumn("e", geo.transform_crs(F.col("a.x"), F.col("a.y"), 5186, 4326))
    return p.select("poi_id", F.round("e.x", 8).alias("lon"), F.round("e.y", 8).alias("lat"), F.round("c.x", 8).alias("lon2"), F.round("c.y", 8).alias("lat2"))


def krueger(lon: str, lat: str, lon0: str, lat0: str) -> tuple[str, str]:
    """Easting and northing above the origin on GRS 80 as SQL: the series in the third flattening n, to its fourth power."""
    n, a = "(1e0/298.257222101e0/(2e0-1e0/298.257222101e0))", "6378137e0"
    radius = f"({a}/(1+{n})*(1+{n}*{n}/4+pow({n},4)/64))"
    alpha = [f"({n}/2-2*pow({n},2)/3+5*pow({n},3)/16+41*pow({n},4)/180)", f"(13*pow({n},2)/48-3*pow({n},3)/5+557*pow({n},4)/1440)", f"(61*pow({n},3)/240-103*pow({n},4)/140)", f"(49561*pow({n},4)/161280)"]
    k = f"(2*sqrt({n})/(1+{n}))"

    def ends(lon: str, lat: str) -> tuple[str, str]:
        t, d = f"sinh(atanh(sin(radians({lat})))-{k}*atanh({k}*sin(radians({lat}))))", f"radians({lon}-({lon0}))"
        return f"atan2({t}, cos({d}))", f"atanh(sin({d})/sqrt(1+pow({t},2)))"

    xi, eta = ends(lon, lat)
    xi0, _ = ends(lon0, lat0)
    east = f"{radius}*({eta}+" + "+".join(f"{c}*cos({2 * j}*{xi})*sinh({2 * j}*{eta})" for j, c in enumerate(alpha, 1)) + ")"
    north = f"{radius}*({xi}+" + "+".join(f"{c}*sin({2 * j}*{xi})*cosh({2 * j}*{eta})" for j, c in enumerate(alpha, 1)) + f"-({xi0})-(" + "+".join(f"{c}*sin({2 * j}*{xi0})" for j, c in enumerate(alpha, 1)) + "))"
    return east, north


EAST, NORTH = krueger("lon", "lat", "127e0", "38e0")


@query("p15_projected", f"select poi_id, round(200000e0+{EAST}, 3) x, round(600000e0+{NORTH}, 3) y from ({fx.POI}) p")
def projected(spark, d):
    p = derive(spark, d, fx.POI).withColumn("a", geo.transform_crs(F.col("lon"), F.col("lat"), 4326, 5186))
    return p.select("poi_id", F.round("a.x", 3).alias("x"), F.round("a.y", 3).alias("y"))


ATTRS = f"""select link_id, k, road_class, max_speed_kph, oneway, case k%4 when 0 then cast(max_speed_kph as varchar(9)) when 1 then cast(max_speed_kph as varchar(9)) || ' km/h' when 2 then cast(max_speed_kph as varchar(9)) || ' mph' end speed_text,
 case when oneway and k%2=0 then 'yes' when oneway then '-1' else 'no' end way_text from ({fx.LINKS}) l"""


def features(spark, d):
    a = derive(spark, d, ATTRS.replace("varchar(9)", "string"))
    name = F.when(F.col("k") % 3 == 0, "Highway").when(F.col("k") % 3 == 1, "road_rank").otherwise("CLASS")
    ends = derive(spark, d, fx.LINKS).select("link_id", F.array(F.array(geo.point(F.col("lon1"), F.col("lat1")), geo.point(F.col("lon2"), F.col("lat2")))).alias("parts"))
    attrs = F.map_from_arrays(F.array(F.lit("link_id"), name, F.lit("maxspeed"), F.lit("oneway")), F.array(F.col("link_id").cast("string"), F.col("road_class"), F.col("speed_text"), F.col("way_text")))
    return a.join(ends, "link_id").select(F.col("link_id").alias("feature_id"), F.lit("LineString").alias("geom_type"), "parts", attrs.alias("attrs"))


@query("p25_p30_road_attributes", f"""
select cast(link_id as varchar) source_id, road_class, oneway, case when k%4 in (0, 1) then max_speed_kph when k%4 = 2 then cast(floor(max_speed_kph*1.609344e0+0.5e0) as int) end max_speed_kph from ({ATTRS}) a""")
def road_attributes(spark, d):
    return roads.link_lines(features(spark, d)).select("source_id", "road_class", "oneway", "max_speed_kph")


def bil(px: str, py: str) -> str:
    x0, y0 = f"least(floor(greatest({px}-0.5e0, 0e0)), 398e0)", f"least(floor(greatest({py}-0.5e0, 0e0)), 398e0)"
    fx_, fy = f"least(greatest({px}-0.5e0, 0e0), 399e0)", f"least(greatest({py}-0.5e0, 0e0), 399e0)"
    return f"case when {px} >= 0 and {px} < 400 and {py} >= 0 and {py} < 400 then case when {x0} < 10 and {y0} < 10 then case when floor({px}) < 10 and floor({py}) < 10 then null else 50e0+0.5e0*floor({px})+0.25e0*floor({py}) end else 50e0+0.5e0*{fx_}+0.25e0*{fy} end end"


SPEED = "cast(max_speed_kph as double)"
COST = f"""select mode, edge_id, src, dst, cost from (
 select link_id*2 edge_id, from_node src, to_node dst, true fwd, * from lk union all select link_id*2+1, to_node, from_node, false, * from lk) e,
 (select 'CAR' mode union all select 'WALK' union all select 'BIKE') m,
 lateral (select case mode when 'CAR' then case when road_class <> 'footway' and (fwd or not oneway) then len/({SPEED}/3.6e0) end
   when 'WALK' then case when road_class <> 'motorway' then len/(6e0*exp(-3.5e0*abs(0.05e0))/3.6e0) end
   else case when road_class <> 'motorway' then len/(15e0/3.6e0) end end cost) x where cost is not null"""
LK = f"lk as (select *, {hav('lon1', 'lat1', 'lon2', 'lat2')} len from ({fx.LINKS}) l)"


def grid_links(spark, d, sql=fx.LINKS):
    return derive(spark, d, sql).withColumn("length_m", geo.haversine("lon1", "lat1", "lon2", "lat2")).withColumn("road_name", F.concat(F.lit("road "), F.when(F.col("dir") == 0, F.col("r")).otherwise(F.col("c"))))\
        .withColumn("geom", F.array(geo.point(F.col("lon1"), F.col("lat1")), geo.point(F.col("lon2"), F.col("lat2"))))


@query("g03_p39_edge_costs", f"with {LK} select mode, edge_id, src, dst, round(cost, 6) cost from ({COST}) c")
def edge_costs(spark, d):
    return roads.costs(roads.edges(grid_links(spark, d))).withColumn("cost", F.round("cost", 6)).select("mode", "edge_id", "src", "dst", "cost")


SLOPED = f"""with {LK}, z as (select *, {bil('((lon1-126.95e0)/0.0005e0)', '((37.57e0-lat1)/0.0003e0)')} z1, {bil('((lon2-126.95e0)/0.0005e0)', '((37.57e0-lat2)/0.0003e0)')} z2 from lk),
s as (select *, coalesce(greatest(-1e0, least(1e0, (z2-z1)/len)), 0e0) up from z where road_class <> 'motorway'),
e as (select link_id*2 edge_id, len, up from s union all select link_id*2+1, len, -up from s)
select 'WALK' as mode, edge_id, round(up, 6) slope, round(len/(6e0*exp(-3.5e0*abs(up+0.05e0))/3.6e0), 6) as cost from e
union all select 'BIKE', edge_id, round(up, 6), round(len/(case when up >= 0 then greatest(3e0, 15e0*(1-8*up)) else least(30e0, 15e0*(1-4*up)) end/3.6e0), 6) from e"""


@query("j14_g11_slope_costs", SLOPED)
def slope_costs(spark, d):
    tiles, meta = fx.dem(spark)
    e = roads.edges(grid_links(spark, d), roads.node_elevation(derive(spark, d, fx.NODES), tiles, meta, "dem", 128))
    c = roads.costs(e).where("mode <> 'CAR'").join(e.select("edge_id", "slope"), "edge_id")
    return c.select("mode", "edge_id", F.round("slope", 6).alias("slope"), F.round("cost", 6).alias("cost"))


@query("p36_p37_slope_speeds", """
select l_linenumber, l_orderkey, round(s, 9) slope, round(6e0*exp(-3.5e0*abs(s+0.05e0)), 6) walk_kph, round(case when s >= 0 then greatest(3e0, 15e0*(1-8*s)) else least(30e0, 15e0*(1-4*s)) end, 6) bike_kph
from (select l_orderkey, l_linenumber, (l_orderkey%41-20)/20e0 s from lineitem) x""")
def slope_speeds(spark, d):
    s = geo.slope(F.lit(0.0), (F.col("l_orderkey") % 41 - 20).cast("double"), F.lit(20.0))
    return derive(spark, d, "select l_orderkey, l_linenumber from lineitem").select("l_linenumber", "l_orderkey", F.round(s, 9).alias("slope"), F.round(rules.tobler_kph(s), 6).alias("walk_kph"), F.round(rules.bike_kph(s), 6).alias("bike_kph"))


@query("s11_n05_geojson", f"""select poi_id, '{{"type":"Point","coordinates":[' || cast(kx as varchar) || ',' || cast(ky as varchar) || ']}}' geojson from (select poi_id, round(lon*1000e0)/8e0 kx, round(lat*1000e0)/8e0 ky from ({fx.POI}) p) q""")
def geojson(spark, d):
    p = derive(spark, d, fx.POI).withColumn("g", F.array(F.array(geo.point(F.round(F.col("lon") * 1000.0) / 8.0, F.round(F.col("lat") * 1000.0) / 8.0))))
    return p.select("poi_id", vector.to_geojson(F.lit("Point"), F.col("g")).alias("geojson"))


# --- spatial joins ----------------------------------------------------------------------------------------------


@query("j06_radius_join", f"""
select qid, poi_id, category, round({hav('q.lon', 'q.lat', 'p.lon', 'p.lat')}, 3) distance_m from ({fx.POINTS}) q, ({fx.POI}) p where {hav('q.lon', 'q.lat', 'p.lon', 'p.lat')} <= 1500e0""")
def radius_join(spark, d):
    return spatial.radius_join(derive(spark, d, fx.POINTS), derive(spark, d, fx.POI), 1500.0).select("qid", "poi_id", "category", metres(F.col("distance_m")).alias("distance_m"))


@query("t01_radius_top_by_category", f"""
select qid, poi_id, rank from (select qid, poi_id, cast(row_number() over (partition by qid order by {hav('q.lon', 'q.lat', 'p.lon', 'p.lat')}, poi_id) as int) rank
 from ({fx.POINTS}) q, ({fx.POI}) p where category = 'BUILDING' and {hav('q.lon', 'q.lat', 'p.lon', 'p.lat')} <= 3000e0) x where rank <= 3""")
def radius_top(spark, d):
    return spatial.radius_join(derive(spark, d, fx.POINTS), derive(spark, d, fx.POI), 3000.0, limit=3, category=F.col("category") == "BUILDING").select("qid", "poi_id", F.col("rank").cast("int").alias("rank"))


KNN = f"select qid, poi_id, cast(row_number() over (partition by qid order by {hav('q.lon', 'q.lat', 'p.lon', 'p.lat')}, poi_id) as int) rank, {hav('q.lon', 'q.lat', 'p.lon', 'p.lat')} d from ({fx.POINTS}) q, ({fx.POI}) p"


@query("j07_knn_join", f"select qid, rank, poi_id, round(d, 3) distance_m from ({KNN}) x where rank <= 5")
def knn(spark, d):
    return spatial.knn_join(derive(spark, d, fx.POINTS), derive(spark, d, fx.POI), 5).withColumn("distance_m", metres(F.col("distance_m")))


@query("j08_snap_join", f"""
select q.qid, b.node_seq, b.snap_m from ({fx.POI.replace('poi_id', 'qid')}) q left join (
 select qid, node_seq, round(d, 3) snap_m from (select qid, node_seq, {hav('q.lon', 'q.lat', 'p.lon', 'p.lat')} d, row_number() over (partition by qid order by {hav('q.lon', 'q.lat', 'p.lon', 'p.lat')}, node_seq) n
  from ({fx.POI.replace('poi_id', 'qid')}) q, ({fx.NODES}) p where {hav('q.lon', 'q.lat', 'p.lon', 'p.lat')} <= 500e0) x where n = 1) b on q.qid = b.qid""")
def snap(spark, d):
    return spatial.snap_join(derive(spark, d, fx.POI).withColumnRenamed("poi_id", "qid"), derive(spark, d, fx.NODES)).select("qid", "node_seq", metres(F.col("snap_m")).alias("snap_m"))


@query("j02_c07_bbox_search", f"select qid, fid, dataset from ({fx.SEARCH}) q, ({fx.BOXES}) b where qminx <= maxx and qmaxx >= minx and qminy <= maxy and qmaxy >= miny")
def bbox_search(spark, d):
    return spatial.bbox_join(derive(spark, d, fx.SEARCH), derive(spark, d, fx.BOXES)).select("qid", "fid", "dataset")


EDGES = "select *, lead(x) over (partition by fid, part, ring order by seq) x2, lead(y) over (partition by fid, part, ring order by seq) y2 from ({points}) f"
SEARCHED = f"""
with active as (select * from (select dataset, version_no, o_orderkey, row_number() over (partition by dataset order by changed_at desc, version_no desc) n from ({fx.VERSIONS}) v where status = 'PUBLISHED') x where n = 1),
edges as (select a.dataset, a.version_no, e.* exclude (dataset) from ({EDGES.format(points=fx.FOOTPRINTS)}) e join active a on a.o_orderkey = e.fid where x2 is not null),
boxes as (select fid, min(x) minx, min(y) miny, max(x) maxx, max(y) maxy from edges group by fid),
sides as (
  select q.qid, e.*, q.qminx, q.qminy, q.qmaxx, q.qmaxy, (x2-x)*(qminy-y)-(y2-y)*(qminx-x) a, (x2-x)*(qmaxy-y)-(y2-y)*(qminx-x) b, (x2-x)*(qminy-y)-(y2-y)*(qmaxx-x) c, (x2-x)*(qmaxy-y)-(y2-y)*(qmaxx-x) d
  from ({fx.POLYGON_SEARCH}) q join boxes o on qminx <= maxx and qmaxx >= minx and qminy <= maxy and qmaxy >= miny join edges e on e.fid = o.fid),
parts as (
  select qid, dataset, version_no, part, bool_or(least(x,x2) <= qmaxx and greatest(x,x2) >= qminx and least(y,y2) <= qmaxy and greatest(y,y2) >= qminy and least(a,b,c,d) <= 0 and greatest(a,b,c,d) >= 0) touched,
    sum(case when (y > qminy) <> (y2 > qminy) and qminx < (x2-x)*(qminy-y)/(y2-y)+x then 1 else 0 end) crossed
  from sides group by all)
select distinct qid, dataset, version_no from parts where touched or crossed % 2 = 1"""


def footprints(spark, d):
    shapes = vector.shapes_of(derive(spark, d, fx.FOOTPRINTS).drop("dataset"), ["fid"])
    return shapes.join(versions(spark, d).select(F.col("o_orderkey").alias("fid"), "dataset", "version_no"), "fid")


@query("f05_j02_c07_polygon_search", SEARCHED)
def polygon_search(spark, d):
    return spatial.polygon_search(derive(spark, d, fx.POLYGON_SEARCH), footprints(spark, d), versions(spark, d))


PAIRED = f"""
with e as (select *, count(*) over (partition by fid, part, ring) n from ({EDGES.format(points=fx.SHAPES)}) e where x2 is not null),
p as (select a.fid, a.part part1, a.ring ring1, a.seq seq1, b.part part2, b.ring ring2, b.seq seq2, a.n,
    sign((a.x2-a.x)*(b.y-a.y)-(a.y2-a.y)*(b.x-a.x)) d1, sign((a.x2-a.x)*(b.y2-a.y)-(a.y2-a.y)*(b.x2-a.x)) d2, sign((b.x2-b.x)*(a.y-b.y)-(b.y2-b.y)*(a.x-b.x)) d3, sign((b.x2-b.x)*(a.y2-b.y)-(b.y2-b.y)*(a.x2-b.x)) d4,
    least(greatest(a.x,a.x2),greatest(b.x,b.x2))-greatest(least(a.x,a.x2),least(b.x,b.x2)) sx, least(greatest(a.y,a.y2),greatest(b.y,b.y2))-greatest(least(a.y,a.y2),least(b.y,b.y2)) sy
  from e a join e b on a.fid = b.fid and (a.part, a.ring, a.seq) < (b.part, b.ring, b.seq)),
m as (select *, d1*d2 < 0 and d3*d4 < 0 as through, d1 = 0 and d2 = 0 and sx >= 0 and sy >= 0 and (sx > 0 or sy > 0) as along, d1*d2 <= 0 and d3*d4 <= 0 and sx >= 0 and sy >= 0 as meet, part1 = part2 and ring1 = ring2 as one from p),
points as (select fid, part, ring, x, y from e union select fid, part, ring, (x+x2)/2e0, (y+y2)/2e0 from e),
placed as (
  select q.fid, q.part part1, q.ring ring1, q.x, q.y, r.part part2, r.ring ring2,
    bool_or((r.x2-r.x)*(q.y-r.y)-(r.y2-r.y)*(q.x-r.x) = 0 and least(r.x,r.x2) <= q.x and q.x <= greatest(r.x,r.x2) and least(r.y,r.y2) <= q.y and q.y <= greatest(r.y,r.y2)) as on_it,
    sum(case when (r.y > q.y) <> (r.y2 > q.y) and q.x < (r.x2-r.x)*(q.y-r.y)/(r.y2-r.y)+r.x then 1 else 0 end) % 2 = 1 as odd
  from points q join e r on r.fid = q.fid and (r.part, r.ring) <> (q.part, q.ring) group by all),
inner_ as (select fid, part1, ring1, x, y, part2, bool_or(ring2 = 0 and odd and not on_it) and not bool_or(ring2 > 0 and (odd or on_it)) as within from placed where part1 <> part2 and ring1 = 0 group by all),
found as (
  select fid, 2 as k from (select fid, part, ring, arg_min(x, seq) x1, arg_min(y, seq) y1, arg_max(x, seq) x9, arg_max(y, seq) y9 from ({fx.SHAPES}) s group by all) where x1 <> x9 or y1 <> y9
  union all select fid, 3 from (select fid, part, ring from (select distinct fid, part, ring, x, y from ({fx.SHAPES}) s) group by all having count(*) < 3)
  union all select fid, 4 from m where one and (along or (meet and not (seq2-seq1 = 1 or seq2-seq1 = n-1)))
  union all select fid, 5 from m where not one and part1 = part2 and (through or along)
  union all select fid, 6 from placed where part1 = part2 and ring2 = 0 and not odd and not on_it
  union all select fid, 7 from placed where part1 = part2 and ring1 > 0 and ring2 > 0 and odd and not on_it
  union all select fid, 8 from m where part1 <> part2 and (through or along)
  union all select fid, 8 from inner_ where within)
select o_orderkey fid, {polygons.REASONS!r}[k + 1] as reason from orders left join (select fid, min(k) k from found group by fid) f on fid = o_orderkey"""


@query("p23_polygon_validity", PAIRED)
def polygon_validity(spark, d):
    return vector.shapes_of(derive(spark, d, fx.SHAPES), ["fid"]).select("fid", polygons.invalid_reason(F.col("shapes")).alias("reason"))


@query("p23_polygon_orientation", f"""
select fid, sum(case when part = 0 and ring = 0 then a else 0e0 end) shell, sum(case when ring > 0 then 0e0-a else 0e0 end) holes
from (select fid, part, ring, abs(sum((x-x1)*(y2-y1)-(x2-x1)*(y-y1))) a
  from (select *, first_value(x) over (partition by fid, part, ring order by seq) x1, first_value(y) over (partition by fid, part, ring order by seq) y1 from ({EDGES.format(points=fx.SHAPES)}) e) g where x2 is not null group by fid, part, ring) r
group by fid""")
def polygon_orientation(spark, d):
    s = vector.shapes_of(derive(spark, d, fx.SHAPES), ["fid"])
    areas = F.transform(polygons.oriented(F.col("shapes")), lambda p: F.transform(p, polygons.doubled_area))
    holes = F.aggregate(areas, F.lit(0.0), lambda n, p: n + F.aggregate(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0.0), lambda m, a: m + a))
    return s.select("fid", areas[0][0].alias("shell"), holes.alias("holes"))


@query("f13_service_area", f"select fid, maxx >= 124e0 and minx <= 127e0 and maxy >= 33e0 and miny <= 37.5e0 as meets, minx >= 124e0 and maxx <= 127e0 and miny >= 33e0 and maxy <= 37.5e0 as contained from ({fx.BOXES}) b")
def service_area(spark, d):
    b = derive(spark, d, fx.BOXES).withColumns({"w": F.lit(124.0), "s": F.lit(33.0), "e": F.lit(127.0), "n": F.lit(37.5)})
    return b.select("fid", spatial.bbox_overlaps(("minx", "miny", "maxx", "maxy"), ("w", "s", "e", "n")).alias("meets"), ((F.col("minx") >= F.col("w")) & (F.col("maxx") <= F.col("e")) & (F.col("miny") >= F.col("s")) & (F.col("maxy") <= F.col("n"))).alias("contained"))


# --- rasters and lines ------------------------------------------------------------------------------------------

PIXEL = f"select poi_id qid, cast(floor((lon-126.95e0)/0.0005e0) as int) c, cast(floor((37.57e0-lat)/0.0003e0) as int) r, (lon-126.95e0)/0.0005e0 px, (37.57e0-lat)/0.0003e0 py from ({fx.POI}) p"


def dem_points(spark, d):
    return derive(spark, d, fx.POI).select(F.col("poi_id").alias("qid"), F.lit("dem").alias("dataset"), "lon", "lat")


@query("r03_pixel_values", f"""
select qid, px >= 0 and px < 400 and py >= 0 and py < 400 as inside, case when px >= 0 and px < 400 and py >= 0 and py < 400 and not (c < 10 and r < 10) then 50e0+0.5e0*c+0.25e0*r end as value from ({PIXEL}) x""")
def pixel_values(spark, d):
    tiles, meta = fx.dem(spark)
    return raster.pixel_values(dem_points(spark, d), tiles, meta, 128).select("qid", "inside", "value")


@query("r04_bilinear_elevation", f"select qid, round({bil('px', 'py')}, 6) elevation from ({PIXEL}) x")
def bilinear(spark, d):
    tiles, meta = fx.dem(spark)
    return raster.bilinear(dem_points(spark, d), tiles, meta, 128).select("qid", F.round("elevation", 6).alias("elevation"))


@query("a03_r01_raster_statistics", f"select (max(px)+1)*(max(py)+1) n_pixels, round(1 - count(*)/((max(px)+1)*(max(py)+1)*1e0), 9) nodata_ratio, min(v) min_value, max(v) max_value from ({fx.HEAT}) h")
def raster_statistics(spark, d):
    tiles, meta = fx.heat(spark, d)
    return raster.statistics(tiles, meta).select("n_pixels", F.round("nodata_ratio", 9).alias("nodata_ratio"), "min_value", "max_value")


@query("r10_retile", f"select px//32 tile_col, py//32 tile_row, count(v) n, max(v) hi from ({fx.HEAT}) h group by 1, 2")
def retile(spark, d):
    tiles, _ = fx.heat(spark, d)
    again = raster.tiles_of(raster.pixels_of(tiles, 64), 32)
    return again.select("tile_col", "tile_row", F.size(F.filter("data", lambda v: v.isNotNull())).cast("long").alias("n"), F.array_max("data").alias("hi")).where("n > 0")


@query("r11_overviews", f"select 1 as level, px//2 px, py//2 py, round(avg(v), 4) v from ({fx.HEAT}) h group by 1, 2, 3 union all select 2, px//2, py//2, round(avg(v), 4) from (select px//2 px, py//2 py, avg(v) v from ({fx.HEAT}) h group by 1, 2) g group by 1, 2, 3")
def overviews(spark, d):
    tiles, meta = fx.heat(spark, d)
    o = raster.pixels_of(raster.overviews(tiles, meta, 64, most=40).where("level > 0"), 64).where("value is not null")
    return o.select("level", F.col("col").alias("px"), F.col("row").alias("py"), F.round("value", 4).alias("v"))


PLACE_ROWS = " union all ".join(f"select {k} kind, '{n}' dataset, {'null' if epsg is None else epsg} epsg, '{srs}' srs, " + ", ".join(f"{v}e0 g{i}" for i, v in enumerate(gt)) for k, (n, epsg, srs, gt) in enumerate(fx.PLACES))
INSPECTED = f"""select dataset, w, h, srs, cast(epsg as int) epsg, 1e0-n/(w*h*1e0) nodata_ratio, lo, hi, abs(g1) pixel_x, abs(g5) pixel_y, case epsg when 4326 then abs(g1)*111320e0*cos(radians(g3+g4*(w/2e0)+g5*(h/2e0))) when 5186 then abs(g1) end resolution_m,
  least(g0, g0+g1*w, g0+g2*h, g0+g1*w+g2*h) minx, least(g3, g3+g4*w, g3+g5*h, g3+g4*w+g5*h) miny, greatest(g0, g0+g1*w, g0+g2*h, g0+g1*w+g2*h) maxx, greatest(g3, g3+g4*w, g3+g5*h, g3+g4*w+g5*h) maxy
from (select kind, max(px)+1 w, max(py)+1 h, count(*) n, min(v) lo, max(v) hi from ({fx.PLACED}) p group by kind) s join ({PLACE_ROWS}) r using (kind)"""


@query("r01_p17_inspected_rasters", f"select dataset, w, h, 2 n_bands, 'Float64' data_type, epsg, pixel_x, pixel_y, round(resolution_m, 6) resolution_m, round(nodata_ratio, 9) nodata_ratio, lo, hi, round(minx, 9) minx, round(miny, 9) miny, round(maxx, 9) maxx, round(maxy, 9) maxy, case when epsg is null then 0 else 33 end corners from ({INSPECTED}) i")
def inspected_rasters(spark, d):
    r = raster.inspected(*fx.placed(spark, d))
    own = [F.round(f"own_{c}", 9).alias(c) for c in ("minx", "miny", "maxx", "maxy")]
    return r.select("dataset", F.col("raster_width").alias("w"), F.col("raster_height").alias("h"), "n_bands", "data_type", "epsg", "pixel_x", "pixel_y", F.round("resolution_m", 6).alias("resolution_m"), F.round("nodata_ratio", 9).alias("nodata_ratio"), F.col("min_value").alias("lo"), F.col("max_value").alias("hi"), *own, F.coalesce(F.size("footprint"), F.lit(0)).alias("corners"))


@query("r01_v01_v05_measured_rules", f"""
with i as (select *, case when epsg = 4326 then minx when epsg = 5186 then 127e0+(minx-200000)/89000 end west, case when epsg = 4326 then maxx when epsg = 5186 then 127e0+(maxx-200000)/87000 end east, case when epsg = 4326 then miny when epsg = 5186 then 38e0+(miny-600000)/110000 end south, case when epsg = 4326 then maxy when epsg = 5186 then 38e0+(maxy-600000)/112000 end north from ({INSPECTED}) x)
select dataset, 'RASTER_CRS' rule_code, case when trim(srs) = '' then 'ERROR' else 'INFO' end severity from i
union all select dataset, 'RASTER_GEOREFERENCE', case when dataset = 'bare' then 'ERROR' else 'INFO' end from i
union all select dataset, 'WITHIN_SERVICE_AREA', case when west is null then 'INFO' when west > 132 or east < 124 or south > 39 or north < 33 then 'ERROR' when west < 124 or east > 132 or south < 33 or north > 39 then 'WARN' else 'INFO' end from i
union all select dataset, 'RASTER_NODATA_RATIO', case when nodata_ratio >= 0.999e0 then 'ERROR' when nodata_ratio > 0.5e0 then 'WARN' else 'INFO' end from i
union all select dataset, 'RASTER_RESOLUTION', case when resolution_m is not null and not (resolution_m between 0.05e0 and 1000e0) then 'WARN' else 'INFO' end from i""")
def measured_rules(spark, d):
    measured = raster.inspected(*fx.placed(spark, d)).withColumns({"version_no": F.lit(1), "type": F.lit("RASTER")})
    return quality.run(measured).select("dataset", "rule_code", "severity")


@query("r03_p11_rotated_pixels", f"""
select qid, x.px >= 0 and x.px < w and x.py >= 0 and x.py < h as inside, v as value from (
  select qid, (0.0003e0*37.57e0-126.95e0*-0.0008e0)/d+(-0.0008e0/d)*lon+(-0.0003e0/d)*lat px, (126.95e0*0.0002e0-0.0008e0*37.57e0)/d+(-0.0002e0/d)*lon+(0.0008e0/d)*lat py, w, h
  from (select c_custkey qid, 126.95e0+((c_custkey*7919)%14000)/100000e0 lon, 37.46e0+((c_custkey*104729)%13000)/100000e0 lat, 0.0008e0*-0.0008e0-0.0003e0*0.0002e0 d from customer) q, (select max(px)+1 w, max(py)+1 h from ({fx.PLACED}) p where kind = 1) s) x
left join ({fx.PLACED}) p on p.kind = 1 and p.px = floor(x.px) and p.py = floor(x.py)""")
def rotated_pixels(spark, d):
    tiles, meta = fx.placed(spark, d)
    points = derive(spark, d, "select c_custkey qid, 'rotated' dataset, 126.95e0+((c_custkey*7919)%14000)/100000e0 lon, 37.46e0+((c_custkey*104729)%13000)/100000e0 lat from customer")
    return raster.pixel_values(points, tiles.where("band = 1"), meta, 64).select("qid", "inside", "value")


@query("s08_r11_written_levels", f"""
with l0 as (select px, py, v from ({fx.HEAT}) h), l1 as (select px//2 px, py//2 py, avg(v) v from l0 group by 1, 2)
select 2 version_no, 0 as level, count(*) n, round(sum(v), 2) total from l0 union all select 2, 1, count(*), round(sum(v), 2) from l1
union all select 3, 0, count(*), round(sum(v), 2) from l0""")
def written_levels(spark, d):
    """Two versions; the third was first written with more levels, which its rewrite took away."""
    tiles, meta = fx.heat(spark, d)
    path = f"{shared_dir(spark)}/geoweft/tiles-{uuid.uuid4().hex}"
    for version, most in ((3, 40), (2, 80), (3, 400)):
        raster.write_tiles(tiles, meta, path, version, 64, most)
    out = None
    for version in (2, 3):
        t = raster.pixels_of(raster.read_tiles(spark, path, "heat", version), 64).where("value is not null")
        t = t.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.lit(version).alias("version_no"), "level", "n", "total")
        out = t if out is None else out.unionByName(t)
    return out


LEGS = f"select *, case when seq = 0 then 0e0 else {hav('plon', 'plat', 'lon', 'lat')} end leg from (select *, lag(lon) over w plon, lag(lat) over w plat from ({fx.LINES}) l window w as (partition by line_id order by seq)) x"
DIST = f"select *, sum(leg) over (partition by line_id order by seq rows unbounded preceding) dist from ({LEGS}) y"


@query("w01_p03_line_lengths", f"select line_id, count(*) n, round(sum(leg), 2) length_m from ({LEGS}) y group by line_id")
def line_lengths(spark, d):
    return lines.measured(derive(spark, d, fx.LINES)).groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("distance_m"), 2).alias("length_m"))


SAMPLES = f"""select distinct line_id, dist, lon, lat from (
 select line_id, dist, lon, lat from ({DIST}) z
 union all select line_id, k*100e0, lon+(tlon-lon)*(k*100e0-dist)/(tdist-dist), lat+(tlat-lat)*(k*100e0-dist)/(tdist-dist)
 from (select *, unnest(generate_series(cast(greatest(ceil(dist/100e0), 1) as bigint), cast(ceil(tdist/100e0)-1 as bigint))) k from (select *, lead(dist) over w tdist, lead(lon) over w tlon, lead(lat) over w tlat from ({DIST}) z window w as (partition by line_id order by seq)) a where tdist > dist) b) c"""


@query("r08_line_sampling", f"select line_id, count(*) n_samples, round(max(dist), 2) length_m, round(sum(lon-126e0), 4) sum_lon from ({SAMPLES}) s group by line_id")
def line_sampling(spark, d):
    s = lines.sampled(derive(spark, d, fx.LINES), 100.0)
    return s.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.max("distance_m"), 2).alias("length_m"), F.round(F.sum(F.col("lon") - 126.0), 4).alias("sum_lon"))


@query("r09_elevation_profile", f"""
with s as ({SAMPLES}), z as (select line_id, dist, {bil('((lon-126.95e0)/0.0005e0)', '((37.57e0-lat)/0.0003e0)')} e from s),
dd as (select *, e - last_value(e ignore nulls) over (partition by line_id order by dist rows between unbounded preceding and 1 preceding) df from z)
select line_id, count(*) n_samples, round(sum(case when df > 0 then df else 0 end), 3) ascent_m, round(sum(case when df < 0 then -df else 0 end), 3) descent_m, round(min(e), 4) min_m, round(max(e), 4) max_m from dd group by line_id""")
def elevation_profile(spark, d):
    tiles, meta = fx.dem(spark)
    p = lines.profile(derive(spark, d, fx.LINES), tiles, meta, "dem", 100.0, 128)
    return p.select("line_id", "n_samples", F.round("ascent_m", 3).alias("ascent_m"), F.round("descent_m", 3).alias("descent_m"), F.round("min_m", 4).alias("min_m"), F.round("max_m", 4).alias("max_m"))


# --- road networks ----------------------------------------------------------------------------------------------


@query("g01_topology", f"""
with a as (select * from ({ATTRS}) a), l as (select lk.*, a.way_text from ({fx.LINKS}) lk join a using (link_id)),
d as (select link_id, case when way_text = '-1' then to_node else from_node end f, case when way_text = '-1' then from_node else to_node end t, {hav('lon1', 'lat1', 'lon2', 'lat2')} len from l),
e as (select link_id, 0 e, f node from d union all select link_id, 1, t from d),
n as (select node, row_number() over (order by min(link_id*2+e)) - 1 seq from e group by node)
select row_number() over (order by link_id) link_id, x.seq from_node, y.seq to_node, round(len, 3) length_m from d join n x on d.f = x.node join n y on d.t = y.node""")
def topology(spark, d):
    _, links = roads.topology(features(spark, d))
    return links.select("link_id", "from_node", "to_node", metres(F.col("length_m")).alias("length_m"))



@query("g02_components", f"""
with recursive e as (select from_node a, to_node b from ({fx.ISLANDS}) i union select to_node, from_node from ({fx.ISLANDS}) i),
r(root, node) as (select distinct a, a from e union select r.root, e.b from r join e on e.a = r.node)
select node, min(root) component from r group by node""")
def islands(spark, d):
    return components(derive(spark, d, fx.ISLANDS), "from_node", "to_node")


@query("a09_connectivity", f"""
with recursive e as (select from_node a, to_node b from ({fx.ISLANDS}) i union select to_node, from_node from ({fx.ISLANDS}) i),
r(root, node) as (select node_seq, node_seq from ({fx.NODES}) n union select r.root, e.b from r join e on e.a = r.node),
m as (select node, min(root) c from r group by node), s as (select c, count(*) n from m group by c)
select count(*) component_count, max(n) largest, cast(sum(n) as bigint) node_count, round(max(n)/(sum(n)*1e0), 6) ratio from s""")
def connectivity(spark, d):
    return roads.connectivity(derive(spark, d, fx.NODES), derive(spark, d, fx.ISLANDS)).withColumn("ratio", F.round("ratio", 6))


@query("a12_out_degree", f"select node, count(*) degree from (select from_node node from ({fx.LINKS}) l union all select to_node from ({fx.LINKS}) l) e group by node")
def out_degree(spark, d):
    return roads.edges(grid_links(spark, d)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


SEARCH = f"""with recursive {LK}, cost as materialized ({COST}), od as ({fx.OD}), trees as (select distinct src, mode from od),
best(src, mode, node, g) using key (src, mode, node) as (
 select src, mode, src, 0e0 from trees
 union all
 select c.src, c.mode, c.dst, c.g from (select b.src, b.mode, e.dst, min(b.g + e.cost) g from best b join cost e on e.src = b.node and e.mode = b.mode group by 1, 2, 3) c
 left join recurring.best o on o.src = c.src and o.mode = c.mode and o.node = c.dst where o.g is null or c.g < o.g - 1e-9)
"""


def search_input(spark, d):
    e = roads.edges(grid_links(spark, d))
    return derive(spark, d, fx.OD), e, roads.costs(e)


@query("g04_least_time", SEARCH + "select od.od_id, round(best.g, 4) cost from od left join best on best.src = od.src and best.mode = od.mode and best.node = od.dst")
def least_time(spark, d):
    od, _, cost = search_input(spark, d)
    return od.join(roads.times(od, cost), "od_id", "left").select("od_id", F.round("g", 4).alias("cost"))


@query("g08_routes", SEARCH + "select od.od_id, round(best.g, 4) duration_s, case when best.g is null then 'NO_PATH' else 'OK' end status, true as adds_up from od left join best on best.src = od.src and best.mode = od.mode and best.node = od.dst")
def assembled_routes(spark, d):
    od, e, cost = search_input(spark, d)
    nodes, links = derive(spark, d, fx.NODES), grid_links(spark, d)
    goal, steps = roads.ways(od, cost, nodes, roads.max_speed_mps(e))
    headers, segments = roads.routes(od, goal, steps, e, links, nodes)
    along = segments.groupBy("od_id").agg(F.sum("length_m").alias("along"))
    total = steps.join(od, "od_id").join(cost, ["edge_id", "mode"]).groupBy("od_id").agg(F.sum("cost").alias("again"))
    h = headers.join(along, "od_id", "left").join(total, "od_id", "left")
    fine = (F.abs(F.coalesce("again", F.lit(0.0)) - F.coalesce("duration_s", F.lit(0.0))) < 1e-6) & (F.abs(F.coalesce("along", F.lit(0.0)) - F.coalesce("distance_m", F.lit(0.0))) < 1e-6)
    fine = fine & (F.abs(F.coalesce(geo.line_length(F.col("line")), F.lit(0.0)) - F.coalesce("distance_m", F.lit(0.0))) < 1e-3)
    return h.select("od_id", F.round("duration_s", 4).alias("duration_s"), "status", fine.alias("adds_up"))


@query("a22_comparison_report", """
with p as (select o_orderkey, o_totalprice/20e0 d, o_orderkey%97 a, o_orderkey%31 b, case when o_orderkey%50 = 0 then 1e0 else 0e0 end x from orders),
q as (select case when d < 2000 then '0-2 km' when d < 5000 then '2-5 km' when d < 20000 then '5-20 km' end bucket, * from p)
select coalesce(bucket, 'total') bucket, count(*) n_pairs, round(avg(a), 6) mean_nodes_a, round(avg(b), 6) mean_nodes_b, list_sort(list(a))[cast(floor(count(*)*0.5e0) as int)+1] p50_nodes_a, list_sort(list(b))[cast(floor(count(*)*0.95e0) as int)+1] p95_nodes_b, cast(sum(x) as bigint) mismatches
from q where bucket is not null group by rollup(bucket)""")
def comparison_report(spark, d):
    p = derive(spark, d, "select o_totalprice/20e0 distance_m, 0e0 cost_a, case when o_orderkey%50 = 0 then 1e0 else 0e0 end cost_b, o_orderkey%97 nodes_a, o_orderkey%31 nodes_b from orders")
    return roads.comparison(p).withColumn("mean_nodes_a", F.round("mean_nodes_a", 6)).withColumn("mean_nodes_b", F.round("mean_nodes_b", 6))


# --- quality rules and catalogue --------------------------------------------------------------------------------

POIF = "select c_nationkey dataset, 1 version_no, case when c_custkey%40 = 3 then 'LineString' else 'Point' end geom_type, case when c_custkey%7 = 0 or c_nationkey = 5 then ' ' else c_name end name, 123e0+((c_custkey*7919)%15000)/1000e0+0*c_nationkey lon, 36e0+((c_custkey*104729)%12000)/10000e0 lat from customer"
POIM = f"select dataset, version_no, count(*) n, count(*) filter (geom_type <> 'Point') bad, count(*) filter (trim(name) = '') nameless, min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 from ({POIF}) f group by 1, 2"
REPORT = f"""
select dataset, version_no, 'WITHIN_SERVICE_AREA' rule_code, case when not (x0 <= 132 and x1 >= 124 and y0 <= 39 and y1 >= 33) then 'ERROR' when not (x0 >= 124 and x1 <= 132 and y0 >= 33 and y1 <= 39) then 'WARN' else 'INFO' end severity from ({POIM}) m
union all select dataset, version_no, 'GEOMETRY_TYPE', case when bad = n then 'ERROR' when bad > 0 then 'WARN' else 'INFO' end from ({POIM}) m
union all select dataset, version_no, 'GEOMETRY_VALID', 'INFO' from ({POIM}) m
union all select dataset, version_no, 'POI_NAME', case when nameless/(n*1e0) > 0.5e0 then 'ERROR' when nameless > 0 then 'WARN' else 'INFO' end from ({POIM}) m"""


@query("v13_rule_report", REPORT)
def rule_report(spark, d):
    return quality.run(quality.poi_measures(derive(spark, d, POIF))).select("dataset", "version_no", "rule_code", "severity")


@query("v14_decision", f"select dataset, version_no, case when count(*) filter (severity = 'ERROR') > 0 then 'REJECTED' else 'VALIDATED' end status from ({REPORT}) r group by 1, 2")
def decision(spark, d):
    return quality.decide(quality.run(quality.poi_measures(derive(spark, d, POIF)))).select("dataset", "version_no", "status")


#: One road data set for each island of seven columns, some without speeds or classes.
ROADF = f"""select link_id feature_id, cast(floor(c/7) as bigint) dataset, lon1, lat1, lon2, lat2, from_node, to_node, n,
 case when cast(floor(c/7) as bigint)%3 = 1 and k%4 <> 0 or k%4 = 3 then null else cast(max_speed_kph as varchar(9)) end speed_text, case when cast(floor(c/7) as bigint)%5 = 4 and k%11 = 0 then null else road_class end road_class
 from ({fx.ISLANDS}) i"""
ROADR = f"""
with recursive f as ({ROADF}), e as (select from_node a, to_node b from f union select to_node, from_node from f),
r(root, node) as (select distinct a, a from e union select r.root, e.b from r join e on e.a = r.node),
m as (select node, min(root) c from r group by node), n as (select max(n) n from f),
s as (select cast(floor(node%n/7) as bigint) dataset, c, count(*) k from m, n group by 1, 2), w as (select dataset, max(k)/(sum(k)*1e0) ratio from s group by 1),
q as (select dataset, count(*) n, count(*) filter (speed_text is null) slow, count(*) filter (road_class is null) plain from f group by 1)
select dataset, 1 version_no, 'ROAD_CONNECTIVITY' rule_code, case when ratio < 0.95e0 then 'WARN' else 'INFO' end severity from w
union all select dataset, 1, 'ROAD_ATTRIBUTES', case when slow/(n*1e0) > 0.5e0 or plain > 0 then 'WARN' else 'INFO' end from q
union all select dataset, 1, rule_code, 'INFO' from q, (select unnest(['WITHIN_SERVICE_AREA', 'GEOMETRY_TYPE', 'GEOMETRY_VALID']) rule_code) c"""


@query("v08_v09_road_rules", ROADR)
def road_rules(spark, d):
    f = derive(spark, d, ROADF.replace("varchar(9)", "string"))
    line = F.array(F.array(geo.point(F.col("lon1"), F.col("lat1")), geo.point(F.col("lon2"), F.col("lat2"))))
    attrs = F.map_from_arrays(F.array(F.lit("highway"), F.lit("maxspeed")), F.array("road_class", "speed_text"))
    roads_ = f.select("dataset", F.lit(1).alias("version_no"), "feature_id", F.lit("LineString").alias("geom_type"), line.alias("parts"), attrs.alias("attrs"))
    return quality.run(roads.measures(roads_)).select("dataset", "version_no", "rule_code", "severity")


RASTERS = "select o_custkey dataset, cast(o_orderkey as int) version_no, o_orderkey%1001/1000e0 nodata_ratio, case when o_orderkey%9 = 0 then null else (o_orderkey%2000)/1e0 end resolution_m, case when o_orderkey%11 = 0 then ' ' else 'WKT' end srs, 'RASTER' type from orders"


@query("v01_v05_raster_rules", f"""
select version_no, 'RASTER_CRS' rule_code, case when trim(srs) = '' then 'ERROR' else 'INFO' end severity from ({RASTERS}) r
union all select version_no, 'RASTER_NODATA_RATIO', case when nodata_ratio >= 0.999e0 then 'ERROR' when nodata_ratio > 0.5e0 then 'WARN' else 'INFO' end from ({RASTERS}) r
union all select version_no, 'RASTER_RESOLUTION', case when resolution_m is not null and not (resolution_m between 0.05e0 and 1000e0) then 'WARN' else 'INFO' end from ({RASTERS}) r""")
def raster_rules(spark, d):
    return quality.run(derive(spark, d, RASTERS)).where(F.col("rule_code").isin("RASTER_CRS", "RASTER_NODATA_RATIO", "RASTER_RESOLUTION")).select("version_no", "rule_code", "severity")


def versions(spark, d):
    return derive(spark, d, fx.VERSIONS.replace("varchar(20)", "string"))


@query("w07_c01_next_versions", f"select dataset, o_orderkey, cast(base + row_number() over (partition by dataset order by o_orderkey) as int) version_no from (select o_custkey dataset, o_orderkey from orders where o_orderkey%3 = 0) u join (select dataset, coalesce(max(case when o_orderkey%3 <> 0 then version_no end), 0) base from ({fx.VERSIONS}) v group by dataset) b using (dataset)")
def next_versions(spark, d):
    v = versions(spark, d)
    up = v.where("o_orderkey % 3 = 0").select("dataset", F.col("o_orderkey").alias("arrival"))
    return catalog.register(v.where("o_orderkey % 3 <> 0"), up).select("dataset", F.col("arrival").alias("o_orderkey"), "version_no")


LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in catalog.TRANSITIONS)


@query("c02_illegal_transitions", f"""
select dataset, version_no, from_status, to_status from (select dataset, version_no, lag(to_status) over (partition by dataset, version_no order by changed_at) from_status, to_status from ({fx.STATUS_EVENTS}) v) x
where from_status is not null and (from_status, to_status) not in (values {LEGAL})""")
def illegal_transitions(spark, d):
    pairs = catalog.transitions(derive(spark, d, fx.STATUS_EVENTS))
    return catalog.illegal(pairs).select("dataset", "version_no", "from_status", "to_status")


@query("c03_v11_duplicate_files", f"select a.dataset, a.version_no from ({fx.VERSIONS}) a where exists (select 1 from ({fx.VERSIONS}) b where b.dataset = a.dataset and b.checksum = a.checksum and b.version_no <> a.version_no and b.status <> 'REJECTED')")
def duplicate_files(spark, d):
    return catalog.duplicate_versions(versions(spark, d)).select("dataset", "version_no")


ACTIVE = f"select dataset, version_no from (select dataset, version_no, row_number() over (partition by dataset order by changed_at desc, version_no desc) n from ({fx.VERSIONS}) v where status = 'PUBLISHED') x where n = 1"


@query("c05_active_versions", ACTIVE)
def active_versions(spark, d):
    return catalog.active(versions(spark, d))


TARGET = f"select dataset, version_no target from (select dataset, version_no, row_number() over (partition by dataset order by changed_at desc, version_no desc) n from ({fx.VERSIONS}) v where status = 'ARCHIVED') x where n = 1"


@query("c06_c04_rollback", f"""
select dataset, target version_no, 'ARCHIVED' from_status, 'PUBLISHED' to_status from ({TARGET}) t
union all select dataset, version_no, 'PUBLISHED', 'ARCHIVED' from ({TARGET}) t join ({ACTIVE}) a using (dataset)""")
def rollback(spark, d):
    v = versions(spark, d)
    return catalog.publish(v, catalog.rollback_target(v))


@query("c08_w10_latest_version", f"select dataset, max(version_no) version_no, count(*) n from ({fx.VERSIONS}) v group by dataset")
def latest_version(spark, d):
    v = versions(spark, d)
    n = v.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return catalog.latest(v, ["dataset"], "version_no").join(n, "dataset").select("dataset", "version_no", "n")


@query("j01_j03_active_boxes", f"select b.fid, b.dataset, a.version_no from ({fx.BOXES}) b left join ({ACTIVE}) a on a.dataset = b.dataset")
def active_boxes(spark, d):
    return catalog.datasets(derive(spark, d, fx.BOXES), versions(spark, d)).select("fid", "dataset", F.col("active_version").alias("version_no"))


@query("a01_a02_bounds", f"select dataset, 1 version_no, round(min(minx), 9) minx, round(min(miny), 9) miny, round(max(maxx), 9) maxx, round(max(maxy), 9) maxy from ({fx.BOXES}) b group by dataset")
def extents(spark, d):
    b = derive(spark, d, fx.BOXES).withColumn("version_no", F.lit(1)).withColumn("line", geo.envelope(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))
    return quality.bounds(b).select("dataset", "version_no", *[F.round(c, 9).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


TYPES = "select distinct o_custkey dataset, case o_custkey%3 when 0 then 'RASTER' when 1 then 'POI' else 'ROAD_NETWORK' end type from orders"
METAS = "select o_custkey dataset, cast(l_linenumber as int) version_no, max(l_partkey) raster_width, max(l_suppkey) raster_height from orders join lineitem on l_orderkey = o_orderkey group by 1, 2"


@query("p50_j05_c08_version_details", f"""
select v.dataset, v.version_no, type, coalesce(a.version_no = v.version_no, false) active, case when type = 'RASTER' then raster_width end raster_width, case when type = 'RASTER' then raster_height end raster_height
from ({fx.VERSIONS}) v join ({TYPES}) t using (dataset) left join ({ACTIVE}) a using (dataset) left join ({METAS}) m on m.dataset = v.dataset and m.version_no = v.version_no""")
def version_details(spark, d):
    return catalog.details(versions(spark, d), derive(spark, d, TYPES), derive(spark, d, METAS)).select("dataset", "version_no", "type", "active", "raster_width", "raster_height")


@query("j04_t04_active_of_type", f"select dataset, type, version_no active_version from ({TYPES}) t join ({ACTIVE}) a using (dataset) where type = 'POI'")
def active_of_type(spark, d):
    return catalog.active_of_type(derive(spark, d, TYPES), versions(spark, d), "POI")


@query("f11_s10_status_counts", f"select dataset, version_no, count(*) as rows from ({fx.STATUS_EVENTS}) e where to_status in ('PUBLISHED', 'ARCHIVED') group by 1, 2")
def status_counts(spark, d):
    return catalog.row_counts(catalog.status_in(derive(spark, d, fx.STATUS_EVENTS).withColumnRenamed("to_status", "status"), ["PUBLISHED", "ARCHIVED"]))


@query("j17_new_checksums", f"select o_orderkey, checksum from ({fx.VERSIONS}) v where status = 'ARCHIVED' and not exists (select 1 from ({fx.VERSIONS}) w where w.status <> 'ARCHIVED' and w.dataset = v.dataset and w.checksum = v.checksum)")
def new_checksums(spark, d):
    v = versions(spark, d)
    return catalog.known(v.where("status = 'ARCHIVED'"), v.where("status <> 'ARCHIVED'"), ["dataset", "checksum"], there=False).select("o_orderkey", "checksum")


@query("f01_f02_checked_requests", """
select o_orderkey qid, case when not (lon between -180e0 and 180e0) then 'POSITION' when not (radius > 0 and radius <= 20000) then 'RADIUS' when not (places between 1 and 200) then 'LIMIT' end error
from (select o_orderkey, o_orderkey%400/1e0-200e0 lon, o_totalprice/10e0-500e0 radius, o_custkey%260 places from orders) x""")
def checked_requests(spark, d):
    q = derive(spark, d, "select o_orderkey qid, o_orderkey%400/1e0-200e0 lon, 37.5e0 lat, o_totalprice/10e0-500e0 radius, o_custkey%260 places from orders")
    return spatial.checked(q, "radius", "places").select("qid", "error")


@query("w09_edge_offsets", f"""
with e as (select from_node src from ({fx.LINKS}) l union all select to_node from ({fx.LINKS}) l), g as (select src, count(*) degree from e group by 1)
select src, cast(sum(degree) over (order by src) - degree as bigint) as "offset", degree from g""")
def edge_offsets(spark, d):
    return roads.edge_offsets(roads.edges(grid_links(spark, d)))


@query("n08_flat_coordinates", f"select link_id, [round(lon1, 6), round(lat1, 6), round(lon2, 6), round(lat2, 6)] coordinates from ({fx.LINKS}) l")
def flat_coordinates(spark, d):
    return grid_links(spark, d).select("link_id", F.transform(geo.flat_coordinates(F.col("geom")), lambda c: F.round(c, 6)).alias("coordinates"))


@query("a10_component_sizes", f"""
with recursive e as (select from_node a, to_node b from ({fx.ISLANDS}) i union select to_node, from_node from ({fx.ISLANDS}) i),
r(root, node) as (select node_seq, node_seq from ({fx.NODES}) n union select r.root, e.b from r join e on e.a = r.node),
m as (select node, min(root) c from r group by node)
select node node_seq, c component, count(*) over (partition by c) as size from m""")
def component_sizes(spark, d):
    return roads.component_sizes(derive(spark, d, fx.NODES), derive(spark, d, fx.ISLANDS))


@query("r01_a04_inspection", f"""
select 'heat' dataset, max(px)+1 raster_width, max(py)+1 raster_height, cast(1 as bigint) n_bands, 0.001e0 pixel_x, true georeferenced, round(126.95e0+0.001e0*(max(px)+1), 6) maxx, round(37.57e0-0.001e0*(max(py)+1), 6) miny, max(v) max_value from ({fx.HEAT}) h""")
def inspection(spark, d):
    tiles, meta = fx.heat(spark, d)
    return raster.inspected(tiles, meta).select("dataset", "raster_width", "raster_height", "n_bands", "pixel_x", "georeferenced", F.round("maxx", 6).alias("maxx"), F.round("miny", 6).alias("miny"), "max_value")


RIDES = """
select od_id, mode, 127.018e0+(od_id*7919)%2400/100000e0 from_lon, 37.488e0+(od_id*104729)%2300/100000e0 from_lat, 127.018e0+(od_id*6151)%2400/100000e0 to_lon, 37.488e0+(od_id*3571)%2300/100000e0 to_lat
from (select o_orderkey od_id, case o_orderkey%3 when 0 then 'CAR' when 1 then 'WALK' else 'BIKE' end mode from orders) o"""


def nearest_node(end: str) -> str:
    d = hav(f"{end}_lon", f"{end}_lat", "p.lon", "p.lat")
    return f"""select od_id, node_seq, round(d, 3) snap_m from (select od_id, node_seq, {d} d, row_number() over (partition by od_id order by {d}, node_seq) n
 from ({RIDES}) q join ({fx.NODES}) p on abs(p.lat-q.{end}_lat) < 0.005e0 and abs(p.lon-q.{end}_lon) < 0.006e0 where {d} <= 500e0) x where n = 1"""


@query("g08_j08_snapped_pairs", f"select q.od_id, a.node_seq src, b.node_seq dst, a.snap_m from_snap_m, b.snap_m to_snap_m from ({RIDES}) q left join ({nearest_node('from')}) a on a.od_id = q.od_id left join ({nearest_node('to')}) b on b.od_id = q.od_id")
def snapped_pairs(spark, d):
    found = roads.snapped_pairs(derive(spark, d, RIDES), derive(spark, d, fx.NODES))
    return found.select("od_id", "src", "dst", metres(F.col("from_snap_m")).alias("from_snap_m"), metres(F.col("to_snap_m")).alias("to_snap_m"))


# --- collections in several systems -------------------------------------------------------------------------------
CUSTOMERS = f"select p.*, c_nationkey nation from ({fx.POI}) p join customer c on c_custkey = poi_id"


@query("p16_s01_mixed_systems", f"select nation, poi_id, round(lon, 7) lon, round(lat, 7) lat from ({CUSTOMERS}) p where nation%4 <> 3 union all select distinct nation, null, null, null from ({CUSTOMERS}) p where nation%4 = 3")
def mixed_systems(spark, d):
    """Each nation's customers as the text of a collection, in geographic or projected coordinates or in a system that nobody knows,
    read back as lon and lat."""
    p = derive(spark, d, CUSTOMERS)
    at = F.when(F.col("nation") % 4 == 1, geo.to_projected(F.col("lon"), F.col("lat"), 5186)).when(F.col("nation") % 4 == 2, geo.to_projected(F.col("lon"), F.col("lat"), 5179)).otherwise(geo.point(F.col("lon"), F.col("lat")))
    one = F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("POI"), F.col("poi_id").cast("string")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(at["x"], at["y"]).alias("coordinates")).alias("geometry"))
    crs = F.when(F.col("nation") % 4 > 0, F.struct(F.lit("name").alias("type"), F.struct(F.concat(F.lit("urn:ogc:def:crs:EPSG::"), F.element_at(F.array(F.lit("5186"), F.lit("5179"), F.lit("9999")), (F.col("nation") % 4).cast("int"))).alias("name")).alias("properties")))
    text = p.groupBy("nation").agg(F.collect_list(one).alias("features")).select(F.col("nation").cast("string").alias("path"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), "features")).alias("value"))
    found, _ = vector.collections(text)
    there, unknown = vector.in_wgs84(found)
    spot = F.get(F.get("parts", 0), 0)
    rows = there.select(F.col("path").cast("long").alias("nation"), F.col("attrs")["poi"].cast("long").alias("poi_id"), F.round(spot["x"], 7).alias("lon"), F.round(spot["y"], 7).alias("lat"))
    none = F.lit(None)
    return rows.unionByName(unknown.select(F.col("path").cast("long").alias("nation"), none.cast("long").alias("poi_id"), none.cast("double").alias("lon"), none.cast("double").alias("lat")))


# --- more of the catalogue and the rules ----------------------------------------------------------------------------
@query("c08_history", f"select dataset, version_no, to_status, changed_at, lag(to_status) over (partition by dataset, version_no order by changed_at) from_status from ({fx.STATUS_EVENTS}) e")
def status_history(spark, d):
    e = derive(spark, d, fx.STATUS_EVENTS.replace("varchar(20)", "string"))
    return catalog.history(e, e.select("dataset", "version_no")).select("dataset", "version_no", "to_status", "changed_at", "from_status")


@query("c13_current_status", f"select dataset, version_no, to_status status from (select *, row_number() over (partition by dataset, version_no order by changed_at desc, to_status desc) n from ({fx.STATUS_EVENTS}) e) x where n = 1")
def current_status(spark, d):
    return catalog.current(derive(spark, d, fx.STATUS_EVENTS))


@query("c12_messages", f"select dataset, version_no, case when status in ('FAILED', 'REJECTED') then checksum end error_message from ({fx.VERSIONS}) v")
def messages(spark, d):
    v = versions(spark, d).withColumn("error_message", F.col("checksum"))
    return catalog.with_message(v).select("dataset", "version_no", "error_message")


@query("a17_u03_blocking_reasons", f"""
with v as ({fx.VERSIONS}), twice as (select distinct a.dataset, a.version_no from v a where exists (select 1 from v b where b.dataset = a.dataset and b.checksum = a.checksum and b.version_no <> a.version_no and b.status <> 'REJECTED'))
select dataset, version_no, 'REJECTED' status, 'DUPLICATE_FILE: same file as another version' reason from twice""")
def blocking_reasons(spark, d):
    return quality.decide(quality.duplicates(versions(spark, d)))


@query("p18_p17_pixel_sizes", "select o_orderkey, abs(g1) x, abs(g5) y, round(case when o_orderkey%2 = 0 then abs(g1)*111320e0*cos(radians(lat)) else abs(g1)*unit end, 6) metres from (select o_orderkey, (o_orderkey%7-3)/1000e0 g1, (o_orderkey%5-2)/1000e0 g5, (o_orderkey%90)*1e0 lat, 0.3048e0 unit from orders) o")
def pixel_sizes(spark, d):
    o = derive(spark, d, "select o_orderkey, (o_orderkey%7-3)/1000e0 g1, (o_orderkey%5-2)/1000e0 g5, (o_orderkey%90)*1e0 lat, 0.3048e0 unit from orders")
    gt = F.array(F.lit(0.0), F.col("g1"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("g5"))
    size = geo.pixel_size(gt)
    return o.select("o_orderkey", size["x"].alias("x"), size["y"].alias("y"), F.round(geo.resolution_m(gt, F.col("o_orderkey") % 2 == 0, F.col("lat"), F.col("unit")), 6).alias("metres"))


@query("a24_errors_by_severity", f"with r as (select o_custkey dataset, o_orderkey version_no, case when o_orderkey%9 = 0 then null else (o_orderkey%2000)/1e0 end res, case when o_orderkey%11 = 0 then ' ' else 'WKT' end srs from orders) select dataset, version_no, 'RASTER_CRS' rule_code from r where trim(srs) = '' union all select dataset, version_no, 'RASTER_GEOREFERENCE' from r")
def errors_only(spark, d):
    return quality.of_severity(quality.run(derive(spark, d, RASTERS)).where(F.col("rule_code") != "RASTER_NODATA_RATIO"), ["ERROR"]).select("dataset", "version_no", "rule_code")


@query("t03_boxes_by_name", f"select q.qid, b.dataset, b.fid, cast(row_number() over (partition by q.qid order by b.dataset, b.fid) as int) place from ({fx.SEARCH}) q, ({fx.BOXES}) b where qminx <= maxx and qmaxx >= minx and qminy <= maxy and qmaxy >= miny")
def boxes_by_name(spark, d):
    return spatial.boxes_by_name(derive(spark, d, fx.SEARCH), derive(spark, d, fx.BOXES), ["dataset", "fid"])


# --- routes from depots: few sources, so that SQL ends at any size that it is run at ------------------------------
SLOPE_COST = f"""
select mode, edge_id, src, dst, cost from ({COST}) c where mode = 'CAR'
union all
select mode, edge_id, src, dst, len/(case mode when 'WALK' then 6e0*exp(-3.5e0*abs(up+0.05e0)) else case when up >= 0 then greatest(3e0, 15e0*(1-8*up)) else least(30e0, 15e0*(1-4*up)) end end/3.6e0)
from (select *, greatest(-1e0, least(1e0, ({fx.HEIGHT.format(node="dst")}-({fx.HEIGHT.format(node="src")}))/len)) up from (
    select link_id*2 edge_id, from_node src, to_node dst, len from lk where road_class <> 'motorway' union all select link_id*2+1, to_node, from_node, len from lk where road_class <> 'motorway') w) u, (select 'WALK' as mode union all select 'BIKE') m"""
DEPOT_SEARCH = SEARCH.replace(f"({COST})", "({cost})").replace(f"({fx.OD})", "({od})")
SNAPPED_RIDES = f"select q.*, a.node_seq src, b.node_seq dst from ({fx.DEPOT_RIDES}) q left join ({nearest_node('from').replace(RIDES, fx.DEPOT_RIDES)}) a on a.od_id = q.od_id left join ({nearest_node('to').replace(RIDES, fx.DEPOT_RIDES)}) b on b.od_id = q.od_id"
BEST = "best on best.src = od.src and best.mode = od.mode and best.node = od.dst"


@query("g04_j15_depot_times", DEPOT_SEARCH.format(cost=COST, od=fx.DEPOT_OD) + f"select od.od_id, round(best.g, 4) cost from od left join {BEST}")
def depot_times(spark, d):
    _, _, cost = search_input(spark, d)
    od = derive(spark, d, fx.DEPOT_OD)
    return od.join(roads.times(od, cost), "od_id", "left").select("od_id", F.round("g", 4).alias("cost"))


@query("g08_g09_depot_routes", DEPOT_SEARCH.format(cost=SLOPE_COST, od=SNAPPED_RIDES) + f"""
select od.od_id, case when od.src is null or od.dst is null then 'UNSNAPPED' when best.g is null then 'NO_PATH' else 'OK' end status, round(best.g, 4) duration_s, case when best.g is not null and od.src <> od.dst then round(best.g, 4) end steps_s,
  case when best.g is not null and od.src <> od.dst then od.src end first_node, case when best.g is not null and od.src <> od.dst then od.dst end last_node,
  case when best.g is not null then round({fx.HEIGHT.format(node="od.dst")}-({fx.HEIGHT.format(node="od.src")}), 6)+0e0 end climb_m
from od left join {BEST}""")
def depot_routes(spark, d):
    """Durations against SQL's; the edges of each route add up to it, join each other from one end to the other, and climb what its ends differ."""
    nodes, links = derive(spark, d, fx.NODES), grid_links(spark, d)
    heights = nodes.select("node_seq", F.expr(fx.HEIGHT.format(node="node_seq")).alias("z"))
    headers, _, steps = roads.routed(derive(spark, d, fx.DEPOT_RIDES), links, nodes, heights)
    cost = roads.costs(roads.edges(links, heights))
    modes = derive(spark, d, fx.DEPOT_RIDES).select(F.col("od_id").alias("route_id"), "mode")
    walked = steps.join(modes, "route_id").join(cost, ["edge_id", "mode"])
    ends = walked.groupBy("route_id").agg(F.sum("cost").alias("steps_s"), F.max_by("src", "back").alias("first_node"), F.min_by("dst", "back").alias("last_node"))
    w = W.partitionBy("route_id").orderBy(F.desc("back"))
    torn = walked.withColumn("before", F.lag("dst").over(w)).where("before <> src").select("route_id").distinct()
    out = headers.join(ends, "route_id", "left").join(torn.withColumn("torn", F.lit(True)), "route_id", "left")
    near = lambda c: F.when(F.col("torn").isNull(), F.col(c))
    return out.select("od_id", "status", F.round("duration_s", 4).alias("duration_s"), F.round("steps_s", 4).alias("steps_s"), near("first_node").alias("first_node"), near("last_node").alias("last_node"), (F.round(F.col("ascent_m") - F.col("descent_m"), 6) + 0.0).alias("climb_m"))


TOP_SPEED = f"case od.mode when 'CAR' then (select greatest(1e0, coalesce(max({SPEED}), 1e0))/3.6e0 from lk where road_class <> 'footway') when 'WALK' then 6e0/3.6e0 else 30e0/3.6e0 end"
COMPARED = DEPOT_SEARCH.format(cost=COST, od=fx.DEPOT_OD) + f""", top as (select od.od_id, {TOP_SPEED} v from od),
goal as (select od.od_id, od.src, od.mode, od.dst, best.g, t.v, p.lon, p.lat, {hav('o.lon', 'o.lat', 'p.lon', 'p.lat')} distance_m from od join {BEST} join top t on t.od_id = od.od_id join ({fx.NODES}) p on p.node_seq = od.dst join ({fx.NODES}) o on o.node_seq = od.src),
pairs as (
  select x.od_id, any_value(x.distance_m) distance_m, any_value(x.g) cost, 1+count(case when b.g < x.g-1e-6 then 1 end) nodes_a, 1+count(case when b.g+{hav('n.lon', 'n.lat', 'x.lon', 'x.lat')}/x.v < x.g-1e-6 then 1 end) nodes_b
  from goal x join best b on b.src = x.src and b.mode = x.mode and b.g < x.g join ({fx.NODES}) n on n.node_seq = b.node group by x.od_id
  union all select od_id, distance_m, g, 1, 1 from goal where src = dst)
"""


def depot_compared(spark, d):
    _, e, cost = search_input(spark, d)
    return roads.compared(derive(spark, d, fx.DEPOT_OD), cost, derive(spark, d, fx.NODES), roads.max_speed_mps(e))


@query("g10_a21_g07_depot_compared", COMPARED + "select od_id, round(cost, 4) as cost_a, round(cost, 4) as cost_b, true as same_cost, nodes_a, nodes_b, round(nodes_b*1e0/nodes_a, 9) ratio from pairs")
def settled_by_pair(spark, d):
    c = depot_compared(spark, d)
    return c.select("od_id", F.round("cost_a", 4).alias("cost_a"), F.round("cost_b", 4).alias("cost_b"), "same_cost", "nodes_a", "nodes_b", F.round("ratio", 9).alias("ratio"))


@query("a22_g10_depot_report", COMPARED + """, q as (select case when distance_m < 2000 then '0-2 km' when distance_m < 5000 then '2-5 km' when distance_m < 20000 then '5-20 km' end bucket, * from pairs)
select coalesce(bucket, 'total') bucket, count(*) n_pairs, round(avg(nodes_a), 6) mean_nodes_a, round(avg(nodes_b), 6) mean_nodes_b, list_sort(list(nodes_a))[cast(floor(count(*)*0.5e0) as int)+1] p50_nodes_a, list_sort(list(nodes_b))[cast(floor(count(*)*0.95e0) as int)+1] p95_nodes_b, 0::bigint mismatches
from q where bucket is not null group by rollup(bucket)""")
def depot_report(spark, d):
    return roads.comparison(materialize(depot_compared(spark, d), "compared")).withColumn("mean_nodes_a", F.round("mean_nodes_a", 6)).withColumn("mean_nodes_b", F.round("mean_nodes_b", 6))


@query("g12_one_to_all", DEPOT_SEARCH.format(cost=COST, od=fx.DEPOT_OD) + "select src, mode, node, round(g, 4) g from best")
def one_to_all(spark, d):
    _, _, cost = search_input(spark, d)
    return roads.one_to_all(derive(spark, d, fx.DEPOT_OD), cost).select("src", "mode", "node", F.round("g", 4).alias("g"))
