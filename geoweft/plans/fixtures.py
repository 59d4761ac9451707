"""Geodata derived by arithmetic from the star-schema tables, as SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.operators import raster
from geoweft.tables import table


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"2e0*6371008.8e0*asin(sqrt(pow(sin(radians({lat2}-({lat1}))/2e0),2e0)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-({lon1}))/2e0),2e0)))"


POI = "select c_custkey poi_id, c_name name, c_mktsegment category, 126.95e0+((c_custkey*7919)%15000)/100000e0 lon, 37.45e0+((c_custkey*104729)%12000)/100000e0 lat from customer"
POINTS = "select s_suppkey qid, 126.95e0+((s_suppkey*6151)%15000)/100000e0 lon, 37.45e0+((s_suppkey*3571)%12000)/100000e0 lat from supplier"
#: Every part is a node: rows of n nodes, the last one perhaps not full.
GRID = "select cast(ceil(sqrt(count(*))) as int) n, count(*) parts from part"
LINKS = f"""
select k*2+dir link_id, r*n+c from_node, case when dir=0 then r*n+c+1 else (r+1)*n+c end to_node, k, dir, r, c, n,
       case ((k*2699+dir*9973)%1019)%5 when 0 then 'primary' when 1 then 'secondary' when 2 then 'residential' when 3 then 'footway' else 'motorway' end road_class,
       cast(20+p_size as int) max_speed_kph, ((k*6151+dir*3571)%1013)%5 = 0 oneway,
       127.020e0+c*0.001e0 lon1, 37.490e0+r*0.001e0 lat1,
       127.020e0+(case when dir=0 then c+1 else c end)*0.001e0 lon2, 37.490e0+(case when dir=0 then r else r+1 end)*0.001e0 lat2
from (select p_partkey k, p_size, n, dir, cast(floor(p_partkey/n) as bigint) r, p_partkey%n c, parts from part, ({GRID}) g, (select 0 dir union all select 1 dir) d) x
where not (dir=0 and (c=n-1 or k+1>=parts)) and not (dir=1 and k+n>=parts) and ((k*7919+dir*104729)%1009)%10 <> 0"""
NODES = f"select p_partkey node_seq, 127.020e0+(p_partkey%n)*0.001e0 lon, 37.490e0+cast(floor(p_partkey/n) as bigint)*0.001e0 lat from part, ({GRID}) g"
ISLANDS = f"select * from ({LINKS}) l where not (dir=0 and c%7=6)"
OD = f"select o_orderkey od_id, (o_orderkey*31)%parts src, (o_custkey*17+o_orderkey)%parts dst, case o_orderkey%3 when 0 then 'CAR' when 1 then 'WALK' else 'BIKE' end mode from orders, ({GRID}) g"
#: Every order from its depot: as many sources as suppliers.
DEPOT_OD = f"select o_orderkey od_id, ((o_custkey%s)*7919)%parts src, (o_custkey*17+o_orderkey)%parts dst, case o_orderkey%3 when 0 then 'CAR' when 1 then 'WALK' else 'BIKE' end mode from orders, (select count(*) s from supplier) x, ({GRID}) g"
#: The same from coordinates, some of them too far from any node.
DEPOT_RIDES = """
select o_orderkey od_id, case o_orderkey%3 when 0 then 'CAR' when 1 then 'WALK' else 'BIKE' end mode, 127.018e0+((o_custkey%s)*7919)%2400/100000e0 from_lon, 37.488e0+((o_custkey%s)*104729)%2300/100000e0 from_lat,
  127.012e0+(o_orderkey*6151)%3000/100000e0 to_lon, 37.484e0+(o_orderkey*3571)%2700/100000e0 to_lat from orders, (select count(*) s from supplier) x"""
HEIGHT = "50e0+(({node}*37)%101)/20e0"
LINES = """
select line_id, seq, 126.955e0+((line_id*37)%100)/1000e0+(seq%20)*0.001e0 lon, 37.46e0+((line_id*53)%100)/1000e0+((event_id*31)%7)*0.0005e0 lat
from (select user_id line_id, event_id, row_number() over (partition by user_id order by ts, event_id)-1 seq from events) x"""
BOXES = """
select o_orderkey fid, o_custkey dataset, minx, miny, minx+0.001e0*(1+o_orderkey%5) maxx, miny+0.001e0*(1+o_orderkey%3) maxy
from (select o_orderkey, o_custkey, 126.95e0+((o_orderkey*7919)%15000)/100000e0 minx, 37.45e0+((o_orderkey*104729)%12000)/100000e0 miny from orders) x"""
SEARCH = f"select qid, lon-0.005e0 qminx, lat-0.005e0 qminy, lon+0.005e0 qmaxx, lat+0.005e0 qmaxy from ({POINTS}) p"
VERSIONS = """
select o_custkey dataset, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) version_no, cast(cast(floor(o_totalprice/5000e0) as bigint) as varchar(20)) checksum,
       case o_orderstatus when 'F' then 'REJECTED' when 'O' then 'ARCHIVED' else 'PUBLISHED' end status, o_orderdate changed_at, o_orderkey
from orders"""
#: Footprints of versions by point: rotated squares, every second one with a hole, every seventh of two parts.
_RINGS = [(0, 0, [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 0)]), (0, 1, [(0.5, 0), (0, -0.5), (-0.5, 0), (0, 0.5), (0.5, 0)]), (1, 0, [(4, 0), (3, 1), (2, 0), (3, -1), (4, 0)])]
_RING_ROWS = " union all ".join(f"select {p} part, {r} ring, {i} seq, {float(x)}e0 ux, {float(y)}e0 uy" for p, r, ring in _RINGS for i, (x, y) in enumerate(ring))
FOOTPRINTS = f"""
select o_orderkey fid, o_custkey dataset, part, ring, seq, cx+w*ux x, cy+h*uy y
from (select o_orderkey, o_custkey, 126.95e0+((o_orderkey*7919)%15000)/100000e0 cx, 37.45e0+((o_orderkey*104729)%12000)/100000e0 cy, 0.001e0*(1+o_orderkey%5) w, 0.001e0*(1+o_orderkey%3) h from orders) o, ({_RING_ROWS}) t
where (ring=0 or o_orderkey%2=0) and (part=0 or o_orderkey%7=0)"""
#: Boxes of a supplier: a wide and a narrow one, and one for each order that starts where its footprint's right tip ends.
POLYGON_SEARCH = f"""
select qid*2+k qid, lon-r qminx, lat-r qminy, lon+r qmaxx, lat+r qmaxy from ({POINTS}) p, (select 0 k, 0.005e0 r union all select 1 k, 0.0004e0 r) t
union all
select 10000000+fid, x, y-0.0001e0, x+0.0002e0, y+0.0001e0 from ({FOOTPRINTS}) f where part=0 and ring=0 and seq=0"""
#: One shape an order, some of each way to be wrong; places are eighths, so that nothing is rounded.
_BAD = [
    [(0, 0, "0 0,8 0,8 8,0 8,0 0"), (0, 1, "2 2,2 4,4 4,4 2,2 2")],
    [(0, 0, "0 0,8 0,8 8,0 8,0 0"), (0, 1, "9 2,9 4,11 4,11 2,9 2")],
    [(0, 0, "0 0,8 0,8 8,0 8,0 0"), (0, 1, "6 2,6 4,10 4,10 2,6 2")],
    [(0, 0, "0 0,8 0,8 8,0 8,0 0"), (0, 1, "1 1,1 5,5 5,5 1,1 1"), (0, 2, "2 2,2 3,3 3,3 2,2 2")],
    [(0, 0, "0 0,8 8,8 0,0 8,0 0")],
    [(0, 0, "0 0,8 0,8 8,0 8,0 1")],
    [(0, 0, "0 0,8 0,8 8,0 8,0 0"), (1, 0, "16 0,24 0,24 8,16 8,16 0")],
    [(0, 0, "0 0,8 0,8 8,0 8,0 0"), (1, 0, "2 2,4 2,4 4,2 4,2 2")],
    [(0, 0, "0 0,8 0,8 8,0 8,0 0"), (0, 1, "2 2,2 6,6 6,6 2,2 2"), (1, 0, "3 3,5 3,5 5,3 5,3 3")],
    [(0, 0, "0 0,8 0,8 8,0 8,0 0"), (0, 1, "0 4,4 2,4 6,0 4")],
    [(0, 0, "0 0,8 0,8 0,0 0")],
]
SHAPES = "select o_orderkey fid, part, ring, seq, ((o_orderkey*7919)%997+ux*(1+o_orderkey%3))/8e0 x, ((o_orderkey*104729)%991+uy*(1+o_orderkey%3))/8e0 y from orders o, (" + " union all ".join(
    f"select {k} kind, {part} part, {ring} ring, {i} seq, {x} ux, {y} uy" for k, rings in enumerate(_BAD) for part, ring, line in rings for i, (x, y) in enumerate(p.split() for p in line.split(","))) + f") t where o_orderkey%{len(_BAD)}=kind"
#: Every line of an order is an event of one of its two versions.
STATUS_EVENTS = """
select l_orderkey dataset, cast(l_linenumber%2+1 as int) version_no, cast(l_linenumber as bigint)*1000000000+l_partkey*1000+l_suppkey changed_at,
       case (l_orderkey+l_linenumber*3)%8 when 0 then 'UPLOADED' when 1 then 'VALIDATING' when 2 then 'VALIDATED' when 3 then 'REJECTED' when 4 then 'PROCESSING' when 5 then 'PROCESSED' when 6 then 'PUBLISHED' else 'ARCHIVED' end to_status
from lineitem"""
DEM_GT = (126.95, 0.0005, 0.0, 37.57, 0.0, -0.0003)


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs derivation SQL over the tables it names."""
    import re

    names = sorted(set(re.findall(r"\b(?:from|join)\s+(customer|supplier|part|orders|lineitem|events)\b|,\s*(customer|supplier|part|orders)\s*,", sql)))
    used = {n for pair in names for n in pair if n}
    for n in used:
        sql = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in used})


def dem(spark: SparkSession, size: int = 128) -> tuple[DataFrame, DataFrame]:
    """(tiles, meta) of the 400 by 400 elevation model 50 + col / 2 + row / 4, its upper left corner without data."""
    p = spark.range(160_000).select(F.lit("dem").alias("dataset"), F.lit(0).alias("level"), F.lit(1).alias("band"), (F.col("id") % 400).cast("int").alias("col"), F.floor(F.col("id") / 400).cast("int").alias("row"))
    p = p.withColumn("value", F.when((F.col("col") < 10) & (F.col("row") < 10), -9999.0).otherwise(50.0 + 0.5 * F.col("col") + 0.25 * F.col("row")))
    meta = spark.range(1).select(F.lit("dem").alias("dataset"), F.lit(400).alias("raster_width"), F.lit(400).alias("raster_height"), F.array(*map(F.lit, DEM_GT)).alias("gt"), F.lit(-9999.0).alias("nodata"))
    return raster.tiles_of(p, size), meta


HEAT = "select cast((o_orderkey*7919)%150 as int) px, cast((o_orderkey*104729)%120 as int) py, max(o_totalprice) v from orders group by 1, 2"


def heat(spark: SparkSession, sf_dir: str, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """(tiles, meta) of the highest order price by pixel, in degrees."""
    p = derive(spark, sf_dir, HEAT).select(F.lit("heat").alias("dataset"), F.lit(0).alias("level"), F.lit(1).alias("band"), F.col("px").alias("col"), F.col("py").alias("row"), F.col("v").cast("double").alias("value"))
    meta = p.groupBy("dataset").agg((F.max("col") + 1).alias("raster_width"), (F.max("row") + 1).alias("raster_height")).withColumn("gt", F.array(*map(F.lit, (126.95, 0.001, 0.0, 37.57, 0.0, -0.001)))).withColumns({"nodata": F.lit(-9999.0), "epsg": F.lit(4326)})
    return raster.tiles_of(p, size), meta


#: Four rasters of the highest order price by pixel, alike but for where they lie: straight, rotated and projected ones, and one that lies nowhere.
PLACED = "select o_orderkey%4 kind, cast((o_orderkey*7919)%150 as int) px, cast((o_orderkey*104729)%120 as int) py, max(o_totalprice) v from orders group by 1, 2, 3"
PLACES = [("straight", 4326, "GEOGCS", (126.95, 0.001, 0.0, 37.57, 0.0, -0.001)), ("rotated", 4326, "GEOGCS", (126.95, 0.0008, 0.0003, 37.57, 0.0002, -0.0008)), ("projected", 5186, "PROJCS", (200000.0, 30.0, 0.0, 550000.0, 0.0, -30.0)), ("bare", None, " ", (0.0, 1.0, 0.0, 0.0, 0.0, 1.0))]


def placed(spark: SparkSession, sf_dir: str, size: int = 64) -> tuple[DataFrame, DataFrame]:
    """(tiles, meta) of the four, 150 by 120 pixels or as far as orders reach, in two bands, the second one upside down."""
    name = F.element_at(F.array(*[F.lit(n) for n, *_ in PLACES]), (F.col("kind") + 1).cast("int"))
    p = derive(spark, sf_dir, PLACED).select(name.alias("dataset"), F.lit(0).alias("level"), F.explode(F.array(F.lit(1), F.lit(2))).alias("band"), F.col("px").alias("col"), F.col("py").alias("row"), F.col("v").cast("double").alias("value"))
    rows = spark.createDataFrame([(n, epsg, srs, list(gt)) for n, epsg, srs, gt in PLACES], "dataset string, epsg int, srs string, gt array<double>")
    meta = p.groupBy("dataset").agg((F.max("col") + 1).alias("raster_width"), (F.max("row") + 1).alias("raster_height")).join(F.broadcast(rows), "dataset").withColumn("nodata", F.lit(-9999.0))
    return raster.tiles_of(p.withColumn("value", F.when(F.col("band") == 2, -F.col("value")).otherwise(F.col("value"))), size), meta
