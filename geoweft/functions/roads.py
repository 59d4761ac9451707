"""Attributes and business rules of roads and points of interest as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute names, road classes, speeds.
ROAD_ATTRS = {
    "source_id": ["link_id", "id", "osm_id"],
    "road_class": ["road_class", "highway", "road_rank", "class"],
    "road_name": ["name", "road_name"],
    "oneway": ["oneway", "one_way"],
    "max_speed": ["max_speed", "maxspeed", "max_spd", "speed"],
}
POI_ATTRS = {
    "source_id": ["id", "poi_id"],
    "name": ["name", "poi_name", "title"],
    "category": ["category", "amenity", "shop", "type"],
    "address": ["address", "addr", "addr:full", "road_address"],
}
WIDTHS = {"source_id": 64, "road_class": 30, "road_name": 200, "name": 200, "category": 50, "address": 300}
CAR_FORBIDDEN = ["footway", "pedestrian", "path", "steps", "cycleway", "corridor", "bridleway"]
WALK_FORBIDDEN = ["motorway", "motorway_link", "trunk", "trunk_link", "101", "102"]
BIKE_FORBIDDEN = [*WALK_FORBIDDEN, "steps"]
CAR_SPEED_KPH = {
    100: ["motorway", "101"],
    80: ["trunk", "102"],
    60: ["motorway_link", "primary", "103"],
    50: ["trunk_link", "secondary", "104"],
    40: ["tertiary", "105", "106"],
    30: ["residential", "unclassified", "107"],
    20: ["living_street", "service", "track", "108"],
}
DEFAULT_KPH, WALK_MAX_KPH, BIKE_BASE_KPH, BIKE_MIN_KPH, BIKE_MAX_KPH = 30, 6.0, 15.0, 3.0, 30.0
EXTENSIONS = {"RASTER": [".tif", ".tiff"], "ROAD_NETWORK": [".geojson", ".json", ".zip", ".gpkg"], "POI": [".geojson", ".json", ".zip", ".gpkg"]}


def truncated(v: Column, width: int) -> Column:
    return F.substring(v, 1, width)


def blank_to_null(v: Column) -> Column:
    return F.nullif(F.trim(v), F.lit(""))


def attr(attrs: Column, names: list[str]) -> Column:
    """The first of the named attributes that is not blank, trimmed."""
    return F.coalesce(*[blank_to_null(attrs[n]) for n in names])


def lower_keys(attrs: Column) -> Column:
    return F.transform_keys(attrs, lambda k, _: F.lower(k))


def direction(v: Column) -> Column:
    v = F.lower(F.trim(v))
    return F.when(v.isin("yes", "true", "1", "y", "t", "forward"), "FORWARD").when(v.isin("-1", "reverse", "backward"), "REVERSE").otherwise("BOTH")


def speed_kph(v: Column) -> Column:
    """First number of the text, miles turned to kilometres, halves upward; null unless positive."""
    v = F.lower(F.trim(v))
    n = F.nullif(F.regexp_extract(v, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    kph = F.floor(F.when(v.contains("mph"), n * 1.609344).otherwise(n) + 0.5)
    return F.when((kph > 0) & (kph < 2**31), kph.cast("int"))


def normal_class(v: Column) -> Column:
    return F.lower(F.trim(F.coalesce(v, F.lit(""))))


def car_allowed(v: Column) -> Column:
    return ~normal_class(v).isin(CAR_FORBIDDEN)


def walk_allowed(v: Column) -> Column:
    return ~normal_class(v).isin(WALK_FORBIDDEN)


def bike_allowed(v: Column) -> Column:
    return ~normal_class(v).isin(BIKE_FORBIDDEN)


def car_speed_kph(road_class: Column, max_speed: Column) -> Column:
    kph = F.when(max_speed > 0, max_speed)
    for speed, classes in CAR_SPEED_KPH.items():
        kph = kph.when(normal_class(road_class).isin(classes), speed)
    return kph.otherwise(DEFAULT_KPH)


def tobler_kph(slope: Column) -> Column:
    return WALK_MAX_KPH * F.exp(-3.5 * F.abs(slope + 0.05))


def bike_kph(slope: Column) -> Column:
    up, down = BIKE_BASE_KPH * (1 - 8 * slope), BIKE_BASE_KPH * (1 - 4 * slope)
    return F.when(slope >= 0, F.when(up < BIKE_MIN_KPH, BIKE_MIN_KPH).otherwise(up)).otherwise(F.when(down > BIKE_MAX_KPH, BIKE_MAX_KPH).otherwise(down))


def mps(kph: Column) -> Column:
    return kph / 3.6


def edge_cost(mode: str, length: Column, road_class: Column, max_speed: Column, slope: Column, car: Column) -> Column:
    """Seconds along an edge; null where the mode may not pass."""
    if mode == "CAR":
        return F.when(car, length / mps(car_speed_kph(road_class, max_speed)))
    if mode == "WALK":
        return F.when(walk_allowed(road_class), length / mps(tobler_kph(slope)))
    if mode == "BIKE":
        return F.when(bike_allowed(road_class), length / mps(bike_kph(slope)))
    raise ValueError(f"unknown mode {mode}")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def allowed_extension(kind: Column, name: Column) -> Column:
    found = F.lit(False)
    for k, names in EXTENSIONS.items():
        found = F.when(kind == k, extension(name).isin(names)).otherwise(found)
    return found


def percent(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100)
