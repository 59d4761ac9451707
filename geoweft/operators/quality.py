"""Quality rules: measurements per (dataset, version_no) in, one report row per rule out.

A rule is (code, dataset types, Column of struct<severity, passed, message>); others can be registered. Severity is
INFO for a pass, WARN (passed) or ERROR (blocking)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.functions import geo
from geoweft.functions.roads import percent

KEY = ["dataset", "version_no"]
RULES: list[tuple[str, list[str], Column]] = []


def _result(severity: str, message: Column | str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(severity).alias("severity"), F.lit(severity != "ERROR").alias("passed"), message.alias("message"))


def ok(message) -> Column:
    return _result("INFO", message)


def warn(message) -> Column:
    return _result("WARN", message)


def error(message) -> Column:
    return _result("ERROR", message)


def area(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    west, east, south, north = geo.SERVICE_AREA
    meets = (minx <= east) & (maxx >= west) & (miny <= north) & (maxy >= south)
    within = (minx >= west) & (maxx <= east) & (miny >= south) & (maxy <= north)
    return F.when(minx.isNull(), ok("no extent, not checked")).when(~meets, error("outside the service area")).when(~within, warn("partly outside the service area")).otherwise(ok("within the service area"))


def default_rules() -> list[tuple[str, list[str], Column]]:
    c = F.col
    ratio, res = c("nodata_ratio"), c("resolution_m")
    bad, n = c("n_invalid"), c("n_features")
    vector = ["ROAD_NETWORK", "POI"]
    return [
        ("RASTER_CRS", ["RASTER"], F.when(~geo.has_crs(c("srs")), error("no reference system")).otherwise(ok(F.coalesce(F.concat(F.lit("EPSG:"), c("epsg").cast("string")), F.lit("reference system without EPSG code"))))),
        ("RASTER_GEOREFERENCE", ["RASTER"], F.when(~geo.is_georeferenced(c("gt")), error("no geotransform")).otherwise(ok("geotransform present"))),
        ("WITHIN_SERVICE_AREA", ["RASTER", *vector], area(c("minx"), c("miny"), c("maxx"), c("maxy"))),
        ("RASTER_NODATA_RATIO", ["RASTER"], F.when(ratio.isNull(), ok("not checked")).when(ratio >= 0.999, error(F.concat(F.lit("no valid pixels, NoData "), percent(ratio)))).when(ratio > 0.5, warn(F.concat(F.lit("much NoData: "), percent(ratio)))).otherwise(ok(F.concat(F.lit("NoData "), percent(ratio))))),
        ("RASTER_RESOLUTION", ["RASTER"], F.when(res.isNull(), ok("not checked")).when(~res.between(0.05, 1000), warn(F.format_string("unusual resolution %.3f m", res))).otherwise(ok(F.format_string("resolution %.3f m", res)))),
        ("GEOMETRY_TYPE", vector, F.when(F.coalesce(n, F.lit(0)) == 0, error("no features")).when(c("n_mismatched") == n, error("no features of the expected type")).when(c("n_mismatched") > 0, warn(F.format_string("%d features of another type are left out", c("n_mismatched")))).otherwise(ok("all features of the expected type"))),
        ("GEOMETRY_VALID", vector, F.when(F.coalesce(n, F.lit(0)) == 0, ok("no features, not checked")).when(bad / n > 0.01, error(F.concat(F.lit("invalid geometries: "), percent(bad / n)))).when(bad > 0, warn(F.format_string("%d invalid geometries are left out", bad))).otherwise(ok("all geometries valid"))),
        ("ROAD_CONNECTIVITY", ["ROAD_NETWORK"], F.when(F.coalesce(c("n_links"), F.lit(0)) == 0, error("no links can be made")).when(c("largest_ratio") < 0.95, warn(F.format_string("broken network, %d components", c("n_components")))).otherwise(ok(F.format_string("%d components", c("n_components"))))),
        ("ROAD_ATTRIBUTES", ["ROAD_NETWORK"], F.when(F.coalesce(c("n_links"), F.lit(0)) == 0, ok("no links, not checked")).when((c("n_no_speed") / c("n_links") > 0.5) | (c("n_no_class") > 0), warn(F.concat(F.lit("missing speed "), percent(c("n_no_speed") / c("n_links")), F.lit(", class "), percent(c("n_no_class") / c("n_links"))))).otherwise(ok("attributes present"))),
        ("POI_NAME", ["POI"], F.when(F.coalesce(n, F.lit(0)) == 0, ok("no features, not checked")).when(c("n_nameless") / n > 0.5, error(F.concat(F.lit("places without name: "), percent(c("n_nameless") / n)))).when(c("n_nameless") > 0, warn(F.format_string("%d places without name", c("n_nameless")))).otherwise(ok("all places have names"))),
    ]


#: Measurements that rules may ask for; those a table doesn't have count as null.
MEASURES = {
    "srs": "string", "epsg": "int", "gt": "array<double>", "minx": "double", "miny": "double", "maxx": "double", "maxy": "double", "nodata_ratio": "double", "resolution_m": "double",
    "n_features": "long", "n_mismatched": "long", "n_invalid": "long", "n_links": "long", "largest_ratio": "double", "n_components": "long", "n_no_speed": "long", "n_no_class": "long", "n_nameless": "long",
}


def run(measured: DataFrame, rules: list | None = None) -> DataFrame:
    """dataset, version_no, place, rule_code, severity, passed, message; measured has dataset, version_no, type."""
    for name, kind in MEASURES.items():
        if name not in measured.columns:
            measured = measured.withColumn(name, F.lit(None).cast(kind))
    rows = [F.when(F.col("type").isin(types), F.struct(F.lit(i).alias("place"), F.lit(code).alias("rule_code"), r.alias("r"))) for i, (code, types, r) in enumerate(rules or default_rules() + RULES)]
    found = measured.select(*KEY, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x"))
    return found.select(*KEY, "x.place", "x.rule_code", "x.r.severity", "x.r.passed", "x.r.message")


def unreadable(files: DataFrame) -> DataFrame:
    """One blocking READABLE row for each (dataset, version_no) whose input can't be read, and no other."""
    return files.select(*KEY, F.lit(0).alias("place"), F.lit("READABLE").alias("rule_code"), F.lit("ERROR").alias("severity"), F.lit(False).alias("passed"), F.lit("unreadable file").alias("message"))


def duplicates(versions: DataFrame) -> DataFrame:
    """One blocking DUPLICATE_FILE row for each version whose checksum another, not rejected one of its dataset has."""
    from geoweft.operators.catalog import duplicate_versions

    return duplicate_versions(versions).select(*KEY, F.lit(99).alias("place"), F.lit("DUPLICATE_FILE").alias("rule_code"), F.lit("ERROR").alias("severity"), F.lit(False).alias("passed"), F.lit("same file as another version").alias("message"))


def of_severity(report: DataFrame, severities: list[str]) -> DataFrame:
    """Rows of a report by severity, in its order of rules."""
    return report.where(F.col("severity").isin(severities))


def decide(report: DataFrame) -> DataFrame:
    """dataset, version_no, status (REJECTED with any error, else VALIDATED) and the joined reasons."""
    bad = F.col("severity") == "ERROR"
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("place", "rule_code", "message")))), lambda r: F.concat_ws(": ", r["rule_code"], r["message"])), " / ")
    return report.groupBy(*KEY).agg(F.when(F.bool_or(bad), "REJECTED").otherwise("VALIDATED").alias("status"), F.substring(F.nullif(reasons, F.lit("")), 1, 1000).alias("reason"))


def poi_measures(features: DataFrame) -> DataFrame:
    """features: dataset, version_no, geom_type, lon, lat, name."""
    valid = F.coalesce(geo.in_lon_lat_range(F.col("lon"), F.col("lat")), F.lit(False))
    return features.groupBy(*KEY).agg(
        F.lit("POI").alias("type"), F.count(F.lit(1)).alias("n_features"), F.count_if(~F.coalesce(F.col("geom_type") == "Point", F.lit(False))).alias("n_mismatched"), F.count_if(~valid).alias("n_invalid"),
        F.count_if(F.coalesce(F.trim("name"), F.lit("")) == "").alias("n_nameless"), F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"),
    )


def bounds(features: DataFrame) -> DataFrame:
    """dataset, version_no and the extent of lines (line: array<struct<x, y>>); a side of no width gets 1e-6 on both sides."""
    xs, ys = F.transform("line", lambda p: p["x"]), F.transform("line", lambda p: p["y"])
    b = features.groupBy(*KEY).agg(F.min(F.array_min(xs)).alias("minx"), F.min(F.array_min(ys)).alias("miny"), F.max(F.array_max(xs)).alias("maxx"), F.max(F.array_max(ys)).alias("maxy"))
    flat = (F.col("minx") == F.col("maxx")) | (F.col("miny") == F.col("maxy"))
    pad = F.when(flat, 1e-6).otherwise(0.0)
    return b.withColumns({"minx": F.col("minx") - pad, "miny": F.col("miny") - pad, "maxx": F.col("maxx") + pad, "maxy": F.col("maxy") + pad})
