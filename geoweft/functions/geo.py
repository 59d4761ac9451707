"""Geometry as Column expressions: points are lon/lat columns, lines arrays of struct<x, y>."""

from __future__ import annotations

from math import atan, atanh, radians, sin, sinh, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
M_PER_DEG_LAT, M_PER_DEG_LON = 110_574.0, 111_320.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
SERVICE_AREA = (124.0, 132.0, 33.0, 39.0)  # west, east, south, north


def let(value: Column, then) -> Column:
    """then(value) with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Metres on the sphere; null if any input is null."""
    lon1, lat1, lon2, lat2 = (F.col(c) if isinstance(c, str) else c for c in (lon1, lat1, lon2, lat2))
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2.0)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(s > 1, F.lit(1.0)).otherwise(s)))


def _vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int) -> np.ndarray:
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(x))) for x in (lat1, lat2))
    s1, c1, s2, c2, way = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), np.radians(lon2 - lon1)

    def angles(lam):
        ss = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * np.cos(lam)) ** 2)
        cs = s1 * s2 + c1 * c2 * np.cos(lam)
        sa = np.where(ss == 0, 0.0, c1 * c2 * np.sin(lam) / np.where(ss == 0, 1.0, ss))
        ca = 1 - sa * sa
        return ss, cs, sa, ca, np.where(ca == 0, 0.0, cs - 2 * s1 * s2 / np.where(ca == 0, 1.0, ca))

    lam = way
    for _ in range(rounds):
        ss, cs, sa, ca, cm = angles(lam)
        c = WGS84_F / 16 * ca * (4 + WGS84_F * (4 - 3 * ca))
        lam = way + (1 - c) * WGS84_F * sa * (np.arctan2(ss, cs) + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    ss, cs, _, ca, cm = angles(lam)
    u = ca * ((WGS84_A**2 - b**2) / b**2)
    big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    d = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return b * big_a * (np.arctan2(ss, cs) - d)


def spheroid_distance(lon1, lat1, lon2, lat2, rounds: int = 12) -> Column:
    """Metres on the WGS84 spheroid: Vincenty's inverse formula, iterated a fixed number of times, batch by batch; null if any input is null."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        ends = (a, b, c, d)
        missing = np.any([x.is_null().to_numpy(zero_copy_only=False) for x in ends], axis=0)
        with np.errstate(invalid="ignore"):
            return pa.array(_vincenty(*(x.to_numpy(zero_copy_only=False).astype(float) for x in ends), rounds), pa.float64(), mask=missing)

    return run(*((F.col(c) if isinstance(c, str) else c).cast("double") for c in (lon1, lat1, lon2, lat2)))


def point(lon, lat) -> Column:
    return F.struct(lon.alias("x"), lat.alias("y"))


def line_length(line: Column) -> Column:
    n = F.size(line)
    legs = F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"]))
    return F.when(n > 0, F.aggregate(legs, F.lit(0.0), lambda s, d: s + d))


def envelope(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Closed ring; an error where a minimum exceeds its maximum."""
    ring = F.array(point(min_x, min_y), point(max_x, min_y), point(max_x, max_y), point(min_x, max_y), point(min_x, min_y))
    return F.when((min_x > max_x) | (min_y > max_y), F.raise_error(F.lit("envelope: minimum exceeds maximum"))).otherwise(ring)


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def cell_key(cx: Column, cy: Column) -> Column:
    return F.shiftleft(cx.cast("long"), 32).bitwiseOR(cy.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def lon_degrees(metres, lat: Column) -> Column:
    """Degrees of longitude that `metres` can span anywhere within that distance of `lat`."""
    far = F.abs(lat) + metres / M_PER_DEG_LAT
    c = F.cos(F.radians(F.when(far > 90, F.lit(90.0)).otherwise(far)))
    return metres / (M_PER_DEG_LON * F.when(c < 0.01, F.lit(0.01)).otherwise(c))


def snapped(v: Column) -> Column:
    """Place on the 1e-7 degree lattice, halves upward."""
    return F.floor(v * 1e7 + 0.5).cast("long")


def clamp(v: Column, low, high) -> Column:
    return F.when(v < low, low).when(v > high, high).otherwise(v)


def in_lon_lat_range(lon: Column, lat: Column) -> Column:
    return F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def apply_transform(gt: Column, px: Column, py: Column) -> Column:
    return point(gt[0] + gt[1] * px + gt[2] * py, gt[3] + gt[4] * px + gt[5] * py)


def invert_transform(gt: Column) -> Column:
    det = gt[1] * gt[5] - gt[2] * gt[4]
    d = F.when(F.abs(det) < 1e-300, F.raise_error(F.lit("geotransform can't be inverted")).cast("double")).otherwise(det)
    return F.array((gt[2] * gt[3] - gt[0] * gt[5]) / d, gt[5] / d, -gt[2] / d, (gt[0] * gt[4] - gt[1] * gt[3]) / d, -gt[4] / d, gt[1] / d)


def to_pixel(gt: Column, x: Column, y: Column) -> Column:
    """Fractional pixel, (0, 0) at the upper left corner. Rasters that aren't rotated need no inverse, and get no rounding from one."""
    straight = (gt[2] == 0) & (gt[4] == 0) & (gt[1] != 0) & (gt[5] != 0)
    return F.when(straight, point((x - gt[0]) / gt[1], (y - gt[3]) / gt[5])).otherwise(apply_transform(invert_transform(gt), x, y))


def in_raster(px: Column, py: Column, width: Column, height: Column) -> Column:
    return (px >= 0) & (px < width) & (py >= 0) & (py < height)


def is_georeferenced(gt: Column) -> Column:
    return F.coalesce((F.size(gt) == 6) & (gt != F.array(*[F.lit(float(v)) for v in (0, 1, 0, 0, 0, 1)])), F.lit(False))


def has_crs(srs: Column) -> Column:
    return F.coalesce(F.trim(srs) != "", F.lit(False))


def pixel_size(gt: Column) -> Column:
    return F.struct(F.abs(gt[1]).alias("x"), F.abs(gt[5]).alias("y"))


def resolution_m(gt: Column, geographic: Column, lat: Column, linear_unit: Column) -> Column:
    return F.when(geographic, F.abs(gt[1]) * M_PER_DEG_LON * F.cos(F.radians(lat))).otherwise(F.abs(gt[1]) * linear_unit)


def slope(z_from: Column, z_to: Column, length: Column) -> Column:
    return F.when(z_from.isNull() | z_to.isNull() | (length <= 0), F.lit(0.0)).otherwise(clamp((z_to - z_from) / length, F.lit(-1.0), F.lit(1.0)))


def flat_coordinates(line: Column) -> Column:
    """[x0, y0, x1, y1, ...]"""
    return F.flatten(F.transform(line, lambda p: F.array(p["x"], p["y"])))


def is_nodata(v: Column, nodata: Column) -> Column:
    return F.coalesce(F.isnan(v), F.lit(False)) | F.coalesce(v == nodata, F.lit(False)) | v.isNull()


def valid_line(line: Column) -> Column:
    fine = F.forall(line, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < 1e300) & (F.abs(p["y"]) < 1e300))
    return F.coalesce(fine & (F.size(F.array_distinct(line)) >= 2), F.lit(False))


def valid_ring(ring: Column) -> Column:
    """Closed, at least three different corners, finite; no two edges that are not neighbours touch."""
    def cross(o, a, b):
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])

    n = F.size(ring) - 1
    edges = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("i"), F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")))

    def meet(e, f):
        apart = (f["i"] > e["i"] + 1) & ~((e["i"] == 1) & (f["i"] == n))
        one = cross(e["a"], e["b"], f["a"]) * cross(e["a"], e["b"], f["b"])
        two = cross(f["a"], f["b"], e["a"]) * cross(f["a"], f["b"], e["b"])
        return apart & (one <= 0) & (two <= 0) & ~((one == 0) & (two == 0))

    closed = (n >= 3) & (F.get(ring, 0) == F.get(ring, n)) & (F.size(F.array_distinct(ring)) >= 3)
    return F.coalesce(valid_line(ring) & closed & ~F.exists(edges, lambda e: F.exists(edges, lambda f: meet(e, f))), F.lit(False))


#: EPSG code -> (central meridian, latitude of origin, scale, false easting, false northing), all on GRS80. Fixed values.
TRANSVERSE_MERCATOR = {
    5179: (127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0),
    5185: (125.0, 38.0, 1.0, 200_000.0, 600_000.0),
    5186: (127.0, 38.0, 1.0, 200_000.0, 600_000.0),
    5187: (129.0, 38.0, 1.0, 200_000.0, 600_000.0),
    5188: (131.0, 38.0, 1.0, 200_000.0, 600_000.0),
}
_F = 1 / 298.257222101
_N = _F / (2 - _F)
_E = sqrt(_F * (2 - _F))
_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4,
    61 / 240 * _N**3 - 103 / 140 * _N**4,
    49561 / 161280 * _N**4,
]
_BETA = [
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4,
    1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4,
    17 / 480 * _N**3 - 37 / 840 * _N**4,
    4397 / 161280 * _N**4,
]


def _northing_at(lat: float) -> float:
    """Scale-free distance along the meridian from the equator."""
    p = radians(lat)
    t = sinh(atanh(sin(p)) - _E * atanh(_E * sin(p)))
    xi = atan(t)
    return _RADIUS * (xi + sum(a * sin(2 * k * xi) for k, a in enumerate(_ALPHA, 1)))


def to_projected(lon: Column, lat: Column, epsg: int) -> Column:
    """Krüger series; struct<x, y> in metres."""
    lon0, lat0, k0, fe, fn = TRANSVERSE_MERCATOR[epsg]
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))

    def series(p):
        x, y = p["eta"], p["xi"]
        for k, a in enumerate(_ALPHA, 1):
            x = x + a * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"])
            y = y + a * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"])
        return point(fe + k0 * _RADIUS * x, fn + k0 * (_RADIUS * y - _northing_at(lat0)))

    def sphere(q):
        return F.struct(F.atan2(q["t"], F.cos(q["d"])).alias("xi"), F.atanh(F.sin(q["d"]) / F.sqrt(1 + q["t"] * q["t"])).alias("eta"))

    return let(F.struct(t.alias("t"), F.radians(lon - lon0).alias("d")), lambda q: let(sphere(q), series))


def from_projected(x: Column, y: Column, epsg: int) -> Column:
    """struct<x, y> as lon and lat in degrees."""
    lon0, lat0, k0, fe, fn = TRANSVERSE_MERCATOR[epsg]
    return _unprojected(x, y, lon0, _northing_at(lat0), k0, fe, fn)


def _unprojected(x: Column, y: Column, lon0, north0, k0, fe, fn) -> Column:
    """from_projected() with the parameters of a system as numbers or columns."""
    start = F.struct((((y - fn) / k0 + north0) / _RADIUS).alias("xi"), ((x - fe) / (k0 * _RADIUS)).alias("eta"))

    def sphere(p):
        a, b = p["xi"], p["eta"]
        for k, c in enumerate(_BETA, 1):
            a = a - c * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"])
            b = b - c * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"])
        return F.struct(a.alias("a"), b.alias("b"))

    def nearer(t, t0):
        """One Newton step from conformal to geographic latitude."""
        def step(q):
            now = q["t"] * F.sqrt(1 + q["g"] * q["g"]) - q["g"] * F.sqrt(1 + q["t"] * q["t"])
            return q["t"] + (t0 - now) / F.sqrt(1 + now * now) * (1 + (1 - _E**2) * q["t"] * q["t"]) / ((1 - _E**2) * F.sqrt(1 + q["t"] * q["t"]))

        return let(F.struct(t.alias("t"), F.sinh(_E * F.atanh(_E * t / F.sqrt(1 + t * t))).alias("g")), step)

    def geographic(p):
        t0 = F.sin(p["a"]) / F.sqrt(F.pow(F.sinh(p["b"]), 2.0) + F.pow(F.cos(p["a"]), 2.0))
        t = let(t0, lambda u: F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), u, lambda v, _: nearer(v, u)))
        return point(lon0 + F.degrees(F.atan2(F.sinh(p["b"]), F.cos(p["a"]))), F.degrees(F.atan(t)))

    return let(start, lambda p: let(sphere(p), geographic))


def known_crs(epsg: Column) -> Column:
    """Whether transform_crs() takes a code."""
    return F.coalesce(epsg.isin(4326, *TRANSVERSE_MERCATOR), F.lit(False))


def to_wgs84(x: Column, y: Column, epsg: Column) -> Column:
    """struct<x, y> as lon and lat by a column of codes, so that one table may mix systems; null where the code isn't known or
    the result isn't finite."""
    known = F.lit(None)
    for code, (lon0, lat0, k0, fe, fn) in TRANSVERSE_MERCATOR.items():
        values = {"lon0": lon0, "north0": _northing_at(lat0), "k0": k0, "fe": fe, "fn": fn}
        known = F.when(epsg == code, F.struct(*[F.lit(v).alias(k) for k, v in values.items()])).otherwise(known)
    other = let(known, lambda p: F.when(p.isNotNull(), _unprojected(x, y, p["lon0"], p["north0"], p["k0"], p["fe"], p["fn"])))
    found = F.when(epsg == 4326, point(x, y)).otherwise(other)
    return let(found, lambda q: F.when(F.abs(q["x"]).between(0, 1e300) & F.abs(q["y"]).between(0, 1e300), q))


def transform_crs(x: Column, y: Column, source: int, target: int) -> Column:
    """struct<x, y> in another reference system; null where the result is not finite. Unknown codes raise."""
    for code in (source, target):
        if code != 4326 and code not in TRANSVERSE_MERCATOR:
            raise ValueError(f"unknown EPSG code {code}")
    p = point(x, y)
    if source != target and source != 4326:
        p = from_projected(x, y, source)
    if source != target and target != 4326:
        p = let(p, lambda q: to_projected(q["x"], q["y"], target))
    return let(p, lambda q: F.when(F.abs(q["x"]).between(0, 1e300) & F.abs(q["y"]).between(0, 1e300), q))


def transform_line(line: Column, source: int, target: int) -> Column:
    return F.transform(line, lambda p: transform_crs(p["x"], p["y"], source, target))
