"""Rasters as tile tables: pixel lookup, bilinear values, statistics, re-tiling and overviews.

tiles: dataset, level, band, tile_col, tile_row, width, height, data (row by row); a tile covers
`size` x `size` pixels but for the last ones. meta: dataset, raster_width, raster_height, gt, nodata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import geo
from geoweft.tables import materialize


def tiles_of(pixels: DataFrame, size: int = 512) -> DataFrame:
    """Pixels (dataset, level, band, col, row, value), each once, to full tiles; missing pixels are null. A tile's pixels are
    put in order by one sort of what there is and what is missing."""
    key = ["dataset", "level", "band"]
    extent = pixels.groupBy(*key).agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    keyed = pixels.withColumn("tile_col", F.floor(F.col("col") / size).cast("int")).withColumn("tile_row", F.floor(F.col("row") / size).cast("int"))
    entry = F.struct((F.col("row") % size).cast("int").alias("y"), (F.col("col") % size).cast("int").alias("x"), F.col("value").cast("double").alias("value"))
    out = keyed.groupBy(*key, "tile_col", "tile_row").agg(F.collect_list(entry).alias("there")).join(extent, key)
    out = out.withColumn("width", F.least(F.lit(size), F.col("w") - F.col("tile_col") * size).cast("int")).withColumn("height", F.least(F.lit(size), F.col("h") - F.col("tile_row") * size).cast("int"))
    out = out.withColumn("there", F.transform("there", lambda e: F.struct((e["y"] * F.col("width") + e["x"]).alias("i"), e["value"].alias("value"))))
    missing = F.array_except(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), F.transform("there", lambda e: e["i"]))
    every = F.sort_array(F.concat("there", F.transform(missing, lambda i: F.struct(i.alias("i"), F.lit(None).cast("double").alias("value")))))
    data = F.when(F.size(every) == F.col("width") * F.col("height"), F.transform(every, lambda e: e["value"])).otherwise(F.raise_error(F.lit("a pixel occurs twice")))
    return out.select(*key, "tile_col", "tile_row", "width", "height", data.alias("data"))


def pixels_of(tiles: DataFrame, size: int = 512) -> DataFrame:
    p = tiles.select("dataset", "level", "band", "tile_col", "tile_row", "width", F.posexplode("data").alias("i", "value"))
    return p.select("dataset", "level", "band", (F.col("tile_col") * size + F.col("i") % F.col("width")).cast("int").alias("col"), (F.col("tile_row") * size + F.floor(F.col("i") / F.col("width"))).cast("int").alias("row"), "value")


def statistics(tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """dataset, band: number of pixels, NoData ratio, min and max of the valid ones. Tiles are reduced before the shuffle."""
    t = tiles.where("level = 0").join(F.broadcast(meta.select("dataset", "nodata")), "dataset")
    valid = F.filter("data", lambda v: ~geo.is_nodata(v, F.col("nodata")))
    part = t.select("dataset", "band", F.size("data").alias("n"), F.size(valid).alias("good"), F.array_min(valid).alias("lo"), F.array_max(valid).alias("hi"))
    out = part.groupBy("dataset", "band").agg(F.sum("n").alias("n_pixels"), F.sum("good").alias("good"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"))
    return out.select("dataset", "band", "n_pixels", F.when(F.col("n_pixels") > 0, 1 - F.col("good") / F.col("n_pixels")).alias("nodata_ratio"), "min_value", "max_value")


def centre_lat(gt: Column, width: Column, height: Column) -> Column:
    """The middle of a raster in its own system, y."""
    return geo.apply_transform(gt, width / 2.0, height / 2.0)["y"]


def inspected(tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """A row for each raster of meta, which may hold epsg, srs, data_type and linear_unit (metres of one unit of its system) too: size,
    bands, data type, pixel sizes, resolution in metres, extent in its own system (own_minx, ...), footprint and extent (minx, ...)
    in EPSG:4326, and the statistics of its first band. What isn't georeferenced or is in a system that isn't known has no
    footprint, extent or resolution; nothing else is missing then."""
    kinds = {"epsg": "int", "srs": "string", "data_type": "string", "linear_unit": "double"}
    meta = meta.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in meta.columns})
    bands = tiles.where("level = 0").groupBy("dataset").agg(F.countDistinct("band").alias("n_bands"), F.min("band").alias("band"))
    stats = statistics(tiles, meta).join(bands, ["dataset", "band"]).drop("band")
    gt, w, h = F.col("gt"), F.col("raster_width"), F.col("raster_height")
    there = F.coalesce(geo.is_georeferenced(gt) & geo.known_crs(F.col("epsg")), F.lit(False))
    corner = [geo.apply_transform(gt, x.cast("double"), y.cast("double")) for x in (F.lit(0), w) for y in (F.lit(0), h)]
    side = lambda f, k: f(*[c[k] for c in corner])
    size = geo.pixel_size(gt)
    own = meta.withColumns({
        "data_type": F.coalesce("data_type", F.lit("Float64")), "pixel_x": size["x"], "pixel_y": size["y"], "georeferenced": geo.is_georeferenced(gt), "own_minx": side(F.least, "x"), "own_miny": side(F.least, "y"),
        "own_maxx": side(F.greatest, "x"), "own_maxy": side(F.greatest, "y"), "footprint": F.when(there, footprint_of(gt, w, h, F.col("epsg"))),
    })
    xs, ys = F.transform("footprint", lambda p: p["x"]), F.transform("footprint", lambda p: p["y"])
    own = own.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})
    geographic = F.col("epsg") == 4326
    own = own.withColumn("resolution_m", F.when(there, geo.resolution_m(gt, geographic, centre_lat(gt, w, h), F.coalesce("linear_unit", F.lit(1.0)))))
    return own.join(stats, "dataset", "left")


def write_tiles(tiles: DataFrame, meta: DataFrame, path: str, version_no: int, size: int = 512, most: int = 512) -> None:
    """Level 0 and its overviews as Parquet by dataset and version_no. A version is replaced whole, so levels that a rewrite no longer
    has are gone, and a retry leaves the same rows."""
    every = overviews(tiles, meta, size, most).withColumn("version_no", F.lit(version_no))
    every.hint("rebalance", "dataset").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "version_no").parquet(path)


def read_tiles(spark: SparkSession, path: str, dataset: str, version_no: int) -> DataFrame:
    """The tiles of one version: only its files are read."""
    return spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("version_no") == version_no)).drop("version_no")


def located(points: DataFrame, meta: DataFrame) -> DataFrame:
    """points (qid, dataset, lon, lat) with px, py and whether the raster holds them."""
    # exploding an array of one computes it once, however often it is used
    p = points.join(F.broadcast(meta), "dataset", "left").withColumn("p", F.explode(F.array(geo.to_pixel(F.col("gt"), F.col("lon"), F.col("lat")))))
    p = p.withColumn("px", F.col("p.x")).withColumn("py", F.col("p.y")).drop("p")
    return p.withColumn("inside", F.coalesce(geo.in_raster(F.col("px"), F.col("py"), F.col("raster_width"), F.col("raster_height")), F.lit(False)))


def _lookup(at: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Adds band and value to rows with dataset, col, row: an equi-join on the tile."""
    keyed = at.withColumn("tile_col", F.floor(F.col("col") / size).cast("int")).withColumn("tile_row", F.floor(F.col("row") / size).cast("int"))
    t = tiles.where("level = 0").select("dataset", "band", "tile_col", "tile_row", "width", "data")
    i = (F.col("row") - F.col("tile_row") * size) * F.col("width") + F.col("col") - F.col("tile_col") * size
    return keyed.join(t, ["dataset", "tile_col", "tile_row"], "left").withColumn("value", F.get("data", i.cast("int"))).drop("data", "width", "tile_col", "tile_row")


def pixel_values(points: DataFrame, tiles: DataFrame, meta: DataFrame, size: int = 512) -> DataFrame:
    """qid, inside, col, row, band, value: null for NoData; one row without band for points outside or where the tile is missing."""
    p = located(points, meta)
    inside = p.where("inside").withColumn("col", F.floor("px").cast("int")).withColumn("row", F.floor("py").cast("int"))
    found = _lookup(inside, tiles, size).select("qid", "inside", "col", "row", "band", F.when(~geo.is_nodata(F.col("value"), F.col("nodata")), F.col("value")).alias("value"))
    none = F.lit(None)
    return found.unionByName(p.where("not inside").select("qid", "inside", none.cast("int").alias("col"), none.cast("int").alias("row"), none.cast("int").alias("band"), none.cast("double").alias("value")))


def seamed(tiles: DataFrame) -> DataFrame:
    """Tiles (dataset, tile_col, tile_row, width, data) of one level and band with what lies beyond their last pixels: the first column of
    the tile to the right, the first row of the one below and the first pixel of the one past the corner; null where there is none."""
    key, kinds = ["dataset", "tile_col", "tile_row"], {"width": "int", "data": "array<double>", "right": "array<double>", "under": "array<double>", "corner": "double"}
    column = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda r: F.get("data", (r * F.col("width")).cast("int")))

    def piece(left, up, **of):
        return F.struct((F.col("tile_col") - left).alias("tile_col"), (F.col("tile_row") - up).alias("tile_row"), *[of.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    # tiles are made once; a tile that is missing still has neighbours
    pieces = F.array(piece(0, 0, width=F.col("width"), data=F.col("data")), piece(1, 0, right=column), piece(0, 1, under=F.slice("data", F.lit(1), F.col("width"))), piece(1, 1, corner=F.get("data", 0)))
    return tiles.select("dataset", F.explode(pieces).alias("p")).select("dataset", "p.*").groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in kinds])


def bilinear(points: DataFrame, tiles: DataFrame, meta: DataFrame, size: int = 512, band: int = 1) -> DataFrame:
    """qid, elevation: from pixel centres, clamped at the edge; with NoData among the four, or with a raster under
    two pixels wide or high, the value of the pixel itself. Null outside and on NoData."""
    p = located(points, meta)
    w, h = F.col("raster_width"), F.col("raster_height")
    fx = geo.clamp(F.col("px") - 0.5, F.lit(0.0), (w - 1).cast("double"))
    fy = geo.clamp(F.col("py") - 0.5, F.lit(0.0), (h - 1).cast("double"))
    x0 = F.least(F.floor(fx), F.greatest(w - 2, F.lit(0))).cast("int")
    y0 = F.least(F.floor(fy), F.greatest(h - 2, F.lit(0))).cast("int")
    p = p.withColumn("q", F.explode(F.array(F.struct(x0.alias("x0"), y0.alias("y0"), (fx - x0).alias("dx"), (fy - y0).alias("dy"))))).select("*", "q.*").drop("q")
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    # what lies outside looks for a tile that there is none of, one of many, so that it stays with the others and isn't all in one task
    nowhere = (-2 - F.pmod(F.xxhash64("qid"), F.lit(4096))).cast("int")
    keyed = p.select(
        "qid", "dataset", "nodata", "inside", "dx", "dy", w.alias("w"), h.alias("h"), "x0", F.least(F.col("x0") + 1, w - 1).alias("x1"), F.floor("px").cast("int").alias("c4"), "y0", F.least(F.col("y0") + 1, h - 1).alias("y1"),
        F.floor("py").cast("int").alias("r4"), F.when(F.col("inside"), tile("x0")).otherwise(nowhere).alias("tile_col"), F.when(F.col("inside"), tile("y0")).otherwise(0).alias("tile_row"),
    )
    met = keyed.join(seamed(tiles.where((F.col("level") == 0) & (F.col("band") == band))), ["dataset", "tile_col", "tile_row"], "left")

    def at(c, r):
        i, j = F.col(c) - F.col("tile_col") * size, F.col(r) - F.col("tile_row") * size
        own = F.when((i < size) & (j < size), F.get("data", (j * F.col("width") + i).cast("int")))
        return own.when(j < size, F.get("right", j.cast("int"))).when(i < size, F.get("under", i.cast("int"))).otherwise(F.col("corner"))

    def interpolated(v):
        top = v[0] * (1 - F.col("dx")) + v[1] * F.col("dx")
        low = v[2] * (1 - F.col("dx")) + v[3] * F.col("dx")
        whole = v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull() & v[3].isNotNull() & (F.col("w") > 1) & (F.col("h") > 1)
        return F.when(whole, top * (1 - F.col("dy")) + low * F.col("dy")).otherwise(v[4])

    # plain columns, no lambda: a lambda would be handed a row of its own, with a copy of the whole tile
    valid = lambda v: F.when(F.col("inside") & ~geo.is_nodata(v, F.col("nodata")), v)
    five = [valid(at(c, r)).alias(f"v{k}") for k, (c, r) in enumerate((("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1"), ("c4", "r4")))]
    found = met.select("qid", "inside", "dx", "dy", "w", "h", *five)
    return found.select("qid", F.when(F.col("inside"), interpolated([F.col(f"v{k}") for k in range(5)])).alias("elevation"))


def _parent(rows: pa.Table, size: int) -> pa.Table:
    """One tile of the next level from up to four: the mean of the valid pixels of two by two."""
    sums, n = np.zeros((size, size)), np.zeros((size, size), np.int64)
    dataset, level, band, col, row, w, h = (rows.column(c)[0].as_py() for c in ("dataset", "level", "band", "up_col", "up_row", "level_w", "level_h"))
    for k in range(rows.num_rows):
        width, height, data = (rows.column(c)[k] for c in ("width", "height", "data"))
        width, height = width.as_py(), height.as_py()
        v = np.full((height + height % 2, width + width % 2), np.nan)
        v[:height, :width] = data.values.to_numpy(zero_copy_only=False).astype(float).reshape(height, width)
        nodata = rows.column("nodata")[k].as_py()
        good = ~np.isnan(v) & (v != nodata if nodata is not None else True)
        four = lambda x: x.reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).sum((1, 3))
        at = (rows.column("tile_row")[k].as_py() % 2 * (size // 2), rows.column("tile_col")[k].as_py() % 2 * (size // 2))
        inside = np.s_[at[0] : at[0] + v.shape[0] // 2, at[1] : at[1] + v.shape[1] // 2]
        sums[inside], n[inside] = four(np.where(good, v, 0.0)), four(good)
    width, height = min(size, w - col * size), min(size, h - row * size)
    n = n[:height, :width].reshape(-1)
    mean = pa.array(sums[:height, :width].reshape(-1) / np.maximum(n, 1), pa.float64(), mask=n == 0)
    one = {"dataset": dataset, "level": level + 1, "band": band, "tile_col": col, "tile_row": row, "width": width, "height": height}
    return pa.table({k: pa.array([v], pa.string() if k == "dataset" else pa.int32()) for k, v in one.items()} | {"data": pa.ListArray.from_arrays(pa.array([0, len(mean)], pa.int32()), mean)})


def overviews(tiles: DataFrame, meta: DataFrame, size: int = 512, most: int = 512) -> DataFrame:
    """tiles with levels 1, 2, ...: each pixel the mean of the valid ones of two by two, until `most` pixels do.

    Four tiles make one, as tile sizes are even, so whole tiles are shuffled and never pixels; each level is written before the
    next one reads it, and has a quarter of its tiles."""
    if size % 2:
        raise ValueError("tiles of an odd size don't nest")
    side = F.greatest("raster_width", "raster_height")
    known = meta.select("dataset", "nodata", F.col("raster_width").alias("level_w"), F.col("raster_height").alias("level_h"), side.alias("side"))
    out, now, level, largest = tiles, tiles.where("level = 0"), 0, meta.agg(F.max(side)).first()[0] or 0
    kinds = "dataset string, level int, band int, tile_col int, tile_row int, width int, height int, data array<double>"
    while largest > most:
        half = lambda c: F.ceil(F.col(c) / 2).cast("int")
        left = known.where(F.col("side") > most).withColumns({"level_w": half("level_w"), "level_h": half("level_h")})
        up = now.join(F.broadcast(left), "dataset").withColumns({"up_col": F.floor(F.col("tile_col") / 2).cast("int"), "up_row": F.floor(F.col("tile_row") / 2).cast("int")})
        made = up.groupBy("dataset", "band", "up_col", "up_row").applyInArrow(lambda t: _parent(t, size), kinds)
        now = materialize(made, f"level-{level + 1}")
        out = out.unionByName(now.select(*[F.col(c).cast(t) for c, t in tiles.dtypes]))
        # what has been averaged is null where it isn't valid
        known = left.withColumns({"nodata": F.lit(None).cast("double"), "side": half("side")})
        level, largest = level + 1, (largest + 1) // 2
    return out


def _edge(gt: Column, width: Column, height: Column, per_edge: int) -> Column:
    """Closed ring of 4 * per_edge + 1 points along the raster's edge, in its own system."""
    at = lambda along, side: {0: (along, 0.0), 1: (1.0, along), 2: (1 - along, 1.0), 3: (0.0, 1 - along)}[side]
    ring = [at(k / per_edge, side) for side in range(4) for k in range(per_edge)]
    shares = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [*ring, ring[0]]])
    return F.transform(shares, lambda s: geo.apply_transform(gt, width * s["x"], height * s["y"]))


def footprint(gt: Column, width: Column, height: Column, epsg: int = 4326, per_edge: int = 8) -> Column:
    """Closed ring of 4 * per_edge + 1 points along the raster's edge, in EPSG:4326."""
    return F.transform(_edge(gt, width, height, per_edge), lambda p: geo.transform_crs(p["x"], p["y"], epsg, 4326))


def footprint_of(gt: Column, width: Column, height: Column, epsg: Column, per_edge: int = 8) -> Column:
    """footprint() by a column of codes; null for one that isn't known."""
    return F.when(geo.known_crs(epsg), F.transform(_edge(gt, width, height, per_edge), lambda p: geo.to_wgs84(p["x"], p["y"], epsg)))
