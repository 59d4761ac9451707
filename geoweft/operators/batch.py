"""A run over a directory of road, place and raster files: each version is read, measured, ruled and stored as its type asks.

Files are named <dataset>@<version>.<kind>: .roads.geojsonl and .poi.geojsonl (a feature a line), .asc (a grid as text: ncols,
nrows, xllcorner, yllcorner, cellsize, NODATA_value, then rows of values, in EPSG:4326). Files of other names and files without a
byte, which Spark's readers pass over, are no versions.

A run has stages: read (features and tiles under the run's id), validate (the report under it), publish (rows of accepted versions
and the report to the tables). Stages write whole versions by partition and leave a mark when done, so a run that was killed is
run again with its id: finished stages are not repeated, others start over, and the tables are the same as after one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import geo
from geoweft.functions import roads as rules
from geoweft.operators import quality, raster, roads
from geoweft.sources import vector

KEY = ["dataset", "version_no"]
#: Ending -> type of dataset.
KINDS = {".roads.geojsonl": "ROAD_NETWORK", ".poi.geojsonl": "POI", ".asc": "RASTER"}
HEADER = ["ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value"]


def named(rows: DataFrame) -> DataFrame:
    """rows with a path: dataset, version_no and type from its name; type is null for names that say none."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lit(None)
    for ending, type_ in KINDS.items():
        kind = F.when(name.endswith(ending), type_).otherwise(kind)
    version = F.try_to_number(F.regexp_extract(name, r"^.+@(\d{1,9})\.", 1), F.lit("999999999")).cast("int")
    return rows.withColumns({"dataset": F.regexp_extract(name, r"^(.+)@\d{1,9}\.", 1), "version_no": version, "type": F.when(version.isNotNull(), kind)})


def grids(spark: SparkSession, path: str, size: int = 512) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tiles, meta, unreadable) of the grids below a path, a dataset's name being <dataset>@<version>. A grid is read by one task,
    value by value only what it holds; one with a missing head, or with more or fewer values than its head says, is unreadable."""
    text = named(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.asc").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))).where("type is not null")
    words = lambda x: F.split(F.trim(x), r"\s+")
    line = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    one = text.select(*KEY, line.alias("line")).withColumn("names", F.transform(F.slice("line", 1, 6), lambda x: F.lower(F.get(words(x), 0))))
    head = F.map_from_arrays("names", F.transform(F.slice("line", 1, 6), lambda x: F.get(words(x), 1).try_cast("double")))
    one = one.withColumn("h", F.when(F.size(F.array_distinct("names")) == 6, head))
    values = F.flatten(F.transform(F.slice("line", F.lit(7), F.greatest(F.size("line"), F.lit(1))), lambda x: F.transform(words(x), lambda v: v.try_cast("double"))))
    one = one.select(*KEY, *[F.try_element_at("h", F.lit(k)).alias(k) for k in HEADER], values.alias("v"))
    there = [F.col(k).isNotNull() for k in HEADER]
    fine = there[0] & there[1] & there[2] & there[3] & (F.col("cellsize") > 0) & (F.col("ncols") >= 1) & (F.col("nrows") >= 1) & (F.size("v") == F.col("ncols") * F.col("nrows")) & ~F.exists("v", lambda x: x.isNull())
    one = one.withColumn("fine", F.coalesce(fine, F.lit(False)))
    bad = one.where("not fine").select(*KEY)
    one = one.where("fine").withColumn("name", F.concat_ws("@", *KEY))
    gt = F.array(F.col("xllcorner"), F.col("cellsize"), F.lit(0.0), F.col("yllcorner") + F.col("nrows") * F.col("cellsize"), F.lit(0.0), -F.col("cellsize"))
    meta = one.select(*KEY, F.col("name").alias("own"), F.col("ncols").cast("int").alias("raster_width"), F.col("nrows").cast("int").alias("raster_height"), gt.alias("gt"), F.col("nodata_value").alias("nodata"), F.lit(4326).alias("epsg"), F.lit("GEOGCS").alias("srs"))
    at = lambda c: F.sequence(F.lit(0), F.floor((F.col(c) - 1) / size).cast("int"))
    cut = one.withColumn("tile_row", F.explode(at("nrows"))).withColumn("tile_col", F.explode(at("ncols")))
    cut = cut.withColumns({"width": F.least(F.lit(size), F.col("ncols") - F.col("tile_col") * size).cast("int"), "height": F.least(F.lit(size), F.col("nrows") - F.col("tile_row") * size).cast("int")})
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.slice("v", ((F.col("tile_row") * size + y) * F.col("ncols") + F.col("tile_col") * size + 1).cast("int"), F.col("width"))))
    tiles = cut.select(F.col("name").alias("dataset"), F.lit(0).alias("level"), F.lit(1).alias("band"), "tile_col", "tile_row", "width", "height", data.alias("data"))
    return tiles, meta.withColumn("dataset_name", F.col("dataset")).drop("dataset").withColumnRenamed("own", "dataset"), bad


def _feature_lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.geojsonl").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("feature_no"))
    return vector.parsed_lines(named(text)).where("type is not null")


class Run:
    """One run over `path` into tables below `out`: poi, node, link, raster and validation."""

    def __init__(self, spark: SparkSession, path: str, out: str, run_id: str, size: int = 512):
        self.spark, self.path, self.out, self.at, self.size = spark, path, out, f"{out}/_runs/{run_id}", size

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def done(self, stage: str) -> bool:
        fs, p = self._fs(f"{self.at}/{stage}.done")
        return fs.exists(p)

    def _mark(self, stage: str) -> None:
        fs, p = self._fs(f"{self.at}/{stage}.done")
        fs.create(p, True).close()

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")

    def _get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    def read(self) -> None:
        lines = _feature_lines(self.spark, self.path)
        good = lines.where(F.col("feature.type") == "Feature")
        attrs = F.transform_keys("feature.properties", lambda k, _: F.lower(k))
        self._put(good.select(*KEY, "type", "feature_no", F.col("feature.geometry.type").alias("geom_type"), vector.parts(F.col("feature.geometry")).alias("parts"), attrs.alias("attrs")), "features")
        tiles, meta, bad = grids(self.spark, self.path, self.size)
        self._put(tiles, "tiles")
        self._put(meta, "meta")
        self._put(lines.where("bad").select(*KEY).unionByName(bad).distinct(), "unreadable")

    def places(self) -> DataFrame:
        a = {k: rules.truncated(rules.attr(F.col("attrs"), v), rules.WIDTHS[k]) for k, v in rules.POI_ATTRS.items()}
        spot = F.get(F.get("parts", 0), 0)
        return self._get("features").where("type = 'POI'").select(*KEY, "geom_type", spot["x"].alias("lon"), spot["y"].alias("lat"), *[c.alias(k) for k, c in a.items()])

    def road_features(self) -> DataFrame:
        return self._get("features").where("type = 'ROAD_NETWORK'").withColumnRenamed("feature_no", "feature_id")

    def validate(self) -> None:
        meta = self._get("meta")
        measured = raster.inspected(self._get("tiles"), meta).select(F.col("dataset_name").alias("dataset"), "version_no", F.lit("RASTER").alias("type"), "srs", "epsg", "gt", "nodata_ratio", "resolution_m", "minx", "miny", "maxx", "maxy")
        report = quality.run(measured).unionByName(quality.run(quality.poi_measures(self.places()))).unionByName(quality.run(roads.measures(self.road_features())))
        bad = self._get("unreadable")
        self._put(report.join(bad, KEY, "left_anti").unionByName(quality.unreadable(bad)), "report")

    def publish(self) -> None:
        report = self._get("report")
        accepted = quality.decide(report).where("status = 'VALIDATED'").select(*KEY)
        keep = lambda df: df.join(accepted, KEY, "left_semi")
        vector.write_snapshot(keep(self.places().where((F.col("geom_type") == "Point") & geo.in_lon_lat_range(F.col("lon"), F.col("lat"))).drop("geom_type")), f"{self.out}/poi")
        nodes, links = roads.topology(keep(self.road_features()))
        vector.write_snapshot(nodes, f"{self.out}/node", ["node_seq"])
        vector.write_snapshot(links, f"{self.out}/link")
        meta = self._get("meta")
        tiles = raster.overviews(self._get("tiles"), meta, self.size, self.size).withColumnRenamed("dataset", "own")
        names = meta.select(F.col("dataset").alias("own"), F.col("dataset_name").alias("dataset"), "version_no")
        vector.write_snapshot(keep(tiles.join(F.broadcast(names), "own").drop("own")), f"{self.out}/raster")
        vector.write_snapshot(report, f"{self.out}/validation")

    def run(self, after=lambda stage: None) -> None:
        """All stages that this id has not done; `after` is called between them."""
        for stage in ("read", "validate", "publish"):
            if not self.done(stage):
                getattr(self, stage)()
                self._mark(stage)
            after(stage)
