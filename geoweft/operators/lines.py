"""Polylines as rows (line_id, seq, lon, lat): cumulative distance, sampling, elevation profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoweft.functions import geo
from geoweft.operators import raster


def measured(vertices: DataFrame) -> DataFrame:
    """Adds segment_m (0 for the first vertex) and distance_m."""
    w = W.partitionBy("line_id").orderBy("seq")
    leg = geo.haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    v = vertices.withColumn("segment_m", F.when(F.row_number().over(w) == 1, 0.0).otherwise(leg))
    return v.withColumn("distance_m", F.sum("segment_m").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def sampled(vertices: DataFrame, interval_m: float = 30.0) -> DataFrame:
    """line_id, distance_m, lon, lat: the start, every multiple of the interval and every vertex; a distance once. A vertex brings what
    lies between it and the next one, so lines are put in order once and samples aren't shuffled."""
    if interval_m <= 0:
        raise ValueError("the interval must be positive")
    w = W.partitionBy("line_id").orderBy("seq")
    m = measured(vertices).select("line_id", "lon", "lat", "distance_m", F.lag("distance_m").over(w).alias("from_m"), *[F.lead(c).over(w).alias(f"to_{c}") for c in ("lon", "lat", "distance_m")])
    at, to = F.col("distance_m"), F.col("to_distance_m")
    first, last = F.greatest(F.ceil(at / interval_m), F.lit(1)), F.ceil(to / interval_m) - 1

    def place(k):
        t = (k * interval_m - at) / (to - at)
        return F.struct((k * interval_m).alias("distance_m"), (F.col("lon") + (F.col("to_lon") - F.col("lon")) * t).alias("lon"), (F.col("lat") + (F.col("to_lat") - F.col("lat")) * t).alias("lat"))

    # what falls on a vertex is that vertex, and of vertices at one distance the first one stays
    between = F.filter(F.sequence(first, last), lambda k: (k * interval_m != at) & (k * interval_m != to))
    own = F.when(at.eqNullSafe(F.col("from_m")), F.array()).otherwise(F.array(F.struct("distance_m", "lon", "lat")))
    inner = F.when((to > at) & (last >= first), F.transform(between, place)).otherwise(F.array())
    return m.select("line_id", F.explode(F.concat(own, inner)).alias("s")).select("line_id", "s.*")


def profile(vertices: DataFrame, tiles: DataFrame, meta: DataFrame, dataset: str, interval_m: float = 30.0, size: int = 512) -> DataFrame:
    """line_id, n_samples, length_m, ascent_m, descent_m, min_m, max_m; samples without elevation are bridged."""
    s = sampled(vertices, interval_m).withColumn("qid", F.struct("line_id", "distance_m"))
    z = raster.bilinear(s.select("qid", F.lit(dataset).alias("dataset"), "lon", "lat"), tiles, meta, size).select("qid.*", "elevation")
    w = W.partitionBy("line_id").orderBy("distance_m")
    d = F.col("elevation") - F.last("elevation", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    up = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0.0))
    return z.withColumn("d", d).groupBy("line_id").agg(F.count(F.lit(1)).alias("n_samples"), F.max("distance_m").alias("length_m"), up.alias("ascent_m"), down.alias("descent_m"), F.min("elevation").alias("min_m"), F.max("elevation").alias("max_m"))
