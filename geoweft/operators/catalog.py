"""The version catalogue as queries over its log: nothing is updated in place.

versions: dataset, version_no, checksum, status, changed_at, ...; events: dataset, version_no, to_status, changed_at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Where a status may go.
TRANSITIONS = [
    ("UPLOADED", "VALIDATING"), ("VALIDATING", "VALIDATED"), ("VALIDATING", "REJECTED"), ("VALIDATING", "FAILED"), ("VALIDATED", "PROCESSING"), ("PROCESSING", "PROCESSED"),
    ("PROCESSING", "FAILED"), ("PROCESSED", "PUBLISHED"), ("PUBLISHED", "ARCHIVED"), ("ARCHIVED", "PUBLISHED"), ("FAILED", "VALIDATING"), ("FAILED", "PROCESSING"),
]
VERSION = ["dataset", "version_no"]


def register(existing: DataFrame, uploads: DataFrame) -> DataFrame:
    """uploads (dataset, arrival, ...) with the next version numbers of their dataset and status UPLOADED."""
    base = existing.groupBy("dataset").agg(F.max("version_no").alias("base"))
    n = F.row_number().over(W.partitionBy("dataset").orderBy("arrival"))
    return uploads.join(base, "dataset", "left").withColumn("version_no", (F.coalesce("base", F.lit(0)) + n).cast("int")).drop("base").withColumn("status", F.lit("UPLOADED"))


def transitions(events: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Consecutive states: key, from_status (null for the first), to_status, changed_at."""
    w = W.partitionBy(*(key or VERSION)).orderBy("changed_at", *[c for c in ("event_no", "version_no") if c in events.columns])
    return events.withColumn("from_status", F.lag("to_status").over(w))


def illegal(pairs: DataFrame) -> DataFrame:
    legal = pairs.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string")
    return pairs.where("from_status is not null").join(F.broadcast(legal), ["from_status", "to_status"], "left_anti")


def current(events: DataFrame) -> DataFrame:
    return events.groupBy(*VERSION).agg(F.max_by("to_status", F.struct("changed_at", "to_status")).alias("status"))


def duplicate_versions(versions: DataFrame) -> DataFrame:
    """Versions whose checksum some other, not rejected version of the same dataset has. Two counts a checksum decide it,
    so a checksum that very many versions share makes no pairs."""
    live = F.col("status") != "REJECTED"
    n = versions.where(live).groupBy("dataset", "checksum").agg(F.count(F.lit(1)).alias("n"))
    return versions.join(n, ["dataset", "checksum"]).where(F.col("n") > F.when(live, 1).otherwise(0)).drop("n")


def active(versions: DataFrame) -> DataFrame:
    """dataset, version_no last published and still so."""
    return versions.where("status = 'PUBLISHED'").groupBy("dataset").agg(F.max_by("version_no", F.struct("changed_at", "version_no")).alias("version_no"))


def rollback_target(versions: DataFrame) -> DataFrame:
    return versions.where("status = 'ARCHIVED'").groupBy("dataset").agg(F.max_by("version_no", F.struct("changed_at", "version_no")).alias("target"))


def publish(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """History rows of requests (dataset, target): none if the target is active, an ERROR row unless it is PROCESSED or
    ARCHIVED, else the target's PUBLISHED and the active version's ARCHIVED."""
    t = requests.join(versions.select("dataset", F.col("version_no").alias("target"), "status"), ["dataset", "target"], "left").join(active(versions), "dataset", "left")
    move = F.struct(F.col("target").alias("version_no"), F.col("status").alias("from_status"), F.lit("PUBLISHED").alias("to_status"))
    old = F.struct("version_no", F.lit("PUBLISHED").alias("from_status"), F.lit("ARCHIVED").alias("to_status"))
    bad = F.struct(F.col("target").alias("version_no"), F.col("status").alias("from_status"), F.lit("ERROR").alias("to_status"))
    rows = F.when(F.col("target").eqNullSafe(F.col("version_no")), F.filter(F.array(move), lambda x: F.lit(False)))
    rows = rows.when(F.coalesce(F.col("status").isin("PROCESSED", "ARCHIVED"), F.lit(False)), F.filter(F.array(move, old), lambda x: x["version_no"].isNotNull()))
    return t.select("dataset", F.explode(rows.otherwise(F.array(bad))).alias("r")).select("dataset", "r.*")


def latest(jobs: DataFrame, key: list[str], order: str) -> DataFrame:
    w = W.partitionBy(*key).orderBy(F.desc(order))
    return jobs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_message(versions: DataFrame) -> DataFrame:
    """Error messages stay with FAILED and REJECTED versions only."""
    return versions.withColumn("error_message", F.when(F.col("status").isin("FAILED", "REJECTED"), F.col("error_message")))


def datasets(dataset: DataFrame, versions: DataFrame) -> DataFrame:
    return dataset.join(active(versions).withColumnRenamed("version_no", "active_version"), "dataset", "left")


def status_in(rows: DataFrame, statuses: list[str]) -> DataFrame:
    return rows.where(F.col("status").isin(statuses))


def active_of_type(dataset: DataFrame, versions: DataFrame, kind: str) -> DataFrame:
    """Datasets (dataset, type, ...) of one type that have an active version, by dataset."""
    return dataset.where(F.col("type") == kind).join(active(versions).withColumnRenamed("version_no", "active_version"), "dataset").orderBy("dataset")


def details(versions: DataFrame, dataset: DataFrame, raster_meta: DataFrame) -> DataFrame:
    """Every version with its dataset's type, whether it is the active one, and for rasters what raster_meta (dataset,
    version_no, ...) says of it."""
    now = active(versions).select("dataset", F.col("version_no").alias("__active"))
    own = [c for c in raster_meta.columns if c not in VERSION]
    meta = raster_meta.select(*VERSION, *own)
    out = versions.join(dataset.select("dataset", "type"), "dataset").join(now, "dataset", "left").join(meta, VERSION, "left")
    return out.withColumn("active", F.col("version_no").eqNullSafe(F.col("__active"))).drop("__active").withColumns({c: F.when(F.col("type") == "RASTER", F.col(c)) for c in own})


def history(events: DataFrame, versions: DataFrame) -> DataFrame:
    """All state changes of the versions asked for (dataset, version_no), in order."""
    return transitions(events.join(versions.select(*VERSION).distinct(), VERSION, "left_semi")).orderBy(*VERSION, "changed_at")


def known(requests: DataFrame, existing: DataFrame, keys: list[str], there: bool = True) -> DataFrame:
    """Requests whose keys exist already, or (there=False) don't."""
    return requests.join(existing.select(*keys), keys, "left_semi" if there else "left_anti")


def row_counts(rows: DataFrame) -> DataFrame:
    """dataset, version_no, rows."""
    return rows.groupBy(*VERSION).agg(F.count(F.lit(1)).alias("rows"))
