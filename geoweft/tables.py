"""Reading the star-schema and corpus tables, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Where materialize() has written a frame.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths by open scratch().
_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A temporary one only in local mode, where driver and
    executors are one process; a cluster without that setting is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="geoweft-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that what follows neither recomputes it nor depends
    on any single executor. What materialize() wrote for `replaces`, of which nothing more is read, is deleted after that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/geoweft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    for held in _SCOPES[-1:]:
        held.append(path)
    if replaces is not None:
        release(replaces)
    return out


def spread(df: DataFrame) -> DataFrame:
    """df in two tasks a core at least: rows of few small files, of which each stands for much work, are dealt anew; others stay
    where they are. Counting the tasks runs what df shuffles once: meant for plain reads."""
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _delete(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def release(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote for frames of which nothing more is read."""
    for df in frames:
        if path := _WRITTEN.pop(df, None):
            _delete(df.sparkSession, path)


class Rounds:
    """A table in the shared folder, parted by its column `at`, that rounds add rows to: what a round has added is read from then on.

    Frames of it are read anew each time, so no plan grows with the number of rounds."""

    def __init__(self, like: DataFrame, name: str):
        self.spark, self.path = like.sparkSession, f"{shared_dir(like.sparkSession)}/geoweft/{name}-{uuid.uuid4().hex}"
        self.schema = StructType([f for f in like.schema if f.name != "at"] + [like.schema["at"]])
        for held in _SCOPES[-1:]:
            held.append(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("at").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def at(self, n: int) -> DataFrame:
        """The rows of one value of `at`, from its own folder; none is an empty frame."""
        rest = StructType([f for f in self.schema if f.name != "at"])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/at={n}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], rest)
        return self.spark.read.schema(rest).parquet(f"{self.path}/at={n}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialize() writes within is deleted at the end, also after an error: write the result, or collect it, before
    that. Scopes nest; each deletes its own."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)
