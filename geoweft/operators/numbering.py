"""Numbers 0..n-1 in a global order without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoweft.tables import materialize


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Range partitions are numbered by themselves; the offsets, one a partition, are added by a broadcast join."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = materialize(placed.withColumn("__part", F.shiftright("__id", 33)), "numbered")
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", "__first", before.alias("__before"))
    out = rows.join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__id") - F.col("__first") + F.col("__before")).drop("__id", "__part", "__first", "__before")
