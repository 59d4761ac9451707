"""Streams: arriving feature files, duplicate suppression, the live active version, the transition checker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geoweft.operators import catalog, quality
from geoweft.sources import vector


def poi_batch(features: DataFrame, out: str, unreadable: DataFrame | None = None) -> None:
    """Validates features (dataset, version_no, geom_type, parts, attrs) and stores the places of accepted versions. Versions
    among `unreadable` (dataset, version_no) get one blocking row and no other."""
    from geoweft.functions import roads

    a = {k: roads.truncated(roads.attr(F.col("attrs"), v), roads.WIDTHS[k]) for k, v in roads.POI_ATTRS.items()}
    p = features.select("dataset", "version_no", "geom_type", F.get(F.get("parts", 0), 0)["x"].alias("lon"), F.get(F.get("parts", 0), 0)["y"].alias("lat"), *[c.alias(k) for k, c in a.items()]).persist()
    report = quality.run(quality.poi_measures(p))
    if unreadable is not None:
        bad = unreadable.select("dataset", "version_no").distinct()
        report = report.join(bad, ["dataset", "version_no"], "left_anti").unionByName(quality.unreadable(bad))
    decided = quality.decide(report)
    good = decided.where("status = 'VALIDATED'").select("dataset", "version_no")
    vector.write_snapshot(p.where("geom_type = 'Point' and lon is not null and lat is not null").drop("geom_type").join(good, ["dataset", "version_no"]), f"{out}/poi")
    vector.write_snapshot(report, f"{out}/validation")
    p.unpersist()


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Streams newline-delimited feature files <dataset>@<version>.geojsonl once through validation and load."""
    lines = spark.readStream.format("text").load(path).select("value", F.col("_metadata.file_path").alias("path"))

    def batch(rows: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        lines = vector.parsed_lines(rows).withColumns({"dataset": F.regexp_extract(name, "^(.*)@", 1), "version_no": F.regexp_extract(name, r"@(\d+)\.", 1).cast("int")})
        f = lines.where(F.col("feature.type") == "Feature").select("dataset", "version_no", F.col("feature.geometry.type").alias("geom_type"), vector.parts(F.col("feature.geometry")).alias("parts"), F.transform_keys("feature.properties", lambda k, _: F.lower(k)).alias("attrs"))
        if rows.limit(1).count():
            poi_batch(f, out, lines.where("bad"))

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_files(uploads: DataFrame, event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """The first upload of each (dataset, checksum) that isn't rejected (status, where there is one); works on streams and
    tables. With the name of a timestamp column, state is kept for `delay` only: a copy that comes later counts as new."""
    live = uploads.where(~F.col("status").eqNullSafe("REJECTED")) if "status" in uploads.columns else uploads
    if event_time is None:
        return live.dropDuplicates(["dataset", "checksum"])
    return live.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["dataset", "checksum"])


def live_active(events: DataFrame) -> DataFrame:
    """dataset and the version last published, kept up to date (update or complete mode)."""
    return events.where("to_status = 'PUBLISHED'").groupBy("dataset").agg(F.max_by("version_no", F.struct("changed_at", "version_no")).alias("version_no"))


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Illegal (from, to) pairs of each version's events (dataset, version_no, to_status, changed_at) as they arrive; the last
    status is the state. Events of one batch are put in order; those of a version are expected in order across batches."""
    legal = set(catalog.TRANSITIONS)

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("changed_at", kind="stable")
        out = []
        for to in rows["to_status"]:
            if last is not None and (last, to) not in legal:
                out.append((key[0], int(key[1]), last, to))
            last = to
        state.update((last,))
        yield pd.DataFrame(out, columns=["dataset", "version_no", "from_status", "to_status"])

    return events.groupBy("dataset", "version_no").applyInPandasWithState(check, "dataset long, version_no int, from_status string, to_status string", "last string", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """Events of a version wait until the watermark has passed them, and are then looked at in order of their time."""

    def __init__(self, keep_ms: int):
        self.keep_ms, self.legal = keep_ms, set(catalog.TRANSITIONS)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, to_status string")
        self.last = handle.getValueState("last", "at bigint, status string")

    def handleInputRows(self, key, rows, timerValues):
        for r in rows:
            at = int(r["at"])
            self.waiting.appendValue((at, r["to_status"]))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, held = timerValues.getCurrentWatermarkInMs(), list(self.waiting.get())
        ready = sorted((r[0], r[1]) for r in held if r[0] <= passed)
        last = self.last.get() if self.last.exists() else None
        if not ready:
            # all that this timer was for has been let go, or it is the one that ends the state
            if last is not None and passed >= last[0] + self.keep_ms and all(h[0] > last[0] + self.keep_ms for h in held):
                self.last.clear()
            return
        rest = [(r[0], r[1]) for r in held if r[0] > passed]
        self.waiting.put(rest) if rest else self.waiting.clear()
        before, status = last if last is not None else (None, None)
        for at, to in ready:
            if status is not None and at - before <= self.keep_ms and (status, to) not in self.legal:
                yield Row(dataset=key[0], version_no=key[1], from_status=status, to_status=to)
            before, status = at, to
        self.last.update((ready[-1][0], status))
        self.handle.registerTimer(ready[-1][0] + self.keep_ms)

    def close(self) -> None:
        pass


def ordered_transitions(events: DataFrame, event_time: str = "changed_at", delay: str = "1 hour", keep_days: float = 365.0) -> DataFrame:
    """Illegal (from, to) pairs of each version's events (dataset, version_no, to_status and a timestamp), in order of time whatever
    the order of arrival: an event waits until the watermark, `delay` behind the newest, has passed it. What comes later than
    that is dropped; events of one time go by status. A version's state is what waits and its last status, and ends `keep_days` after its last event.

    The state store must be one with timers: spark.sql.streaming.stateStore.providerClass set to Spark's RocksDB provider."""
    kinds = {c: t for c, t in events.dtypes if c in ("dataset", "version_no")}
    rows = events.withWatermark(event_time, delay).select("dataset", "version_no", "to_status", event_time, F.unix_millis(event_time).alias("at"))
    schema = f"dataset {kinds['dataset']}, version_no {kinds['version_no']}, from_status string, to_status string"
    return rows.groupBy("dataset", "version_no").transformWithState(_InOrder(int(keep_days * 86_400_000)), schema, "append", "eventTime")


def accept_uploads(uploads: DataFrame, known: Callable[[], DataFrame], out: str, checkpoint: str):
    """Streams uploads (dataset, version_no, checksum, ...) into the snapshot table at `out`, without those whose checksum a version of
    the same dataset has that isn't rejected now: `known` reads (dataset, version_no, checksum, status) anew in every
    batch, so a version rejected after it arrived no longer hides its copy. Of copies in one batch the smallest version
    is taken. A batch that is run again writes the same partitions."""

    def batch(rows: DataFrame, _: int) -> None:
        live = known().where(~F.col("status").eqNullSafe("REJECTED")).select("dataset", "checksum", F.col("version_no").alias("other"))
        firsts = rows.groupBy("dataset", "checksum").agg(F.min("version_no").alias("version_no"))
        fresh = firsts.join(live, (firsts["dataset"] == live["dataset"]) & (firsts["checksum"] == live["checksum"]) & (firsts["version_no"] != live["other"]), "left_anti")
        taken = rows.join(fresh.select("dataset", "version_no"), ["dataset", "version_no"], "left_semi")
        if taken.limit(1).count():
            vector.write_snapshot(taken, out)

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
