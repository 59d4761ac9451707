"""Events that arrive late and out of order give what the table gives; state ends; rejected versions hide no copy."""

import random
from datetime import datetime, timedelta

import pytest

from geoweft.operators import catalog
from geoweft.streaming import ingest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, before)


def run(spark, events, tmp_path, batches, **options):
    """The stream's rows, a batch a file in the order given, then one event far ahead that lets all others go."""
    src = tmp_path / "src"
    schema = "dataset string, version_no int, to_status string, changed_at timestamp"
    for k, rows in enumerate([*batches, [("end", 0, "UPLOADED", START + timedelta(days=90))], [("end", 0, "VALIDATING", START + timedelta(days=91))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b{k:02d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = ingest.ordered_transitions(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return sorted((r.dataset, r.version_no, r.from_status, r.to_status) for r in spark.read.parquet(out).collect()), q


def test_out_of_order_events_give_the_tables_answer(rocks, tmp_path):
    r = random.Random(4)
    names = sorted({a for pair in catalog.TRANSITIONS for a in pair})
    events = [("d", v, r.choice(names), START + timedelta(minutes=10 * k + v)) for v in range(3) for k in range(12)]
    # each event at most 50 minutes late
    arriving = sorted(events, key=lambda e: e[3] + timedelta(minutes=r.randrange(50)))
    got, _ = run(rocks, events, tmp_path, [arriving[k : k + 12] for k in range(0, 36, 12)])
    table = rocks.createDataFrame(events, "dataset string, version_no int, to_status string, changed_at timestamp")
    want = sorted((x.dataset, x.version_no, x.from_status, x.to_status) for x in catalog.illegal(catalog.transitions(table)).collect())
    assert got == want and len(want) > 5


def test_state_ends(rocks, tmp_path):
    days = lambda n: START + timedelta(days=n)
    batches = [[("a", 1, "UPLOADED", days(0))], [("b", 1, "UPLOADED", days(20))], [("c", 1, "UPLOADED", days(40)), ("a", 1, "PUBLISHED", days(40))]]
    got, q = run(rocks, [], tmp_path, batches, keep_days=10.0)
    assert got == []  # what a had been was forgotten
    totals = [p["stateOperators"][0]["customMetrics"] for p in q.recentProgress if p["stateOperators"]]
    assert totals  # one version's state at the end, and no more than were within ten days
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6


def test_rejected_versions_hide_no_copy(spark, tmp_path):
    src, out, status = tmp_path / "up", str(tmp_path / "taken"), str(tmp_path / "status")
    schema, states = "dataset string, version_no int, checksum string", "dataset string, version_no int, checksum string, status string"
    known = lambda: spark.read.schema(states).parquet(status)
    go = lambda: ingest.accept_uploads(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src)), known, out, str(tmp_path / "ck")).awaitTermination(120)
    spark.createDataFrame([], states).write.parquet(status)
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")], schema).write.parquet(str(src / "1"))
    go()
    taken = lambda: sorted((r.dataset, r.version_no) for r in spark.read.parquet(out).collect())
    assert taken() == [("a", 1), ("b", 1)]
    spark.createDataFrame([("a", 1, "x", "REJECTED"), ("b", 1, "x", "VALIDATED")], states).write.mode("overwrite").parquet(status)
    spark.createDataFrame([("a", 3, "x"), ("b", 2, "x"), ("b", 3, "y")], schema).write.parquet(str(src / "2"))
    go()
    assert taken() == [("a", 1), ("a", 3), ("b", 1), ("b", 3)]
