"""The keyed review log: scans in parts, batches run again, crashes, compaction."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from touchline.operators.events import reconcile
from touchline.session import ship_package
from touchline.sources.event_store import EventStore

LOG = "match_id long, event_id long, time_s double, type string, source string, verdict string"
SCAN = LOG + ", scan_id long, last boolean"
ROWS = [(0, 1, 10.0, "goal", "manual", ""), (0, 2, 30.0, "shot", "ball", ""), (0, 3, 50.0, "shot", "ball", "true"),
        (0, 4, 70.0, "other", "audio", ""), (1, 5, 5.0, "shot", "ball", ""), (1, 6, 40.0, "corner", "ball", "")]


@pytest.fixture()
def store(spark):
    ship_package(spark)
    return EventStore.create(spark.createDataFrame(ROWS, LOG), tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/log")


def ids(store, **at):
    return {r.event_id for r in store.log(**at).collect()}


def found(event, t, match=0, scan=1, last=False):
    return (match, event, t, "shot" if t is not None else None, "ball", "", scan, last)


def test_a_scan_in_parts_applies_when_it_ends(spark, store):
    first = spark.createDataFrame([found(11, 30.4), found(12, 90.0)], SCAN)
    store.apply(first, 0, "ball")
    assert ids(store) == {1, 2, 3, 4, 5, 6}
    store.apply(spark.createDataFrame([found(13, 120.0), found(None, None, last=True)], SCAN), 1, "ball")
    # 2 is seen again, 12 and 13 are new, 3 is confirmed; the other match is not touched
    assert ids(store) == {1, 2, 3, 4, 5, 6, 12, 13}
    whole = spark.createDataFrame([found(11, 30.4), found(12, 90.0), found(13, 120.0)], SCAN).drop("scan_id", "last")
    kept, _ = reconcile(spark.createDataFrame([r for r in ROWS if r[0] == 0], LOG), whole, "ball")
    assert {r.event_id for r in kept.collect()} == ids(store) - {5, 6}
    store.apply(spark.createDataFrame([found(None, None, scan=2, last=True)], SCAN), 2, "ball")
    assert ids(store) == {1, 3, 4, 5, 6} and ids(store, before=2) == {1, 2, 3, 4, 5, 6, 12, 13}


def test_batches_run_again_and_old_scans(spark, store):
    a = spark.createDataFrame([found(21, 8.0, 1), found(22, 60.0, 1, last=True), found(23, 15.0, 0)], SCAN)
    b = spark.createDataFrame([found(24, 99.0, 0, last=True), found(25, 200.0, 1, scan=3), found(26, 201.0, 1, scan=2), found(27, 300.0, 1, scan=2, last=True)], SCAN)
    c = spark.createDataFrame([found(28, 400.0, 1, scan=3, last=True), found(29, 500.0, 1, scan=1, last=True)], SCAN)
    for number, batch in enumerate((a, b, c)):
        store.apply(batch, number)
        once = ids(store)
        store.apply(batch, number)
        assert ids(store) == once
    assert once == {1, 3, 23, 24, 25, 28}


def test_two_scans_of_a_match_end_in_one_batch(spark, store):
    store.apply(spark.createDataFrame([found(31, 90.0, scan=5, last=True), found(32, 90.5, scan=7), found(33, 300.0, scan=7, last=True)], SCAN), 0, "ball")
    # 32 is 31 again within the gap; 33 is new
    assert ids(store) == {1, 3, 4, 5, 6, 31, 33}


def test_a_crash_half_way(spark, store, monkeypatch):
    batch = spark.createDataFrame([found(41, 90.0, last=True), found(42, 200.0, 1)], SCAN)
    write = EventStore._write
    for stop in ("delta", "staged", "scans"):
        def dies(self, rows, kind, number):
            write(self, rows, kind, number)
            if kind == stop:
                os.remove(f"{self.path}/{kind}/seq={number}/_SUCCESS")
                raise OSError("gone")
        monkeypatch.setattr(EventStore, "_write", dies)
        with pytest.raises(OSError):
            store.apply(batch, 0, "ball")
        monkeypatch.setattr(EventStore, "_write", write)
        store.apply(batch, 0, "ball")
        assert ids(store) == {1, 3, 4, 5, 6, 41}
    store.apply(spark.createDataFrame([found(None, None, 1, last=True)], SCAN), 1, "ball")
    assert ids(store) == {1, 3, 4, 41, 42}


def test_compaction_changes_nothing(spark, store):
    for number in range(4):
        store.apply(spark.createDataFrame([found(50 + number, 100.0 * number + 90, scan=number, last=True)], SCAN), number, "ball")
    want = sorted(map(tuple, store.log().collect()))
    store.compact(2)
    assert sorted(map(tuple, store.log().collect())) == want
    store.clean()
    assert sorted(map(tuple, store.log().collect())) == want and store._numbers("base") == [2] and store._numbers("delta") == [3]
    late = spark.createDataFrame([found(60, 1000.0, scan=9, last=True)], SCAN)
    store.apply(late, 4, "ball")
    assert 60 in ids(store)


def test_as_a_stream(spark, store):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    parts = [[found(71, 90.0)], [found(72, 300.0), found(73, 60.0, 1)], [found(None, None, last=True)], [found(None, None, 1, last=True)]]
    for rows in parts:
        spark.createDataFrame(rows, SCAN).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.writeStream.foreachBatch(store.batches("ball", compact_every=2)).option("checkpointLocation", tempfile.mkdtemp(prefix="run-", dir="/tmp")).trigger(
        availableNow=True).start()
    q.awaitTermination(170)
    assert q.exception() is None and ids(store) == {1, 3, 4, 71, 72, 73}
