import random
import tempfile

import pytest
from pyspark.sql import functions as F

from touchline.operators import ball as B
from touchline.operators import metrics as M
from touchline.operators import tracking as TK
from touchline.operators.events import reconcile
from touchline.streaming import jobs
from touchline.streaming.ball import Ball, BallRules, shown, track_ball
from touchline.streaming.ordered import ball_stream, people_stream

BALL = ("match_id long, frame long, t double, dets array<struct<conf:double,u:double,v:double,w:double,h:double>>, "
        "step array<double>, full_frame boolean")


def ball_rows(seed=1, frames=160):
    rng = random.Random(seed)
    rows = []
    for match in (0, 1):
        u, v = 0.3, 0.2
        for f in range(frames):
            u, v = u + 0.004, v + rng.uniform(-0.004, 0.004)
            silent = 40 <= f < 70 or 100 <= f < 104
            dets = []
            if not silent and rng.random() < 0.8:
                dets.append((round(rng.uniform(0.3, 0.9), 3), u, v, 0.01, 0.01))
            if not silent and rng.random() < 0.3:
                dets.append((round(rng.uniform(0.3, 0.9), 3), rng.random(), rng.random() * 0.5, 0.01, 0.2 if f % 2 else 0.01))
            step = None if f % 9 == 0 else [1.0, 0.0, -0.001, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
            rows.append((match, f, f / 5.0, dets, step, f % 3 == 0))
    return rows


def feed(spark, df, parts, schema=None):
    """Write ``df`` as ``parts`` files in frame order and read them back as a stream, one file per trigger."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    last = df.agg(F.max("frame")).first()[0] + 1
    for i in range(parts):
        part = df.where((F.col("frame") >= last * i // parts) & (F.col("frame") < last * (i + 1) // parts))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, mode="append", checkpoint=None):
    checkpoint = checkpoint or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(
        availableNow=True).start()
    q.awaitTermination(170)
    q.stop()
    return out


def test_pieces_track_the_ball_like_one_pass(spark):
    rows = ball_rows()
    got = {(r.match_id, r.frame): tuple(r)[2:] for r in track_ball(spark.createDataFrame(rows, BALL), 5.0, 0.5625).collect()}
    rules, want = BallRules(5.0, 0.5625), {}
    for match in (0, 1):
        b = Ball()
        for m, f, _, dets, step, full in rows:
            if m == match:
                b = rules.advance(b, dets, step, full)
                want[(m, f)] = shown(b)
    assert got == want
    assert {"tracking", "coasting", "lost"} <= {s[0] for s in got.values()}


def test_ball_stream_is_the_batch(spark):
    df = spark.createDataFrame(ball_rows(2, 90), BALL)
    out = drain(ball_stream(feed(spark, df, 3), 5.0, 0.5625), "ball")
    live = {(r.match_id, r.frame): tuple(r)[2:] for r in spark.read.parquet(out).collect()}
    batch = {(r.match_id, r.frame): tuple(r)[2:] for r in track_ball(df, 5.0, 0.5625).collect()}
    assert len(live) >= 100
    assert all(batch[k] == v for k, v in live.items())


def test_people_stream_is_the_batch(spark):
    rng = random.Random(5)
    rows = [(0, f, f / 5.0, d, 10.0 * d + 0.2 * f + rng.random() * 0.1, 20.0, 0.3, None, None)
            for f in range(60) for d in range(3) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "match_id long, frame long, t double, det_id long, x double, y double, sigma_m double, "
                                     "kit array<double>, hint long")
    out = drain(people_stream(feed(spark, df, 2), 5.0), "people")
    live = {(r.frame, r.det_id): r.track_id for r in spark.read.parquet(out).collect()}
    batch = {(r.frame, r.det_id): r.track_id for r in TK.track_people(df, 5.0).collect()}
    assert len(live) > 60
    assert all(batch[k] == v for k, v in live.items())


def test_people_state_outlives_a_renamed_class(spark):
    """The job stops, its processor class gets another name, and goes on from the state's columns: colors, hints, numbers."""
    from touchline.streaming import ordered
    rng = random.Random(6)
    rows = [(0, f, f / 5.0, d, 10.0 * d + 0.2 * f + rng.random() * 0.1, 20.0, 0.3, [0.9, *[0.1 * d + rng.random() * 0.02] * 5] if d % 2 else None, 7 + d if d < 3 else None)
            for f in range(160) for d in range(5) if rng.random() < 0.9 and not (d == 4 and 30 < f < 60)]
    df = spark.createDataFrame(rows, "match_id long, frame long, t double, det_id long, x double, y double, sigma_m double, "
                                     "kit array<double>, hint long")
    path, check, out = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(3))
    first = ordered.PeopleInOrder
    try:
        for lo, hi, kind in ((0, 80, first), (80, 160, type("TrackerOfPeople", (first,), {}))):
            ordered.PeopleInOrder = kind
            df.where((F.col("frame") >= lo) & (F.col("frame") < hi)).coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(df.schema).parquet(path)
            q = people_stream(stream, 5.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(
                availableNow=True).start()
            q.awaitTermination(170)
            assert q.exception() is None
    finally:
        ordered.PeopleInOrder = first
    live = {(r.frame, r.det_id): r.track_id for r in spark.read.parquet(out).collect()}
    batch = {(r.frame, r.det_id): r.track_id for r in TK.track_people(df, 5.0).collect()}
    assert len([f for f, _ in live if f > 100]) > 150 and all(batch[k] == v for k, v in live.items())


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(7)
    rows = [(0, f, f / 5.0, d, d, d % 2, rng.random() * 100, rng.random() * 60, 50.0, 30.0) for f in range(1500) for d in range(3)]
    return spark.createDataFrame(rows, "match_id long, frame long, t double, det_id long, track_id long, team int, x double, "
                                       "y double, aim_x double, aim_y double").cache()


def test_momentum_stream_and_resume(spark, obs):
    stream = jobs.momentum_stream(feed(spark, obs, 3))
    live = {r.minute: tuple(r) for r in spark.read.parquet(drain(stream, "m")).collect()}
    batch = M.momentum(obs.drop("aim_x", "aim_y"), obs.select("match_id", "frame", "aim_x", "aim_y").distinct())
    want = {r.minute: tuple(r) for r in batch.collect()}
    assert live and all(want[k] == v for k, v in live.items())


def test_resume_gives_the_same_rows(spark):
    df = spark.createDataFrame([(0, f, f / 5.0, f % 17 < 12) for f in range(600)], "match_id long, frame long, t double, locked boolean")
    want = {tuple(r) for r in B.in_play(df).select("match_id", "start_frame", "frames", "end_frame").collect()}
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    check, out = tempfile.mkdtemp(prefix="run-", dir="/tmp"), tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for lo, hi in ((0, 200), (200, 600)):
        df.where((F.col("frame") >= lo) & (F.col("frame") < hi)).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).parquet(path)
        q = jobs.play_sessions(stream, 5.0).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(170)
    live = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert len(live) == len(set(live)) >= 25
    assert set(live) <= want


def test_reconcile_stream(spark):
    schema = "match_id long, event_id long, time_s double, type string, source string, verdict string"
    log = spark.createDataFrame([(0, 1, 10.0, "goal", "manual", ""), (0, 2, 30.0, "shot", "ball", ""), (0, 3, 50.0, "shot", "ball", "true"),
                                 (0, 4, 70.0, "other", "audio", ""), (1, 5, 5.0, "shot", "ball", "")], schema)
    fresh = spark.createDataFrame([(0, 11, 30.4, "shot", "ball", ""), (0, 12, 90.0, "shot", "ball", ""), (0, 13, 90.5, "goal", "ball", "")], schema)
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    log.write.mode("overwrite").partitionBy("match_id").parquet(path)
    run = jobs.reconcile_batches(path, "ball")
    for _ in range(2):  # a repeated batch changes nothing
        run(fresh, 0)
        got = {r.event_id for r in spark.read.parquet(path).collect()}
        assert got == {1, 2, 3, 4, 5, 12}
    kept, dropped = reconcile(log, fresh.where("event_id = 12"), "ball")
    assert {r.event_id for r in dropped.collect()} == {2, 5}
