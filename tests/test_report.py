import pytest
from fixture_match import LENGTH, WIDTH, tables
from pyspark.sql import functions as F

from touchline.operators import metrics as M
from touchline.operators import projection as P
from touchline.operators import tracking as TK
from touchline.plans.report import build_report


@pytest.fixture(scope="module")
def match(spark):
    frames, dets, truth, cal = tables(spark, frames=300)
    return frames, dets, truth, cal, build_report(dets, frames, cal, LENGTH, WIDTH, 5.0)


def test_projection_recovers_the_ground(spark, match):
    frames, dets, truth, cal, _ = match
    got = P.project_detections(dets, frames, cal).join(truth, ["match_id", "frame", "person"])
    err = got.where("valid").agg(F.expr("percentile(hypot(x - tx, y - ty), 0.5)").alias("e"), F.count("*").alias("n")).first()
    assert err.n > 1000 and err.e < 0.5


def test_tracks_are_pure(match):
    frames, dets, truth, cal, _ = match
    ground = M.on_pitch(P.project_detections(dets, frames, cal), LENGTH, WIDTH)
    who = TK.track_people(ground, 5.0).join(dets.select("match_id", "frame", "det_id", "person"), ["match_id", "frame", "det_id"])
    per = who.groupBy("match_id", "track_id", "person").count().groupBy("match_id", "track_id").agg(
        F.max("count").alias("top"), F.sum("count").alias("n"))
    sums = per.agg(F.sum("top").alias("top"), F.sum("n").alias("n")).first()
    assert sums.top / sums.n > 0.9


def test_teams_match_the_kits(match):
    frames, dets, truth, cal, report = match
    who = report.observations.join(dets.select("match_id", "frame", "det_id", "person"), ["match_id", "frame", "det_id"]).join(
        truth.select("match_id", "frame", "person", F.col("team").alias("side")), ["match_id", "frame", "person"])
    row = who.where("team >= 0 and side >= 0").agg(F.avg((F.col("team") == F.col("side")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert row.n > 500 and max(row.a, 1 - row.a) > 0.9


def test_distance_and_shares(match):
    frames, dets, truth, cal, report = match
    teams = {r.team: r for r in report.teams.collect()}
    assert set(teams) == {0, 1}
    assert abs(teams[0].possession_share + teams[1].possession_share - 1.0) < 1e-6
    fast = report.observations.groupBy("track_id").agg(F.sum("step_m").alias("d"), F.count("*").alias("n"))
    seen = fast.where("n > 50").agg((F.sum("d") / F.sum("n")).alias("per")).first()
    # the simulated people run 0.7 m per frame
    assert 0.5 < seen.per / 0.7 < 1.4


def test_two_runs_agree(spark, match):
    frames, dets, truth, cal, report = match
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    again = build_report(dets, frames, cal, LENGTH, WIDTH, 5.0)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, again.teams.collect())) == sorted(map(tuple, report.teams.collect()))
