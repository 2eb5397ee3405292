"""The report and the detected events as queries: every step from their tables to their rows."""

import json

import pytest
from fixture_match import LENGTH, WIDTH, tables
from pyspark.sql import functions as F

import __spark_entry__ as entry
from touchline.operators import metrics as M
from touchline.operators import projection as P
from touchline.operators import teams as TM
from touchline.plans import catalog_geometry as CG
from touchline.plans.report import build_report
from touchline.plans.views import PITCH, Tables

FRAMES = 240


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One match of 240 frames, the last 20 without a detection."""
    at = str(tmp_path_factory.mktemp("tables"))
    parts = {
        "orders": spark.range(FRAMES).selectExpr("id as o_orderkey"),
        "lineitem": spark.range(FRAMES - 20).selectExpr("id as l_orderkey", "explode(sequence(1, 6)) as l_linenumber").selectExpr(
            "l_orderkey", "l_linenumber", "1 + (l_linenumber * 971 + floor(l_orderkey / 4) * 100) % 20000 as l_partkey", "1L as l_suppkey"),
        "supplier": spark.range(3).selectExpr("id as s_suppkey"),
        "events": spark.range(600).selectExpr("id as event_id", "id % 50 as user_id", "if(id % 3 = 0, 'error', 'view') as event_type"),
        "customer": spark.range(50).selectExpr("id as c_custkey", "'segment' as c_mktsegment"),
        "part": spark.range(60).selectExpr("id as p_partkey", "'name' as p_name"),
    }
    for name, rows in parts.items():
        rows.write.parquet(f"{at}/{name}.parquet")
    return at


def test_the_report_query_does_the_whole_report(spark, folder):
    rows = entry.queries()["build_report"](spark, folder).collect()
    assert [r.match_id for r in rows] == [0]
    told = json.loads(rows[0].report)
    assert {"teams", "players", "momentum", "notes", "pitch", "detections_used", "frames_analyzed", "attack", "field_players"} <= set(told)
    assert [t["team"] for t in told["teams"]] == [0, 1]
    T = Tables(spark, folder)
    poses = P.apply_drift(CG._frames(T), CG._anchors(T))
    used = M.on_pitch(P.project_detections(T["dets"], poses, CG._calibrations(T)), *PITCH).count()
    assert 0 < used < T["dets"].count() and told["detections_used"] == used
    assert told["frames_analyzed"] == FRAMES
    assert told["players"] and {p["track_id"] for p in told["field_players"]} <= {p["track_id"] for p in told["players"]}


def test_the_query_gives_the_job_what_the_camera_saw(spark, folder, monkeypatch):
    from touchline.plans import report as RP
    seen = {}

    class Enough(Exception):
        pass

    def stop(detections, frames, calibrations, length, width, rate=None, anchors=None, marks=None):
        seen.update(detections=detections, rate=rate, anchors=anchors, marks=marks)
        raise Enough

    monkeypatch.setattr(RP, "build_report", stop)
    with pytest.raises(Enough):
        entry.queries()["build_report"](spark, folder)
    assert seen["rate"] is None and seen["anchors"] is not None and seen["marks"] is not None
    assert seen["detections"].where("hint is null or x1 is null").isEmpty()


def test_repeated_frames_bare_matches_and_small_crops(spark, monkeypatch):
    frames, dets, truth, cal = tables(spark, matches=2, frames=200)
    dets = dets.where("match_id = 0").withColumn("y1", F.when(F.col("person").isin(4, 9), F.col("y2") - 0.02).otherwise(F.col("y1")))
    given, real = [], TM.team_colors
    monkeypatch.setattr(TM, "team_colors", lambda labels, evidence: given.append(evidence) or real(labels, evidence))
    report = build_report(dets, frames.unionByName(frames), cal, LENGTH, WIDTH)
    assert report.observations.groupBy("match_id", "frame", "det_id").count().where("count > 1").isEmpty()
    # tracks that only small crops tell of are labeled, and color their team
    known = report.labels.where("team >= 0")
    assert known.join(given[0], ["match_id", "track_id"], "left_anti").isEmpty()
    small = report.observations.where("height_px < 60").join(known, ["match_id", "track_id"], "left_semi")
    assert not small.isEmpty()
    teams = {(r.match_id, r.team): r for r in report.teams.collect()}
    assert set(teams) == {(m, t) for m in (0, 1) for t in (0, 1)}
    assert all(len(teams[0, t].kit_rgb) == 3 and teams[0, t].players_observed > 0 for t in (0, 1))
    assert all(teams[1, t].kit_rgb is None and teams[1, t].players_observed == 0 and teams[1, t].possession_share == 0 for t in (0, 1))
    told = {r.match_id: json.loads(r.report) for r in report.documents().collect()}
    assert told[1]["detections_used"] == 0 and told[1]["frames_analyzed"] == 200 and "players" not in told[1]
    assert told[0]["teams"][0]["kit_rgb"] == teams[0, 0].kit_rgb


def test_detected_events_have_shirt_numbers_and_halves(spark, folder, monkeypatch):
    from touchline.operators import events as E
    given, real = [], E.detect_events
    monkeypatch.setattr(E, "detect_events", lambda *a: given.append(a) or real(*a))
    rows = entry.queries()["detect_events"](spark, folder).collect()
    people = {r.track_id: r for r in Tables(spark, folder)["people"].where("match_id = 0").collect()}

    def number(track):
        one = people.get(track)
        if one is None:
            return None
        if track % 3 == 0 and (one.number or (one.name or "").strip()):
            return one.number
        return one.number + 1 if track % 2 == 0 and one.number is not None else None

    assert rows and [r.player_number for r in rows] == [number(r.player_track) for r in rows]
    assert any(r.player_number is not None for r in rows)
    sides, marks = given[0][2], given[0][6]
    assert {r.match_id for r in marks.collect()} == {0, 1, 2} and "half" in sides.columns


def _kicks(spark):
    """The ball is struck out of the left third at 20 s and 60 s, each time by the player of team 0 beside it; the teams change ends at 40 s."""
    ball, obs = [], []
    for f in range(400):
        k = min(max(f - 100, 0), 10) if f < 250 else min(max(f - 300, 0), 10)
        ball.append((1, f, f / 5, 20.0 + 4.4 * k, 20.0, 1.0))
        first = f < 200
        for track, team, x, y in ((1, 0, 20.0, 21.0), (2, 0, 10.0 if first else 95.0, 40.0), (3, 1, 80.0 if first else 5.0, 40.0), (4, 0, 10.0 if first else 95.0, 50.0)):
            obs.append((1, track, team, f, f / 5, x, y, 0.0))
    return (spark.createDataFrame(ball, "match_id long, frame long, t double, x double, y double, measured double"),
            spark.createDataFrame(obs, "match_id long, track_id long, team long, frame long, t double, x double, y double, speed_kmh double"))


def test_events_by_halves_and_one_number_a_track(spark):
    from touchline.operators import ball as B
    from touchline.operators import events as E
    ball, obs = _kicks(spark)
    whistles = spark.createDataFrame([], "match_id long, time_s double")
    numbers = spark.createDataFrame([(1, 1, 9), (1, 1, 7)], "match_id long, track_id long, number long")

    def cleared(start, half, end):
        marks = spark.createDataFrame([(1, start, half, end)], "match_id long, start_s double, half_s double, end_s double")
        facts = B.frame_facts(B.ball_motion(ball, 100.0, 64.0), 100.0, 64.0)
        found = E.detect_events(facts, obs, M.orientations(obs, marks), whistles, 100.0, 64.0, marks, numbers).collect()
        return [(round(r.time_s), r.player_number) for r in found if r.type == "clearance"]

    assert cleared(0.0, 40.0, 80.0) == [(20, 7)]
    # nobody is seen in the second half that was marked: it has no sides, and does not take those of the first
    assert cleared(0.0, 40.0, 40.0) == [(20, 7)]
    assert sorted(cleared(None, 40.0, 80.0)) != [(20, 7)]
