import tempfile

from pyspark.sql import functions as F

from touchline.sources import clips as C
from touchline.sources import reports as R
from touchline.sources import segments as S
from touchline.sources import telemetry as T

LOG = """SDKV1.2-abc
Soccer mode
2024-05-01 10:00:00.000
Frame100 fps30 SZ7 Yaw-12.5 Pit3.0
BallSz12 TSz14 StaX1 Ballx640 OutX5
T1 RB2 xv3 yv-4 xm5 ym-60
AFilterP1 mot2 Deque2(V3,x40)(V-1,x41)
2024-05-01 10:00:00.200
Frame101 FIN:x10 y20 V1 YawErr2 out3 Ctrl:X4
 Y5 +Zoom:1.5 zoomSz8 In:1 Lock:2/3
Fast3 Crowdx900
not a line at all
BT7maySta PB(1,2,3,4)
Frame100 fps30 SZ9 Yaw-13.5 Pit3.5
BallSz9
boundary1 LX20 autoCenterX30
BT7RB(1,2,30,40)V-5toL Ballx700 OutX8
"""


def test_telemetry_file(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/a.json"
    with open(path, "w") as f:
        f.write(LOG)
    frames, unknown = T.read_telemetry(spark, path)
    rows = {r.frame: r for r in frames.collect()}
    assert set(rows) == {100, 101}
    a, b = rows[100], rows[101]
    # the motion line of frame 100 came twice: the last wins, its time does not move
    assert (a.yaw_deg, a.zoom_sz, a.time_s) == (-13.5, 9, 0.0)
    assert (a.ball_sz, a.target_sz, a.ball_x, a.ball_ym) == (12, 14, 640.0, -60.0)
    assert [(d.v, d.x) for d in a.deque] == [(3.0, 40.0), (-1.0, 41.0)]
    # unnumbered lines after it still belong to the newest frame, 101; its size line has no target
    assert (b.lock_a, b.lock_b, b.fin_zoom_sz, b.locked) == (2, 3, 8, True)
    assert (b.ball_sz, b.target_sz, b.ball_x, b.ball_dir, b.fast, b.crowd_x) == (9, None, 700.0, "L", 3, 900.0)
    assert abs(b.time_s - 0.2) < 1e-6
    assert unknown.first().unknown_lines == 1


def test_segment_round_trip(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.createDataFrame([(0, 0, 0, 3), (0, 0, 1, 2), (0, 0, 3, 4)], "match_id long, segment_id long, chunk long, n_frames long").write.parquet(f"{path}/chunks")
    spark.createDataFrame([(0, 0, c, f, 0.0) for c, n in ((0, 3), (1, 2), (3, 4)) for f in range(n)],
                          "match_id long, segment_id long, chunk long, frame long, t double").write.parquet(f"{path}/frames")
    spark.createDataFrame([(0, 0, 0, 2, 1), (0, 0, 1, 0, 1), (0, 0, 3, 0, 1)],
                          "match_id long, segment_id long, chunk long, frame long, det_id long").write.parquet(f"{path}/detections")
    frames, dets = S.read_segment(spark, path)
    assert sorted(r.frame for r in frames.collect()) == [0, 1, 2, 3, 4]
    assert sorted((r.frame, r.det_track) for r in dets.collect()) == [(2, None), (3, None)]


def test_ball_document(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/b.json"
    with open(path, "w") as f:
        f.write('{"match_id": 4,\n "frames": [{"i": 0, "t": 0.0, "status": "lost"},\n {"i": 1, "t": 0.2, "status": "tracking", "u": 0.5, "v": 0.2, "conf": 0.9}]}')
    rows = S.read_ball_track(spark, path).orderBy("frame").collect()
    assert [(r.match_id, r.frame, r.status, r.u) for r in rows] == [(4, 0, "lost", None), (4, 1, "tracking", 0.5)]


def test_report_and_events_round_trip(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    teams = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "match_id long, team long, players long")
    minutes = spark.createDataFrame([(0, 2, 0.6, 0.4, 31.0, 10, 1), (0, 11, 0.5, 0.5, 30.0, 8, 0)],
                                    "match_id long, minute long, team_0 double, team_1 double, action_x double, contested_frames long, uncontested_frames long")
    R.write_report(teams, minutes, path)
    assert sorted(map(tuple, R.read_report(spark, path).collect())) == sorted(map(tuple, minutes.collect()))
    odd = spark.createDataFrame([(0, '{"momentum": {"x": {"team_0": 0.5}, "3": {"team_0": 0.4}}}')], "match_id long, report string")
    assert [r.minute for r in R.momentum_of_report(odd).collect()] == [3]
    log = spark.createDataFrame([(0, 1.23456, "goal", None)], "match_id long, time_s double, type string, note string")
    R.write_events(log.withColumn("confidence", F.lit(0.98765)), f"{path}/events")
    row = R.read_events(spark, f"{path}/events").first()
    assert (row.time_s, row.confidence, row.note, row.team, row.source, row.verdict) == (1.235, 0.988, "", -1, "manual", "")


def test_old_names(spark):
    df = spark.createDataFrame([(1, 2)], "team_colours int, kept int")
    assert R.upgrade_columns(df, {"team_colours": "team_colors"}).columns == ["team_colors", "kept"]
    both = df.withColumn("team_colors", F.lit(9))
    assert R.upgrade_columns(both, {"team_colours": "team_colors"}).first().team_colors == 9


def test_one_unpaired_clip_voids_the_match(spark):
    clips = spark.createDataFrame([(0, "/x/cam 10:00:05.mp4"), (0, "/x/cam_10-10-00.mp4"), (1, "/x/10:00:05.mp4"), (1, "/x/none.mp4")], "match_id long, path string")
    logs = spark.createDataFrame([(0, "l 10:00:05 b.json"), (0, "l 10:00:05 a.json"), (0, "l 10:10:00.json"), (1, "l 10:00:05.json")], "match_id long, log string")
    got = {(r.match_id, r.path): r.log for r in T.pair_logs(clips, logs).collect()}
    assert got == {(0, "/x/cam 10:00:05.mp4"): "l 10:00:05 a.json", (0, "/x/cam_10-10-00.mp4"): "l 10:10:00.json"}


def test_clip_plan_counts_each_file_once(spark):
    clips = spark.createDataFrame([(0, "/a/02.mp4", 5.0), (0, "/a/01.mp4", 3.0), (0, "/a/02.mp4", 5.0)], "match_id long, path string, duration_s double")
    got = sorted((r.clip_no, r.path, r.start_s) for r in C.plan_clips(clips).collect())
    assert got == [(1, "/a/01.mp4", 0.0), (2, "/a/02.mp4", 3.0)]


def test_split_lines(spark):
    """Two and three parts, at a blank or within a word, behind noise, with stamps between; long noise counts again."""
    fast, size = "Fast3 Crowdx900", "BallSz9 TSz4"
    lines = ["Frame1 fps30 SZ7 Yaw-12.5 Pit3.0", "Fast3", "Crowdx900", "noise", "BallSz", "2024-05-01 10:00:00.000", "9 TS", "Z4", "boundary1 LX20 autoCenterX30",
             "Fa", size, "x" * 150, "y" * 150, "z" * 150, "Frame2 fps3", "0 SZ7 Yaw1 Pit2"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)] + [("b", 0, fast), ("c", 0, "only noise")], "path string, pos long, line string")
    frames, unknown = T.parse_lines(df)
    rows = {(r.path, r.frame): r for r in frames.collect()}
    assert set(rows) == {("a", 1), ("a", 2)}
    assert (rows["a", 1].fast, rows["a", 1].crowd_x, rows["a", 1].ball_sz, rows["a", 1].target_sz, rows["a", 2].yaw_deg) == (3, 900.0, 9, 4, 1.0)
    assert {r.path: r.unknown_lines for r in unknown.collect()} == {"a": 1 + 1 + 2, "b": 0, "c": 1}
