"""Rows that earlier rules lost: old and new columns side by side, missing verdicts, names of any script, clip joins."""

import math

import numpy as np
from pyspark.sql import functions as F

from touchline.functions import labels
from touchline.operators import events as E
from touchline.operators import highlights as H
from touchline.operators import whistle as WH
from touchline.sources import clips as C
from touchline.sources import reports as R
from touchline.streaming.jobs import reconcile_batches

LOG = "match_id long, event_id long, time_s double, type string, team long, note string, source string, confidence double, video string, verdict string"


def log(spark, rows):
    return spark.createDataFrame([(0, i, t, kind, 0, "", source, 0.5, "game", verdict) for i, t, kind, source, verdict in rows], LOG)


def test_upgrade_keeps_both_kinds_of_rows(spark):
    df = spark.createDataFrame([(1, "old", None), (2, None, "new"), (3, "old", "new")], "id int, score string, score_share string")
    assert {(r.id, r.score_share) for r in R.upgrade_columns(df, {"score": "score_share"}).collect()} == {(1, "old"), (2, "new"), (3, "new")}


def test_missing_verdicts_and_sources(spark):
    rows = [(1, 10.0, "goal", "ball", None), (2, 20.0, "goal", "ball", ""), (3, 30.0, "shot", None, None), (4, 40.0, "shot", "ball", "true"), (5, 50.0, "shot", "ball", None)]
    df = log(spark, rows)
    fresh = log(spark, [(9, 50.2, "shot", "ball", "")])
    kept, dropped = E.reconcile(df, fresh)
    assert {r.event_id for r in kept.collect()} == {3, 4, 5} and {r.event_id for r in dropped.collect()} == {1, 2}
    assert E.review_counts(df).first().unreviewed == 4
    assert {r.event_id for r in E.event_subset(df, "without_false").collect()} == {1, 2, 3, 4, 5}
    assert {r.event_id for r in E.event_subset(df, "manual").collect()} == {3}
    assert {r.time_s for r in H.build_moments(df).collect()} == {10.0, 20.0, 30.0, 40.0, 50.0}


def test_scan_without_findings_empties_its_match(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = log(spark, [(1, 10.0, "goal", "ball", None), (2, 20.0, "goal", "manual", None)])
    rows.unionByName(rows.withColumn("match_id", F.lit(7))).write.partitionBy("match_id").parquet(path)
    scan = log(spark, [(None, None, None, None, None)])
    reconcile_batches(path)(scan, 0)
    left = {(r.match_id, r.event_id) for r in spark.read.parquet(path).collect()}
    assert left == {(0, 2), (7, 1), (7, 2)}


def test_clips_in_order_of_whole_names(spark):
    names = ["AŠ-1", "BB-1", "A日", "C", "AB"]
    df = spark.createDataFrame([(0, f"/x/{n}", 10.0) for n in names] + [(0, "/x/C", 12.0)], "match_id long, path string, duration_s double")
    got = {r.path: (r.clip_no, r.start_s) for r in C.plan_clips(df).collect()}
    assert got == {f"/x/{n}": (i + 1, 10.0 * i) for i, n in enumerate(sorted(names, key=lambda n: n.encode()))}


def test_long_team_words(spark):
    word = "a" * 300
    assert spark.createDataFrame([(word,)], "w string").select(labels.suggest_team_name(F.col("w"))).first()[0] == "A" + "a" * 299 + "s"


def test_windows_run_across_clip_joins(spark):
    sr = 16_000
    wave = np.sin(np.arange(20_000) * 0.3).astype("float32") + np.linspace(0, 1, 20_000, dtype="float32")
    joins = [0, 7_001, 7_300, 20_000]  # the second clip is shorter than a window
    parts = [wave[a:b] for a, b in zip(joins, joins[1:])]
    clips = spark.createDataFrame([(0, str(i), a / sr) for i, a in enumerate(joins[:-1])], "match_id long, path string, start_s double")
    blocks = spark.createDataFrame([(0, str(i), 0, sr, p.tolist()) for i, p in enumerate(parts)], "match_id long, path string, offset long, sr int, samples array<float>")
    for size in (WH.HOP * 16, WH.HOP * 4096):
        got = {r.w: r.power for r in WH.spectra(WH.stitch_audio(blocks, clips, size)).collect()}
        want = WH._power(wave)
        assert sorted(got) == list(range(len(want)))
        assert all(np.allclose(got[w], want[w], rtol=1e-4, atol=1e-4) for w in got)


def test_hole_between_clips_is_silence(spark):
    sr = 16_000
    clips = spark.createDataFrame([(0, "a", 0.0), (0, "b", 1.0)], "match_id long, path string, start_s double")
    ones = [1.0] * 8_000
    blocks = spark.createDataFrame([(0, "a", 0, sr, ones), (0, "b", 0, sr, ones), (0, "a", 7_000, sr, ones[:1_000])],
                                   "match_id long, path string, offset long, sr int, samples array<float>")
    cells = {r.start: r.samples for r in WH.stitch_audio(blocks, clips, 12_800).collect()}
    assert sorted(cells) == [0, 12_800]
    assert cells[0] == ones and cells[12_800] == [0.0] * 3_200 + ones


def test_reels_by_weight(spark):
    rows = [(0, 10.0, 6.0, 16.0, 5.0, "goal", 1), (0, 20.0, 16.0, 26.0, 9.0, "shot", 2), (0, 100.0, 96.0, 106.0, 9.0, "goal", 3), (0, 400.0, 396.0, 406.0, 1.0, "shot", 4)]
    df = spark.createDataFrame(rows, "match_id long, time_s double, start_s double, end_s double, weight double, event_type string, i int").withColumn("ord", F.struct("i"))
    got = {(r.tier, r.i) for r in H.select_reels(df).collect()}
    assert got == {("clip", 2), ("goals", 1), ("goals", 3), ("match", 2), ("match", 3), ("match", 4)}
    assert not math.isnan(sum(r.weight for r in H.select_reels(df).collect()))


def test_detections_go_into_the_log(spark):
    old = log(spark, [(1, 10.0, "goal", "ball", None), (2, 30.0, "shot", "ball", "true"), (3, 50.0, "shot", "manual", "")])
    found = spark.createDataFrame([(0, 52, 10.4, "goal", 1, "n", "ball", 0.8, 7), (0, 400, 80.0, "corner", 0, "n", "ball", 0.6, None), (0, 150, 30.2, "shot", 0, "n", "ball", 0.5, 2)],
                                  "match_id long, frame long, time_s double, type string, team long, note string, source string, confidence double, player_track long")
    kept, dropped = E.rescan(old, found)
    rows = {(r.time_s, r.type, r.verdict, r.video) for r in kept.collect()}
    assert rows == {(10.0, "goal", "", "game"), (30.0, "shot", "true", "game"), (50.0, "shot", "", "game"), (80.0, "corner", "", "game")}
    assert dropped.count() == 0
    again, gone = E.rescan(kept, found.where("type <> 'corner'"))
    assert {r.type for r in gone.collect()} == {"corner"} and again.count() == 3
