"""Work that has to spread: what is shuffled, and how many tasks share it."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.01"


def test_a_frame_meets_its_pose_before_the_landmarks(spark):
    plan = entry.queries()["projected_landmarks_whole"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan.split("Join")[0]


def test_audio_of_one_small_file_is_dealt_to_several_tasks(spark):
    rows = entry.queries()["audio_features"](spark, FOLDER)
    assert rows.rdd.getNumPartitions() > 1


def test_clips_are_dealt_by_their_points(spark):
    from pyspark.sql import functions as F

    from touchline.operators import paths as P
    ends = spark.range(2000).select(F.lit(1).alias("match_id"), F.lit(1).alias("track_id"), F.col("id").alias("clip_id")).coalesce(1)
    assert P.deal_clips(ends, F.lit(480)).rdd.getNumPartitions() == 4


def test_clips_of_one_track_meet_its_boxes_in_shares(spark):
    from pyspark.sql import functions as F

    from touchline.operators import paths as P
    one = [F.lit(1).alias("match_id"), F.lit(1).alias("track_id")]
    ends = spark.range(700).select(*one, F.col("id").alias("clip_id"), (F.col("id") % 50 * 1.0).alias("start_s"), F.lit(70.0).alias("end_s"))
    boxes = spark.range(90).select(*one, (F.col("id") * 1.0).alias("t"))
    rows = P._inside(boxes, ends)
    assert "_share" in rows._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.clip_id, r.t) for r in rows.collect())
    assert got == [(c, float(t)) for c in range(700) for t in range(90) if c % 50 <= t <= 70]


def test_a_tracks_colors_need_its_rows_once(spark):
    from touchline.operators import teams as TM
    kit = "array(0.8D, id % 7 / 7D, id % 5 / 5D, id % 3 / 3D, 0.5D, 0.5D, 0D, 0D, 0D, 0D, 0D, 0D)"
    dets = spark.range(400).selectExpr("1L as match_id", "id % 9 as track_id", "50D + id % 60 as height_px", f"{kit} as kit")
    evidence = TM.kit_evidence(dets)
    plan = evidence._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    rows = TM.kit_rows(dets).selectExpr("match_id", "track_id", "kit").collect()
    for got in evidence.collect():
        own = sorted(r.kit for r in rows if r.track_id == got.track_id)
        middle = [sorted(k[i] for k in own) for i in range(1, 12)]
        assert got.weight == len(own) ** 0.5
        assert got.descriptor == [(v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2.0 for v in middle]


def test_many_small_components_are_solved_in_several_tasks(spark):
    from touchline.operators.matching import match_fragments
    # four fragments that all fit each other, many times over: none of their edges can go beforehand
    edges = spark.range(4000).selectExpr("id % 2 as match_id", "floor(id / 8) * 2 + floor(id / 2) % 2 as before",
                                         "5000 + floor(id / 8) * 2 + floor(id / 4) % 2 as after", "1D + id * 37 % 101 / 100 as cost")
    found = match_fragments(edges)
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in sizes) > 3
    assert found.count() == found.select("match_id", "before").distinct().count() == found.select("match_id", "after").distinct().count() == 2000


def test_a_fold_over_a_join_by_its_keys_meets_whole_keys(spark):
    from touchline.operators.blocks import Fold, fold_sorted

    class Count(Fold):
        def __init__(self, key):
            self.key, self.n = key[0], 0

        def step(self, row):
            self.n += 1
            return ()

        def close(self):
            return [(self.key, self.n)]

    rows = spark.range(20_000).selectExpr("id % 50 as k", "id as v").repartition(8)
    few = rows.groupBy("k").agg(F.count("v").alias("n")).where("n > 1")
    schema = StructType([StructField("k", LongType()), StructField("n", LongType())])
    got = fold_sorted(rows.join(few, "k"), ["k"], ["v"], Count, schema).collect()
    assert sorted((r.k, r.n) for r in got) == [(k, 400) for k in range(50)]


def test_a_cut_is_not_written_twice(spark):
    from touchline.session import cut
    once = cut(spark.range(10).selectExpr("id * 2 as id"))
    assert cut(once) is once


def test_all_detectors_meet_the_observations_once(spark, monkeypatch):
    from touchline.operators import events as E
    calls, real = [], E.nearest_player
    monkeypatch.setattr(E, "nearest_player", lambda *a: calls.append(1) or real(*a))
    found = entry.queries()["detect_events"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and found.count() > 0


def test_ball_windows_pass_each_row_once(spark):
    from touchline.operators import ball as B
    ball = spark.range(50).selectExpr("1L as match_id", "id as frame", "id / 5D as t", "id * 1D as x", "30D as y", "1D as measured")
    plan = B.frame_facts(B.ball_motion(ball, 100.0, 64.0), 100.0, 64.0)._jdf.queryExecution().optimizedPlan().toString()
    frames = set(re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*),", plan))
    assert frames == {"unboundedpreceding$()"}, frames


def test_origins_and_kicks_across_pauses(spark):
    from touchline.operators import ball as B
    rng, t, rows = random.Random(3), 0, []
    for f in range(900):
        t += rng.choice([40, 200, 200, 400]) if rng.random() > 0.05 else rng.choice([1001, 1500, 1600, 2500, 2600, 9000])
        speed = rng.choice([None, 1.0, 8.0, 8.0, 20.0])
        rows.append((1, f, t / 1000, float(f), 30.0, 1.0, t, speed, 0.9))
    motion = spark.createDataFrame(rows, "match_id long, frame long, t double, x double, y double, measured double, t_ms long, speed double, straight double")
    for got in B.frame_facts(motion, 100.0, 64.0).collect():
        now = got.t_ms
        reach = [r for r in rows if now - 1500 < r[6] <= now]
        still = [r for r in reach if r[7] is not None and r[7] < 4.0]
        old = [r for r in rows if now - 2500 <= r[6] <= now - 1500]
        assert got.origin.frame == (still or old or reach[:1])[-1][1]
        after = rows[got.frame + 1][6] if got.frame < 899 else None
        kicks = [r for r in rows if after is not None and r[7] == 20.0 and after <= r[6]]
        for ms, kick in ((3000, got.kick_after_3), (5000, got.kick_after_5)):
            want = [r[1] for r in kicks if r[6] <= after + ms][:1]
            assert ([] if kick is None else [kick.frame]) == want
