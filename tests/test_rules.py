"""Sequential and selection rules against plain walks over small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import ball as B
from touchline.operators import detectors as D
from touchline.operators import events as E
from touchline.operators import highlights as H
from touchline.operators import identity as I
from touchline.operators import metrics as M
from touchline.operators import paths as P
from touchline.operators import whistle as WH


def test_dedupe_keeps_the_surest_in_place(spark):
    rng = random.Random(4)
    rows = [(0, i, round(rng.uniform(0, 60), 1), rng.choice(["shot", "goal"]), round(rng.random(), 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "match_id long, frame long, time_s double, type string, confidence double")
    kept = []
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[1])):
        clash = next((k for k in kept if k[3] == r[3] and abs(k[2] - r[2]) < 3.0), None)
        if clash is None:
            kept.append(r)
        elif r[4] > clash[4]:
            kept[kept.index(clash)] = r
    assert {r.frame for r in E.dedupe_events(df).collect()} == {r[1] for r in kept}


def test_reels_are_the_greedy_walk(spark):
    rng = random.Random(6)
    rows = []
    for match in (0, 1):
        for i in range(60):
            t = round(rng.uniform(0, 600), 1)
            kind = rng.choice(["shot", "other", "save"] if match else ["goal", "shot", "other", "corner"])
            rows.append((match, t, max(0.0, t - 4), t + rng.choice([6.0, 15.0, 40.0]), rng.choice([1.0, 1.6, 3.0, 10.0]), kind, i))
    df = spark.createDataFrame(rows, "match_id long, time_s double, start_s double, end_s double, weight double, event_type string, i long")
    df = df.withColumns({"ord": F.struct(F.lit(0).alias("k"), F.col("i").cast("double").alias("t"), F.col("i").alias("i")), "reason": F.lit(""),
                         "team": F.lit(-1), "video": F.lit("")})
    got = {(r.match_id, r.tier, r.i) for r in H.select_reels(df).collect()}
    want = set()
    for match in (0, 1):
        mine = sorted((r for r in rows if r[0] == match), key=lambda r: (-r[4], r[6]))
        for tier, budget in H.TIERS.items():
            pool = mine
            if tier == "goals":
                pool = [r for r in mine if r[5] in ("goal", "penalty")] or [r for r in mine if r[5] in ("shot", "save", "block")]
            chosen, used = [], 0.0
            for r in pool:
                length = max(15.0, r[3] - r[2])
                length = min(30.0, length) if tier == "clip" else length
                if (used + length > budget and chosen) or any(abs(r[1] - c[1]) < 20.0 for c in chosen):
                    continue
                chosen.append(r)
                used += length
                if used >= budget:
                    break
            want |= {(match, tier, c[6]) for c in chosen}
    assert got == want


def test_iou_match_is_the_greedy_walk(spark):
    rng = random.Random(8)

    def boxes():
        out = []
        for f in range(8):
            for d in range(6):
                x, y = rng.uniform(0, 0.3), rng.uniform(0, 0.2)
                out.append((0, f, d, x, y, x + 0.2, y + 0.25))
        return out

    a, b = boxes(), boxes()
    schema = "match_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double"
    got = {(r.frame, r.a_id, r.b_id) for r in D.iou_match(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    want = set()
    for f in range(8):
        pairs = []
        for p in (r for r in a if r[1] == f):
            for q in (r for r in b if r[1] == f):
                w, h = min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])
                inter = max(0, w) * max(0, h)
                pairs.append((inter / (2 * 0.2 * 0.25 - inter), p[2], q[2]))
        used_a, used_b = set(), set()
        for iou, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
            if iou >= 0.5 and i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                want.add((f, i, j))
    assert got == want and len(want) > 10


def test_center_restart_counts_the_frame_that_breaks_it(spark):
    # calm at the center for 1.8 s, then gone at 2.0 s: the breaking frame completes the two seconds
    def facts(calm):
        rows = [(0, f, f / 5.0, 50.0 if f < calm else 80.0, 32.0, 1.0, 1.0 if f < calm else 30.0, 0.0, 0.0, 0.5, f * 200) for f in range(30)]
        df = spark.createDataFrame(rows, "match_id long, frame long, t double, x double, y double, measured double, speed double, vx double, "
                                         "vy double, straight double, t_ms long")
        return {r.frame for r in B.frame_facts(df, 100.0, 64.0).where("reset").collect()}

    assert facts(10) == {0}
    assert facts(9) == set()


def test_touches_give_a_tie_to_the_later_track(spark):
    obs = spark.createDataFrame([(0, 1, 0, 10.0, 10.0), (0, 2, 0, 14.0, 10.0)], "match_id long, track_id long, frame long, x double, y double")
    aim = spark.createDataFrame([(0, 0, 12.0, 10.0)], "match_id long, frame long, aim_x double, aim_y double")
    assert [r.track_id for r in M.touches(obs, aim).collect()] == [2]


def test_bystander_never_left_its_spot(spark):
    rows = [(0, k, 0, f, f / 5.0, x(f), 5.0, 0.3) for k, x in ((1, lambda f: 5.0), (2, lambda f: 5.0 + 0.4 * f)) for f in range(80)]
    df = spark.createDataFrame(rows, "match_id long, track_id long, team int, frame long, t double, x double, y double, sigma_m double")
    assert [r.track_id for r in M.bystanders(M.build_tracks(M.speeds(df))).collect()] == [1]


@pytest.mark.parametrize("readings,number", [(["7"] * 3, 7), (["7", "7"], None), (["7", "8", "9"], None), (["07", "7", "no 7"], 7), (["100"] * 4, None)])
def test_votes(spark, readings, number):
    df = spark.createDataFrame([(0, 1, i, d, 0.8) for i, d in enumerate(readings)], "match_id long, track_id long, det_id long, digits string, confidence double")
    got = I.vote_numbers(df).collect()
    assert [r.number for r in got] == ([] if number is None else [number])


def test_crop_path_matches_numpy(spark):
    rng = np.random.default_rng(3)
    times = np.arange(0, 12, 0.2)
    boxes = np.array([(0.3 + 0.02 * t + rng.normal(0, 0.003), 0.2, 0.33 + 0.02 * t, 0.28) for t in times])
    b = spark.createDataFrame([(0, 1, float(t), *map(float, r)) for t, r in zip(times, boxes)],
                              "match_id long, track_id long, t double, x1 double, y1 double, x2 double, y2 double")
    c = spark.createDataFrame([(0, 1, 9, 2.1, 6.0)], "match_id long, track_id long, clip_id long, start_s double, duration_s double")
    got = [(round(r.t, 6), r.x, r.y) for r in P.crop_path(b, c, 3840, 2160, rate_hz=10.0).orderBy("t").collect()]
    start, length, rate = 2.1, 6.0, 10.0
    inside = (times >= start) & (times <= start + length)
    cx, cy = (boxes[inside, 0] + boxes[inside, 2]) * 1920, (boxes[inside, 1] + boxes[inside, 3]) * 1920
    height = np.median(np.abs(boxes[inside, 3] - boxes[inside, 1])) * 3840
    crop_h = round(min(max(height / 0.25, 480), 2160) / 2) * 2
    crop_w = round(min(crop_h * 3840 / 2160, 3840) / 2) * 2
    grid = np.unique(np.round(np.linspace(0, length, int(np.ceil(length * rate)) + 1) * rate) / rate)
    grid = np.append(grid[grid < length - 1e-9], length)

    def smooth(v, n=7):
        return np.convolve(np.pad(v, (n // 2, n - 1 - n // 2), mode="edge"), np.ones(n) / n, mode="valid")

    xs = np.clip(smooth(np.interp(start + grid, times[inside], cx)) - crop_w / 2, 0, 3840 - crop_w)
    ys = np.clip(smooth(np.interp(start + grid, times[inside], cy)) - crop_h / 2, 0, 2160 - crop_h)
    full = [(round(float(t), 6), round(float(x)), round(float(y))) for t, x, y in zip(grid, xs, ys)]
    want = [p for i, p in enumerate(full) if i == 0 or p[1:] != full[i - 1][1:] or i == len(full) - 1]
    assert got == want


def test_whistle_is_found_and_a_voice_is_not(spark):
    sr, rng = 16000, np.random.default_rng(0)
    t = np.arange(sr * 8) / sr
    wave = rng.normal(0, 0.01, len(t))
    wave[2 * sr:int(2.6 * sr)] += np.sin(2 * np.pi * 3100 * t[: int(0.6 * sr)])
    for f in (300, 600, 900, 2700):
        wave[5 * sr:int(5.6 * sr)] += np.sin(2 * np.pi * f * t[: int(0.6 * sr)])
    size = 4096
    blocks = [(0, s, sr, [float(v) for v in wave[s:s + size + 384]]) for s in range(0, len(wave), size)]
    df = spark.createDataFrame(blocks, "match_id long, start long, sr int, samples array<float>")
    features = WH.window_features(df).cache()
    whole = WH._power(wave)
    power = {r.w: r.power for r in WH.spectra(df).where("w in (31, 32, 500)").collect()}
    assert set(power) == {31, 32, 500} and all(np.allclose(power[w], whole[w], rtol=1e-3, atol=1e-4) for w in power)
    assert features.count() == len(whole)
    got = WH.detect_whistles(features, sr).collect()
    assert [round(r.time_s) for r in got] == [2] and abs(got[0].frequency_hz - 3100) < 50
    everything = WH.detect_whistles(features, sr, max_voice=None, max_low=None).collect()
    assert sorted(round(r.time_s) for r in everything) == [2, 5]
