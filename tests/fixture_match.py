"""A small seeded match with known truth: people on a pitch seen by one panning camera."""

from __future__ import annotations

import numpy as np

LENGTH, WIDTH, FPS = 60.0, 40.0, 5.0
POSITION, TILT, FOCAL, SCALE, ASPECT = (30.0, -7.0, 4.5), 0.18, 0.82, 1.04, 9 / 16
# the two kits differ by more than the stitching gate (0.45), as red and blue shirts do
KITS = {0: (0.45, 0.80, 0.65, 0.90, 0.65), 1: (0.40, 0.40, 0.25, 0.50, 0.60), -1: (0.75, 0.52, 0.52, 0.15, 0.85)}


def base_rotation():
    s, c = np.sin(TILT), np.cos(TILT)
    return np.array([[1, 0, 0], [0, -s, c], [0, -c, -s]])


def simulate(match: int, frames: int = 300, players: int = 5, seed: int = 1):
    """Rows of frames, detections and truth."""
    rng = np.random.default_rng(seed + match)
    people = [(t, k) for t in (0, 1) for k in range(players)] + [(-1, 0)]
    xy = rng.uniform((8, 6), (LENGTH - 8, WIDTH - 6), (len(people), 2))
    goal = rng.uniform((4, 4), (LENGTH - 4, WIDTH - 4), (len(people), 2))
    base = base_rotation()
    frame_rows, det_rows, truth = [], [], []
    for f in range(frames):
        pan = 0.15 * np.sin(f / 25.0)
        q = np.array([[np.cos(pan), 0, np.sin(pan)], [0, 1, 0], [-np.sin(pan), 0, np.cos(pan)]])
        frame_rows.append((match, f, f / FPS, [float(v) for v in q.ravel()], FOCAL, True))
        det = 0
        for i, (team, _) in enumerate(people):
            way = goal[i] - xy[i]
            far = np.hypot(*way)
            if far < 1.5:
                goal[i] = rng.uniform((4, 4), (LENGTH - 4, WIDTH - 4))
            xy[i] += way / max(far, 1e-6) * min(0.7, far)
            truth.append((match, f, i, team, float(xy[i, 0]), float(xy[i, 1])))
            world = np.array([xy[i, 0] - POSITION[0], xy[i, 1] - POSITION[1], -POSITION[2]])
            cam = world @ (base @ q)
            if cam[2] <= 0:
                continue
            k = FOCAL * SCALE
            u, v = k * cam[0] / cam[2] + 0.5, k * cam[1] / cam[2] + 0.5 * ASPECT
            if not (0 <= u <= 1 and 0 <= v <= ASPECT) or rng.random() > 0.93:
                continue
            u, v = u + rng.normal(0, 1 / 1920), v + rng.normal(0, 1 / 1920)
            h = 0.06
            color = np.array(KITS[team]) + rng.normal(0, 0.02, 5)
            det_rows.append((match, f, det, float(u - 0.01), float(v - h), float(u + 0.01), float(v), 0.9,
                             [0.8, *[float(c) for c in color], *[0.1] * 6], None, i))
            det += 1
    return frame_rows, det_rows, truth


def tables(spark, matches=1, **kw):
    f, d, t = [], [], []
    for m in range(matches):
        a, b, c = simulate(m, **kw)
        f, d, t = f + a, d + b, t + c
    frames = spark.createDataFrame(f, "match_id long, frame long, t double, q array<double>, focal double, ok boolean")
    dets = spark.createDataFrame(d, "match_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, "
                                    "kit array<double>, hint long, person long")
    truth = spark.createDataFrame(t, "match_id long, frame long, person long, team int, tx double, ty double")
    cal = spark.createDataFrame([(m, list(POSITION), [float(v) for v in base_rotation().ravel()], SCALE, ASPECT) for m in range(matches)],
                                "match_id long, position array<double>, base array<double>, focal_scale double, aspect double")
    return frames, dets, truth, cal
