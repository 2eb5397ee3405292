"""Blocks walked from guessed states equal one walk, on matches without any silence."""

import random

import numpy as np
import pytest

from touchline.operators import tracking as TK
from touchline.session import ship_package
from touchline.streaming import ball as B

BALL = ("match_id long, frame long, dets array<struct<conf:double,u:double,v:double,w:double,h:double>>, step array<double>, full_frame boolean")
PEOPLE = "match_id long, frame long, det_id long, x double, y double, sigma_m double, kit array<double>, hint long"


@pytest.mark.parametrize("block", [40, 300, 4096])
def test_ball_without_silence(spark, block):
    ship_package(spark)
    rng = random.Random(4)
    rows = []
    for match in (0, 1):
        u = 0.2
        for f in range(700):
            u = (u + 0.004) % 1.0
            dets = [(round(rng.uniform(0.3, 0.9), 3), u, 0.2 + rng.uniform(-0.004, 0.004), 0.01, 0.01)] if rng.random() < 0.9 else []
            dets += [(round(rng.uniform(0.3, 0.9), 3), rng.random(), rng.random() * 0.5, 0.01, 0.01)] if rng.random() < 0.2 else []
            rows.append((match, f, dets, None, f % 3 == 0))
    got = {(r.match_id, r.frame): tuple(r)[2:] for r in B.track_ball(spark.createDataFrame(rows, BALL), 5.0, 0.5625, block=block).collect()}
    rules, want = B.BallRules(5.0, 0.5625), {}
    for match in (0, 1):
        ball = B.Ball()
        for m, f, dets, step, full in rows:
            if m == match:
                ball = rules.advance(ball, dets, step, full)
                want[m, f] = B.shown(ball)
    assert got == want


@pytest.mark.parametrize("block", [50, 500, 4096])
def test_people_without_silence(spark, block):
    """Players who are always there, others who come and go, colors and hints; blocks that start wrong walk again."""
    rng = random.Random(7)
    rows = []
    for match in (0, 3):
        place = [[10.0 * p, 20.0] for p in range(8)]
        for f in range(900):
            for p, at in enumerate(place):
                at[0] += rng.uniform(-0.3, 0.3)
                at[1] += rng.uniform(-0.3, 0.3)
                seen = rng.random() < (0.97 if p < 5 else 0.9) and not (p >= 5 and (f // 40 + p) % 3 == 0)
                if seen:
                    kit = [0.9, *[round(rng.random() * 0.05 + 0.1 * (p % 2), 4) for _ in range(5)]] if p % 3 else None
                    rows.append((match, f, p, at[0], at[1], 0.3, kit, p * 7 if p % 4 == 1 else None))
    got = {(r.match_id, r.frame, r.det_id): r.track_id for r in TK.track_people(spark.createDataFrame(rows, PEOPLE), 5.0, block=block).collect()}
    want = {}
    for match in (0, 3):
        tracker = TK.PeopleTracker(5.0)
        for f in range(900):
            own = [r for r in rows if r[0] == match and r[1] == f]
            if own:
                ids = tracker.frame(f, np.array([r[3:5] for r in own]), np.array([r[5] for r in own]),
                                    [np.array(r[6][1:6]) if r[6] else None for r in own], [r[7] for r in own])
                want.update({(match, f, r[2]): k for r, k in zip(own, ids)})
    assert got == want and len(set(want.values())) > 20


def test_no_rows(spark):
    assert B.track_ball(spark.createDataFrame([], BALL), 5.0, 0.5).count() == 0
    assert TK.track_people(spark.createDataFrame([], PEOPLE), 5.0).count() == 0
