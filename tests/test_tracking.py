import itertools
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import tracking as TK


def best_matching(edges):
    best = (0, 0.0)
    for k in range(len(edges) + 1):
        for pick in itertools.combinations(edges, k):
            if len({e[0] for e in pick}) == len({e[1] for e in pick}) == k:
                best = min(best, (-k, round(sum(e[2] for e in pick), 6)))
    return best


def random_edges(seed, n=4):
    rng = random.Random(seed)
    return [(b, a, float(rng.randint(1, 9))) for b in range(n) for a in range(n) if rng.random() < 0.5]


def test_match_fragments_is_exact(spark):
    rows, want = [], {}
    for match in range(6):
        edges = random_edges(match)
        want[match] = best_matching(edges)
        rows += [(match, *e) for e in edges]
    df = spark.createDataFrame(rows, "match_id long, before long, after long, cost double")
    got = TK.match_fragments(df).join(df, ["match_id", "before", "after"]).groupBy("match_id").agg(
        F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("c")).collect()
    assert {r.match_id: (-r.n, r.c) for r in got} == want


def test_match_fragments_above_the_old_limit(spark):
    """A long chain of fragments with two choices each: one component, production constants, fixed choice of ties."""
    n = 60_000
    rows = spark.range(n).selectExpr("1L match_id", "id before", "explode(sequence(id + 1, least(id + 6, %d))) after" % n).selectExpr(
        "match_id", "before", "after", "(after - before) * 0.5e0 as cost")
    got = TK.match_fragments(rows)
    assert {(r.before, r.after) for r in got.collect()} == {(i, i + 1) for i in range(n)}


def test_components_and_chains(spark):
    edges = [(0, i, i + 1) for i in range(0, 40)] + [(0, 100, 101), (1, 5, 6)]
    df = spark.createDataFrame(edges, "match_id long, before long, after long")
    links = spark.createDataFrame([(0, i, i // 2) for i in range(1, 9)] + [(0, 50, 51)], "match_id long, before long, after long")
    comp = TK.components(links).groupBy("match_id", "component").count().collect()
    # edge (b, a) links left node b with right node a: 1-0, 2-1, 3-1, 4-2, 5-2 ... share right nodes only
    assert sorted(r["count"] for r in comp) == [1, 1, 1, 2, 2, 2]
    heads = {(r.match_id, r.track_id): r.head for r in TK.resolve_chains(df).collect()}
    assert heads[(0, 40)] == 0 and heads[(0, 101)] == 100 and heads[(1, 6)] == 5


def brute_tracks(frames, rate):
    tracker = TK.PeopleTracker(rate)
    import numpy as np
    out = {}
    for frame, rows in frames:
        ids = tracker.frame(frame, np.array([(r[1], r[2]) for r in rows]), np.full(len(rows), 0.3),
                            [None] * len(rows), [None] * len(rows))
        out.update({(frame, r[0]): k for r, k in zip(rows, ids)})
    return out


def test_pieces_number_tracks_like_one_pass(spark):
    rng = random.Random(3)
    frames = []
    for frame in list(range(0, 40)) + list(range(70, 100)) + list(range(200, 230)):
        rows = [(d, 10.0 * d + 0.1 * (frame % 30) + rng.random() * 0.1, 20.0 + rng.random() * 0.1)
                for d in range(4) if rng.random() < 0.9]
        if rows:
            frames.append((frame, rows))
    data = [(1, f, d, x, y, 0.3, None, None) for f, rows in frames for d, x, y in rows]
    df = spark.createDataFrame(data, "match_id long, frame long, det_id long, x double, y double, sigma_m double, "
                                     "kit array<double>, hint long")
    got = {(r.frame, r.det_id): r.track_id for r in TK.track_people(df, 5.0).collect()}
    assert got == brute_tracks(frames, 5.0)
    assert len(set(got.values())) >= 12


@pytest.mark.parametrize("kit", [0.0, 0.9])
def test_stitch_gate(spark, kit):
    kit_b = [kit] * 5
    frags = spark.createDataFrame([(0, 1, 0, 0.0, 0.0, 8, 3.0, 0.0, [0.0] * 5), (0, 2, 24, 8.0, 0.0, 32, 12.0, 0.0, kit_b)],
                                  "match_id long, track_id long, f0 long, x0 double, y0 double, f1 long, x1 double, y1 double, "
                                  "kit array<double>")
    got = TK.stitch_candidates(frags, 5.0).collect()
    assert len(got) == (1 if kit == 0.0 else 0)
