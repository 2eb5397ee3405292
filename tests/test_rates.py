"""Matches of different sampling rates in one run come out as each would alone."""

import random

from pyspark.sql import functions as F

from touchline.operators import metrics as M
from touchline.operators import tracking as TK
from touchline.session import ship_package
from touchline.streaming import ball as B

PEOPLE = "match_id long, frame long, t double, det_id long, x double, y double, sigma_m double, kit array<double>, hint long"


def people(match, rate, seconds=40):
    rng = random.Random(match)
    rows = []
    for f in range(int(seconds * rate)):
        t = f / rate
        for d in range(6):
            if rng.random() < 0.95 and (int(t) + 2 * d) % 13 >= 4:
                rows.append((match, f, t, d, 12.0 * d + 0.9 * t + rng.uniform(-0.05, 0.05), 20.0 + rng.uniform(-0.05, 0.05), 0.3, None, None))
    return rows


def test_trackers_and_stitching_take_each_match_at_its_rate(spark):
    ship_package(spark)
    rates = {1: 5.0, 2: 15.0}
    both = spark.createDataFrame([r for m, rate in rates.items() for r in people(m, rate)], PEOPLE).cache()
    measured = M.sampling_rate(both)
    assert {r.match_id: round(r.rate, 6) for r in measured.collect()} == rates
    given = spark.createDataFrame(list(rates.items()), "match_id long, rate double")
    tracked = TK.track_people(both, given).cache()
    obs = both.join(tracked, ["match_id", "frame", "det_id"])
    frags = TK.fragments(obs).withColumn("kit", F.lit(None).cast("array<double>")).cache()
    edges, report = TK.stitch_candidates(frags, given), TK.stitch_report(frags, given)
    for match, rate in rates.items():
        alone = both.where(F.col("match_id") == match)
        want = sorted(map(tuple, TK.track_people(alone, rate).collect()))
        assert sorted(map(tuple, tracked.where(F.col("match_id") == match).collect())) == want and len({r[3] for r in want}) > 6
        own = frags.where(F.col("match_id") == match)
        pairs = sorted(map(tuple, TK.stitch_candidates(own, rate).collect()))
        assert pairs and sorted(map(tuple, edges.where(F.col("match_id") == match).collect())) == pairs
        assert sorted(map(str, report.where(F.col("match_id") == match).collect())) == sorted(map(str, TK.stitch_report(own, rate).collect()))
    both.unpersist(), tracked.unpersist(), frags.unpersist()


def test_the_ball_at_two_rates(spark):
    rng = random.Random(2)
    rows = [(m, f, [(0.8, (0.2 + f / rate * 0.02) % 1, 0.3, 0.01, 0.01)] if rng.random() < 0.6 and not 8 < f / rate < 11 else [], None, f % 3 == 0)
            for m, rate in ((1, 5.0), (2, 15.0)) for f in range(int(20 * rate))]
    df = spark.createDataFrame(rows, "match_id long, frame long, dets array<struct<conf:double,u:double,v:double,w:double,h:double>>, step array<double>, full_frame boolean")
    given = spark.createDataFrame([(1, 5.0), (2, 15.0)], "match_id long, rate double")
    got = B.track_ball(df, given, 0.5625).collect()
    for match, rate in ((1, 5.0), (2, 15.0)):
        alone = B.track_ball(df.where(F.col("match_id") == match), rate, 0.5625)
        assert sorted(map(str, (r for r in got if r.match_id == match))) == sorted(map(str, alone.collect()))
