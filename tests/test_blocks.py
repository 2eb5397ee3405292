"""The block-wise primitives give what one big window gives, whatever the block size."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import blocks as K
from touchline.operators import joins as J
from touchline.operators.topk import top_k


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    data = [(k, p, rng.choice([None, rng.random()]), rng.random() < 0.6) for k in range(3) for p in range(120) if rng.random() < 0.9]
    return spark.createDataFrame(data, "k long, p long, v double, on boolean").cache()


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_prefix(rows, size):
    w = Window.partitionBy("k").orderBy("p")
    back = Window.partitionBy("k").orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("k", "p", F.sum(F.lit(1)).over(w).alias("n"), F.last("v", True).over(w).alias("held"), F.lag("v").over(w).alias("before"),
                       F.last("v", True).over(back).alias("next"), F.count("*").over(back).alias("rest")).collect()
    got = K.prefix(rows, ["k"], ["p"], size, sums={"n": F.lit(1)}, fills={"held": F.col("v")}, lags={"before": F.col("v")},
                   back_sums={"rest": F.lit(1)}, back_fills={"next": F.col("v")}).select("k", "p", "n", "held", "before", "next", "rest").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


@pytest.mark.parametrize("size", [5, 4096])
def test_runs_and_pieces(rows, size):
    by_key = {}
    for r in sorted(rows.collect()):
        by_key.setdefault(r.k, []).append(r)
    want_runs, want_pieces = set(), set()
    for k, rs in by_key.items():
        run, piece = [], []
        for r in rs:
            if r.on:
                run.append(r.p)
            elif run:
                want_runs.add((k, run[0], len(run)))
                run = []
            if piece and r.p - piece[-1] >= 2:
                want_pieces.add((k, piece[0], len(piece)))
                piece = []
            piece.append(r.p)
        if run:
            want_runs.add((k, run[0], len(run)))
        want_pieces.add((k, piece[0], len(piece)))
    got = K.runs(rows, ["k"], "p", F.col("on"), size).groupBy("k", "run").agg(F.min("p").alias("a"), F.count("*").alias("n"))
    assert {(r.k, r.a, r.n) for r in got.collect()} == want_runs
    got = K.gap_pieces(rows, ["k"], ["p"], 2, size).groupBy("k", "piece").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in got.collect()} == want_pieces


def test_exact_percentiles(spark):
    rng = np.random.default_rng(0)
    values = {0: np.exp(rng.normal(0, 4, 301)), 1: rng.integers(0, 4, 50).astype(float), 2: np.array([7.0]), 3: -rng.random(20)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [(1, None)], "k long, v double")
    got = {r.k: r for r in K.exact_percentiles(df, ["k"], F.col("v"), {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).collect()}
    for k, vs in values.items():
        want = np.quantile(vs, [0.5, 0.95, 0.0, 1.0])
        assert np.allclose([got[k].a, got[k].b, got[k].c, got[k].d], want)


@pytest.mark.parametrize("block", [0.7, 50.0])
def test_asof_nearest_matches_a_sorted_search(spark, block):
    rng = random.Random(2)
    right = {k: sorted({round(rng.uniform(0, 20), 1) for _ in range(25)}) for k in range(2)}
    left = {k: sorted({round(rng.uniform(-2, 22), 1) for _ in range(40)}) for k in range(2)}
    a = spark.createDataFrame([(k, t) for k, ts in left.items() for t in ts], "k long, t double")
    b = spark.createDataFrame([(k, t, i) for k, ts in right.items() for i, t in enumerate(ts)], "k long, t double, i long")
    got = {(r.k, r.t): r.near.i for r in J.asof_nearest(a, b, ["k"], "t", payload=["i"], block=block).collect()}
    for k, ts in left.items():
        times = np.array(right[k])
        at = np.array(ts)
        idx = np.searchsorted(times, at).clip(1, len(times) - 1)
        idx = np.where(np.abs(times[idx - 1] - at) < np.abs(times[idx] - at), idx - 1, idx)
        assert [got[(k, t)] for t in ts] == idx.tolist()


def test_within_is_strict(spark):
    a = spark.createDataFrame([(0, 1.0), (0, 5.0), (0, 9.5)], "k long, t double")
    b = spark.createDataFrame([(0, 2.0), (0, 5.5), (1, 9.5)], "k long, t double")
    got = {r.t: r.near for r in J.within(a, b, ["k"], "t", 1.0, "near", block=0.9).collect()}
    assert got == {1.0: False, 5.0: True, 9.5: False}


def test_top_k(rows):
    got = top_k(rows.where("v is not null"), ["k"], [F.col("v").desc(), F.col("p")], 4).collect()
    for k in range(3):
        want = sorted(((r.v, -r.p) for r in rows.collect() if r.k == k and r.v is not None), reverse=True)[:4]
        assert [(r.v, -r.p) for r in sorted(got, key=lambda r: r["rank"]) if r.k == k] == want
