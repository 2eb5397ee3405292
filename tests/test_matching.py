"""Matching by reduction, components and blocks, against the plain solver over all edges at once."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import matching as M
from touchline.operators.assignment import match_sparse
from touchline.session import ship_package

EDGES = "match_id long, before long, after long, cost double"


def banded(seed, fragments, reach, share, copies=1):
    """Fragments in order of appearance; each may be continued by some of the next ``reach``."""
    rng = random.Random(seed)
    return [(match, i, i + k, round(rng.random() * 4, 3)) for match in range(copies) for i in range(fragments) for k in range(1, reach + 1) if rng.random() < share]


def plain(rows):
    out = {}
    for match in {r[0] for r in rows}:
        edges, cost = {}, {}
        for _, before, after, c in sorted(r for r in rows if r[0] == match):
            edges.setdefault(before, []).append((after, round((c + 1.0) * M.COST_UNITS)))
            cost[before, after] = round((c + 1.0) * M.COST_UNITS)
        pairs = match_sparse(edges, round(M.UNJOINED * M.COST_UNITS))
        out[match] = (len(pairs), sum(cost[p] for p in pairs.items()))
    return out


def totals(found, df):
    joined = found.join(df, ["match_id", "before", "after"])
    rows = joined.groupBy("match_id").agg(F.count("*").alias("n"), F.sum(F.bround((F.col("cost") + 1) * M.COST_UNITS).cast("long")).alias("c"),
                                          F.count_distinct("before").alias("b"), F.count_distinct("after").alias("a")).collect()
    assert all(r.n == r.a == r.b for r in rows)
    return {r.match_id: (r.n, r.c) for r in rows}


@pytest.mark.parametrize("task_edges", [150, 50_000])
def test_same_count_and_cost(spark, task_edges):
    ship_package(spark)
    rows = banded(task_edges, 300, 9, 0.35, copies=2)
    df = spark.createDataFrame(rows, EDGES)
    assert totals(M.match_fragments(df, task_edges), df) == plain(rows)


def test_search_that_goes_through_the_whole_match(spark):
    """Each fragment could go to its own successor or to the next one; a last one too many must shift all others or go without."""
    n = 50
    rows = [(0, i, 1000 + i, 1.0) for i in range(n)] + [(0, i, 1001 + i, 2.0) for i in range(n)] + [(0, n, 1000, 1.0)]
    df = spark.createDataFrame(rows, EDGES)
    assert totals(M.match_fragments(df, 20), df) == plain(rows) == {0: (n + 1, (2 + 3 * n) * M.COST_UNITS)}
    with pytest.raises(RuntimeError):
        M.match_fragments(df, 20, most_edges=40)


def test_reduction_keeps_what_is_best(spark):
    rows = [(m, *e) for m in range(40) for e in [(b, a, float(random.Random(m * 100 + b * 10 + a).randint(1, 5))) for b in range(5) for a in range(5, 10)
                                                 if random.Random(m * 1000 + b * 10 + a).random() < 0.4]]
    df = spark.createDataFrame(rows, EDGES)
    price = F.bround((F.col("cost") + 1) * M.COST_UNITS).cast("long").alias("price")
    left = M.reduce_edges(df.select("match_id", "before", "after", price), 3)
    kept = [(r.match_id, r.before, r.after, r.price / M.COST_UNITS - 1) for r in left.collect()]
    assert len(kept) < len(rows) and plain(kept) == plain(rows)


def test_a_match_of_many_edges_in_small_tasks(spark):
    """A quarter of a million edges in one component; no task gets more than 25,000."""
    rows = banded(1, 80_000, 9, 0.35)
    assert len(rows) > 250_000
    df = spark.createDataFrame(rows, EDGES).cache()
    try:
        assert totals(M.match_fragments(df, 20_000, most_edges=25_000), df) == plain(rows)
    finally:
        df.unpersist()


def test_no_edges(spark):
    assert M.match_fragments(spark.createDataFrame([], EDGES)).count() == 0
