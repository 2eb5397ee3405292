"""Connected components of an edge table by rounds of contraction; no component is ever gathered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored


FINISH = 200_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join up a bounded number of edges in one task: ``at, to`` for each end, ``to`` the least end reached."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            above.setdefault(a, a), above.setdefault(b, b)
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    ends = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([top(x) for x in ends], pa.int64())], names=["at", "to"])


def components(edges: DataFrame, finish: int = FINISH, most_rounds: int = 100) -> DataFrame:
    """``id, component`` (the least id reachable) for every id in ``edges`` (``a, b``, both bigint, never null) but
    those with loops only.

    Each round sends every id to the least of itself and its neighbors and joins the edges' ends to where they went;
    edges within one id go, and the rest gets fewer by a factor each round, also for chains, whose ids are compared
    after a scramble that changes each round. As soon as at most ``finish`` edges are left, one task joins them up; the
    result is the same with any ``finish``. What a round leaves is stored, so that the planner's estimates don't multiply. A run that has not ended after ``most_rounds`` raises. Repeated edges are
    allowed; no edges give no rows.
    """
    ends = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    for turn in range(most_rounds):
        small = ends.count() <= finish
        if small and labels is None:  # the one task has named each component by its least end
            out = stored(ends.coalesce(1).mapInArrow(_union, "at bigint, to bigint").toDF("id", "component"))
            discard(ends)
            return out
        if labels is None:
            labels = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().withColumn("at", F.col("id"))
        if small:
            went = ends.coalesce(1).mapInArrow(_union, "at bigint, to bigint")
        else:
            both = ends.union(ends.select("b", "a"))
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("r"), F.col(c).alias("id"))
            went = stored(both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["id"].alias("to")).withColumnRenamed("a", "at"))
        before, labels = labels, stored(labels.join(went, "at", "left").select("id", F.coalesce("to", "at").alias("at")))
        discard(before)
        if small:
            # all ids that ended at one place are one component: name it by its least id
            names = labels.groupBy("at").agg(F.min("id").alias("component"))
            discard(ends)
            return labels.join(names, "at").select("id", "component")
        moved = ends.join(went.select(F.col("at").alias("a"), F.col("to").alias("ta")), "a").join(
            went.select(F.col("at").alias("b"), F.col("to").alias("tb")), "b")
        old, ends = ends, stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct())
        discard(old, went)
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
