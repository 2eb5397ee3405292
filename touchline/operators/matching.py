"""Which fragments continue which: an exact sparse matching whose tasks have a stated size.

Most joins first, then least total cost. Edges that no best choice needs go first, in joins and aggregates; what is left is
solved by connected component, and a component too large for one task by blocks of it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..session import cut, discard, stored
from .assignment import match_sparse, place_lefts
from .blocks import Fold, fold_sorted, prefix

UNJOINED, COST_UNITS = 1e6, 1_000_000
#: edges that one task may solve at once
TASK_EDGES = 50_000


def components(edges: DataFrame, keys: str = "match_id", limit: int = 60) -> DataFrame:
    """Label each edge ``(match_id, before, after, ...)`` with ``component``: the smallest node it is linked to.

    Alternating star contractions; neighborhoods are only ever reduced to their minimum. Raises if they do not settle.
    """
    u = edges.select(keys, (F.col("before") * 2).alias("u"), (F.col("after") * 2 + 1).alias("v"))
    links = stored(u.distinct())
    for _ in range(limit):
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = links.select(keys, F.explode(ends).alias("e")).select(keys, "e.u", "e.v")
        low = both.groupBy(keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, [keys, "u"]).where(F.col("v") > F.col("u")).select(keys, F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy(keys, "u").agg(F.min("v").alias("m"))
        small = down.join(low, [keys, "u"]).select(keys, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.where(F.col("u") != F.col("v")).distinct())
        changed = after.join(links, [keys, "u", "v"], "left_anti").limit(1).count() or \
            links.join(after, [keys, "u", "v"], "left_anti").limit(1).count()
        discard(links)
        links = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components not settled after {limit} rounds")
    root = links.select(keys, F.col("u").alias("_n"), F.col("v").alias("_root"))
    out = edges.withColumn("_n", F.col("before") * 2).join(root, [keys, "_n"], "left")
    return out.withColumn("component", F.coalesce("_root", "_n")).drop("_n", "_root")


def reduce_edges(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """``edges`` (``match_id, before, after, price``, whole numbers) without those that no best choice needs.

    A fragment that only one other could join is that one's to have at any time. So of several such the cheapest counts,
    and an edge dearer than it can be exchanged for it: as many joins, for less. This holds for successors and
    predecessors alike, and each removal may make others. Equal prices go by the lesser fragment.
    """
    for _ in range(rounds):
        for own, other in (("before", "after"), ("after", "before")):
            lonely = edges.groupBy("match_id", other).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("price", own)).alias("_one"))
            best = lonely.where("_n = 1").select("match_id", F.col(f"_one.{own}").alias(own), F.struct(F.col("_one.price").alias("price"), F.col(other)).alias("_e"))
            best = best.groupBy("match_id", own).agg(F.min("_e").alias("_best"))
            edges = edges.join(best, ["match_id", own], "left").where(
                F.col("_best").isNull() | (F.struct("price", other) <= F.struct(F.col("_best.price").alias("price"), F.col(f"_best.{other}").alias(other)))).drop("_best")
    return edges


class _Solve(Fold):
    """One component's edges, solved when all are there. Most components are a few edges, so a frame for each would cost more."""

    def __init__(self, key):
        self.match, self.edges = key[0], {}

    def step(self, row):
        self.edges.setdefault(row.before, []).append((row.after, row.price))
        return ()

    def close(self):
        return [(self.match, before, after) for before, after in match_sparse(self.edges, round(UNJOINED * COST_UNITS)).items()]


_ROUND = StructType([StructField("match_id", LongType()), StructField("right", BooleanType()), StructField("node", LongType()),
                     StructField("price", LongType()), StructField("mate", LongType()), StructField("placed", BooleanType())])


def _place_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block's turn: place its fragments where the search for the cheapest way stays inside."""
    edges: dict[int, list[tuple[int, int]]] = {}
    left_price, right_price, right_of, left_of, own, todo = {}, {}, {}, {}, set(), []
    columns = ("before", "after", "cost", "price_l", "mate_l", "placed", "price_r", "mate_r", "inside")
    for before, after, cost, price_l, mate_l, placed, price_r, mate_r, inside in sorted(zip(*(pdf[c] for c in columns)), key=lambda r: r[:2]):
        if before not in edges:
            edges[before], left_price[before] = [], int(price_l)
            if mate_l >= 0:
                right_of[before] = int(mate_l)
            if not placed:
                todo.append(before)
        edges[before].append((after, int(cost)))
        right_price[after] = int(price_r)
        if mate_r >= 0:
            left_of[after] = int(mate_r)
        if inside:
            own.add(after)
    left_was, right_was = {k: (p, right_of.get(k)) for k, p in left_price.items()}, {k: (right_price[k], left_of.get(k)) for k in own}
    done = place_lefts(edges, todo, round(UNJOINED * COST_UNITS), left_price, right_price, right_of, left_of, own)
    waiting = set(todo) - done
    match = int(pdf["match_id"].iloc[0])
    rows = [(match, False, k, p, right_of.get(k, -1), k not in waiting) for k, p in left_price.items()
            if k in done or (p, right_of.get(k)) != left_was[k]]
    rows += [(match, True, k, right_price[k], left_of.get(k, -1), True) for k in own if (right_price[k], left_of.get(k)) != right_was[k]]
    return pd.DataFrame(rows, columns=_ROUND.names)


def match_by_blocks(edges: DataFrame, task_edges: int = TASK_EDGES, most_edges: int | None = None) -> DataFrame:
    """An exact matching of ``edges`` (``match_id, before, after, price``) in tasks of about ``task_edges`` edges.

    Fragments' numbers are not negative. They are dealt into blocks along the order of their successors' numbers, which follow first appearance, so an
    edge is nearly always within a block or next to it. Prices of fragments (the duals of the assignment) are the state
    between rounds. In its turn a block searches the cheapest way to place each of its fragments that has none yet. Where the search ends before
    it meets a fragment that belongs to another block, the step is one that the whole problem would take too, and prices
    stay valid everywhere, whatever other blocks do at the time: a successor's price only falls, and only its own block
    changes it. The other fragments wait for the next round, which cuts blocks half a block further; where two rounds place
    none, blocks get twice as large. ``most_edges`` raises before a task would get larger than that.
    """
    keys = ["match_id"]
    rights = prefix(edges.groupBy("match_id", "after").agg(F.count(F.lit(1)).alias("_n")), keys, ["after"], sums={"_to": F.col("_n")})
    rights = stored(rights.select("match_id", F.col("after").alias("node"), (F.col("_to") - F.col("_n")).alias("pos"), F.lit(0).cast("long").alias("price"),
                               F.lit(-1).cast("long").alias("mate")))
    placed = edges.join(rights.select("match_id", F.col("node").alias("after"), "pos"), ["match_id", "after"])
    edges = stored(placed.select("match_id", "before", "after", "price", F.col("pos").alias("pos_r")))
    lefts = stored(edges.groupBy("match_id", "before").agg(F.min("pos_r").alias("pos")).select(
        "match_id", F.col("before").alias("node"), "pos", F.lit(0).cast("long").alias("price"), F.lit(-1).cast("long").alias("mate"), F.lit(False).alias("placed")))
    size, idle, turn, waiting = task_edges, 0, 0, lefts.count()
    while waiting:
        block = lambda c: F.floor((F.col(c) + (size // 2 if turn % 2 else 0)) / size)  # noqa: B023,E731
        due = lefts.where("not placed").select("match_id", block("pos").alias("block")).distinct()
        left = lefts.withColumn("block", block("pos")).join(due, ["match_id", "block"], "left_semi").select(
            "match_id", "block", F.col("node").alias("before"), F.col("price").alias("price_l"), F.col("mate").alias("mate_l"), "placed")
        right = rights.select("match_id", F.col("node").alias("after"), F.col("price").alias("price_r"), F.col("mate").alias("mate_r"))
        rows = edges.withColumnRenamed("price", "cost").join(left, ["match_id", "before"]).join(right, ["match_id", "after"]).withColumn(
            "inside", block("pos_r") == F.col("block"))
        if most_edges is not None:
            largest = rows.groupBy("match_id", "block").count().agg(F.max("count")).first()[0] or 0
            if largest > most_edges:
                raise RuntimeError(f"a task would get {largest} edges, more than {most_edges}")
        told = stored(rows.groupBy("match_id", "block").applyInPandas(_place_block, _ROUND))

        def renewed(nodes: DataFrame, right_side: bool) -> DataFrame:
            new = told.where(F.col("right") == right_side).select("match_id", "node", F.struct("price", "mate", "placed").alias("_new"))  # noqa: B023
            joined = nodes.join(new, ["match_id", "node"], "left")
            fresh = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in nodes.columns if c in ("price", "mate", "placed")]
            return stored(joined.select("match_id", "node", "pos", *fresh))

        old = (lefts, rights, told)
        lefts, rights = renewed(lefts, False), renewed(rights, True)
        discard(*old)
        left_over = lefts.where("not placed").count()
        idle = 0 if left_over < waiting else idle + 1
        waiting, turn = left_over, turn + 1
        if idle == 2:
            size, idle = 2 * size, 0
    discard(rights, edges)
    return lefts.where("mate >= 0").select("match_id", F.col("node").alias("before"), F.col("mate").alias("after"))


def match_fragments(edges: DataFrame, task_edges: int = TASK_EDGES, most_edges: int | None = None) -> DataFrame:
    """At most one successor and predecessor per fragment: most joins first, then least total cost.

    Costs count in whole millionths. Edges that a best choice does not need go (``reduce_edges``); pairs that are each
    other's only edge are joined as they are; components are independent, each is solved exactly in one task, fragments in
    ascending order; one of more than ``task_edges`` edges is solved exactly by blocks (``match_by_blocks``). Which of
    several choices of equal count and cost comes out may depend on ``task_edges``, but not on partitions.
    """
    price = F.bround((F.col("cost") + 1.0) * COST_UNITS).cast("long").alias("price")
    labeled = cut(components(cut(reduce_edges(edges.select("match_id", "before", "after", price)))))
    sizes = labeled.groupBy("match_id", "component").agg(F.count(F.lit(1)).alias("_n"))
    sized = labeled.join(sizes, ["match_id", "component"])
    schema = StructType([StructField(c, LongType()) for c in ("match_id", "before", "after")])
    single = sized.where("_n = 1").select("match_id", "before", "after")
    small = sized.where((F.col("_n") > 1) & (F.col("_n") <= task_edges)).select("match_id", "component", "before", "after", "price")
    out = single.unionByName(fold_sorted(small, ["match_id", "component"], ["before", "after", "price"], _Solve, schema, slow=True))
    large = sized.where(F.col("_n") > task_edges).select("match_id", "before", "after", "price")
    if sizes.where(F.col("_n") > task_edges).isEmpty():
        return out
    return out.unionByName(match_by_blocks(cut(large), task_edges, most_edges))
