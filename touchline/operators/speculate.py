"""Sequential walks in parallel: blocks start early from a fresh state, and those that guessed wrong walk again.

Trackers forget: what happened long ago hardly changes what they do. So each block of positions is walked from a fresh
state that sees the rows of some time before it first. Where the state at a block's first row equals the state at the end
of the block before, the block's results are those of one uninterrupted walk. Other blocks are walked again from that
state, until all meet. Equal means equal to the last bit, so results do not depend on blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import cut, stored
from .blocks import Fold, dealt, fold_sorted, halo


class Walk(Fold):
    """A fold whose state can be told and taken up again.

    ``snapshot(at)`` is the state in one canonical form as position ``at`` begins (None: as it is); ``remark`` what else the
    block's end has to say. ``pause`` gives what is left of the rows so far and keeps the state.
    """

    def snapshot(self, at: int | None) -> str:
        raise NotImplementedError

    def pause(self):
        return self.close()

    def remark(self) -> str:
        return ""


class _Chain(Fold):
    """Blocks whose state does not follow from the block before, with the state that they should have begun with."""

    def __init__(self, key, make, width):
        self.key, self.make, self.width, self.held = key, make, width, None

    def step(self, row):
        should = self.make(self.key, self.held).snapshot(row.at)
        out = [] if should == row.entry else [(*self.key, row.blk, should)]
        self.held = row.exit
        return out


def fold_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[tuple, str | None], Walk], schema: StructType, *,
                block: int, lead: int | Column) -> tuple[DataFrame, DataFrame]:
    """Walk each key's rows in ``order`` (its first column a whole position): results with their ``blk``, and for each block
    ``keys, blk, at, entry, exit, remark``.

    ``make(key, snapshot)`` gives a walk from a state, or a fresh one. ``schema`` begins with ``keys``. Blocks have ``block`` positions
    and see ``lead`` positions before (a number, or a column of the key's). Each round of walking again settles at least the first block that was wrong of each key.
    """
    keys, order = list(keys), list(order)
    told = StructType([*schema.fields, StructField("blk", LongType()), StructField("at", LongType()), *(
        StructField(c, StringType()) for c in ("entry", "exit", "remark"))])
    blank = (None,) * (len(schema) - len(keys))

    def walk(batches):
        current = fold = start = at = entry = None

        def finish():
            out = [(*row, current[-1], None, None, None, None) for row in fold.close()]
            return [*out, (*current[:-1], *blank, current[-1], at, entry, fold.snapshot(None), fold.remark())]

        for pdf in batches:
            out = []
            for key, row in zip(zip(*[pdf[k].tolist() for k in (*keys, "blk")]), pdf.itertuples(index=False)):
                if key != current:
                    if at is not None:
                        out += finish()
                    current, start, at, fold = key, None, None, None
                if isinstance(row.start, str):
                    start = row.start
                    continue
                if fold is None:
                    fold = make(key[:-1], start)
                if at is None:
                    if not row.own:
                        fold.step(row)
                        continue
                    fold.pause()
                    at = int(getattr(row, order[0]))
                    entry = fold.snapshot(at)
                    fold = make(key[:-1], entry)
                out += [(*r, key[-1], None, None, None, None) for r in fold.step(row)]
            if out:
                yield pd.DataFrame(out, columns=told.names, dtype=object)
        if at is not None:
            yield pd.DataFrame(finish(), columns=told.names, dtype=object)

    def walked(rows: DataFrame) -> DataFrame:
        arranged = dealt(rows, *keys, "blk", slow=True).sortWithinPartitions(*keys, "blk", F.col("start").isNull(), *order)
        return stored(arranged.mapInPandas(walk, told))

    rows = halo(df, order[0], block, back=lead, ahead=0).withColumnsRenamed({"_blk": "blk", "_own": "own"}).withColumn(
        "start", F.lit(None).cast("string"))
    rounds = [walked(rows)]
    ends = rounds[0].where("entry is not null").select(*keys, "blk", "at", "entry", "exit", "remark", F.lit(0).alias("turn"))
    chain = StructType([*schema.fields[:len(keys)], StructField("blk", LongType()), StructField("start", StringType())])
    while True:
        wrong = stored(fold_sorted(ends, keys, ["blk"], lambda key: _Chain(key, make, block), chain))
        if wrong.isEmpty():
            break
        again = rows.where("own").join(wrong.select(*keys, "blk"), [*keys, "blk"], "left_semi")
        rounds.append(walked(again.unionByName(wrong, allowMissingColumns=True)))
        fresh = rounds[-1].where("entry is not null").select(*keys, "blk", "at", "entry", "exit", "remark", F.lit(len(rounds) - 1).alias("turn"))
        ends = cut(ends.join(fresh.select(*keys, "blk"), [*keys, "blk"], "left_anti").unionByName(fresh))
    out = [r.where("entry is null").select(*schema.names, "blk").withColumn("turn", F.lit(i)) for i, r in enumerate(rounds)]
    if len(out) == 1:
        return out[0].drop("turn"), ends.drop("turn")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.join(ends.select(*keys, "blk", "turn"), [*keys, "blk", "turn"]).drop("turn"), ends.drop("turn")
