"""Ordered work that does not put a whole match into one task.

A window over ``(match, frame)`` sorts one match in one task. That is fine until one match holds a third of the
table, so the ordered operators are built from four pieces that only ever group by ``(key, block of positions)``:

* :func:`prefix`  - running sums, last-known values and previous rows, as an in-block window plus a scan over one
  summary row per block;
* :func:`halo`    - bounded look-back / look-ahead windows, by copying the few rows near a block edge to its neighbor;
* :func:`runs`    - gaps and islands, labeled with the position of the run's first row;
* :func:`exact_percentiles` - numpy-style linear percentiles by counting, not by gathering a group's values.

What is sequential by nature goes through :func:`fold_sorted`: Spark partitions and sorts, and Python sees one Arrow
batch at a time with a small carried state, so no group is ever held in memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = 4096


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def block_of(pos, size: float) -> Column:
    return F.floor(_col(pos) / F.lit(float(size))).cast("long")


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: float = BLOCK,
    *,
    sums: dict[str, Column] | None = None,
    fills: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    back_sums: dict[str, Column] | None = None,
    back_fills: dict[str, Column] | None = None,
    back_order: Sequence[str] | None = None,
) -> DataFrame:
    """Add running values along ``order`` within ``keys``.

    ``sums``: running total up to and including the row. ``fills``: last non-null value up to and including the row.
    ``lags``: the previous row's value. ``back_sums`` and ``back_fills`` run from the end (over ``back_order``, which
    may break ties differently), so a fill is the next known value. ``order[0]`` is numeric and decides the block of
    ``size`` positions. Rows are dealt out by key and block once; the block summaries are made where the rows lie.
    """
    forward = [("sum", o, c) for o, c in (sums or {}).items()] + [("fill", o, c) for o, c in (fills or {}).items()] \
        + [("lag", o, c) for o, c in (lags or {}).items()]
    backward = [("sum", o, c) for o, c in (back_sums or {}).items()] \
        + [("fill", o, c) for o, c in (back_fills or {}).items()]
    keys, order = list(keys), list(order)
    rows = df.withColumn("_blk", block_of(order[0], size)).repartition(*keys, "_blk")
    summary_aggs, carries, locals_ = [], [], []
    for work, cols, down in ((forward, order, False), (backward, list(back_order or order), True)):
        inside = Window.partitionBy(*keys, "_blk").orderBy(*[F.col(c).desc() if down else F.col(c) for c in cols])
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        outside = Window.partitionBy(*keys).orderBy(F.col("_blk").desc() if down else F.col("_blk"))
        earlier = outside.rowsBetween(Window.unboundedPreceding, -1)
        at = F.struct(*cols)
        pick = F.min_by if down else F.max_by
        for kind, name, c in work:
            carry, local = f"_c_{name}", f"_l_{name}"
            if kind == "sum":
                summary_aggs.append(F.sum(c).alias(carry))
                carries.append(F.sum(carry).over(earlier).alias(carry))
                locals_.append(F.sum(c).over(upto).alias(local))
                continue
            value = F.struct(c.alias("v")) if kind == "lag" else c
            summary_aggs.append(pick(value, F.when(value.isNotNull(), at)).alias(carry))
            carries.append(F.last(carry, ignorenulls=True).over(earlier).alias(carry))
            locals_.append((F.lag(value).over(inside) if kind == "lag"
                            else F.last(value, ignorenulls=True).over(upto)).alias(local))
    carried = rows.groupBy(*keys, "_blk").agg(*summary_aggs).select(*keys, "_blk", *carries)
    joined = rows.select("*", *locals_).join(carried, [*keys, "_blk"], "left")
    made = []
    for kind, name, _ in forward + backward:
        carry, local = F.col(f"_c_{name}"), F.col(f"_l_{name}")
        if kind == "sum":
            made.append((F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))).alias(name))
        elif kind == "lag":
            made.append(F.coalesce(local, carry)["v"].alias(name))
        else:
            made.append(F.coalesce(local, carry).alias(name))
    return joined.select(*df.columns, *made)


def halo(df: DataFrame, pos: str, size: float, back: float, ahead: float) -> DataFrame:
    """Copy each row into every block whose rows may look at it.

    Rows look back at most ``back`` and ahead at most ``ahead`` positions. Adds ``_blk`` and ``_own``; window over
    ``(keys, _blk)`` and keep ``_own`` rows afterwards. With ``size`` well above the reach almost no row is copied.
    """
    p = F.col(pos)
    blocks = F.sequence(block_of(p - F.lit(ahead), size), block_of(p + F.lit(back), size))
    return df.withColumn("_blk", F.explode(blocks)).withColumn("_own", F.col("_blk") == block_of(pos, size))


def runs(df: DataFrame, keys: Sequence[str], pos: str, flag: Column, size: float = BLOCK) -> DataFrame:
    """Rows where ``flag`` holds, labeled ``run``: the position of the last row before their run that broke it."""
    rows = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    rows = prefix(rows, keys, [pos], size, fills={"_broke": F.when(~F.col("_flag"), F.col(pos))})
    return rows.where("_flag").withColumn("run", F.coalesce("_broke", F.lit(-1))).drop("_flag", "_broke")


def gap_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap: float, size: float = BLOCK,
               *, strict: bool = False) -> DataFrame:
    """Label ``piece`` = position of the first row after a silence of ``gap`` (``>=``; ``>`` when ``strict``).

    Rules that only look ``gap`` back restart there, so pieces can be worked on apart and stay exact. Whether a row
    starts a piece only asks for the row before it within ``gap``.
    """
    pos = F.col(order[0])
    rows = halo(df, order[0], size, back=gap, ahead=0.0)
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    before = F.lag(pos).over(w)
    near = (pos - before <= gap) if strict else (pos - before < gap)
    rows = rows.withColumn("_first", F.when(~F.coalesce(near, F.lit(False)), pos)).where("_own")
    rows = rows.select(*df.columns, "_first")
    return prefix(rows, keys, order, size, fills={"piece": F.col("_first")}).drop("_first")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles per key, one row per key.

    Equal values are counted first (map-side combined), the distinct values are cut into ordered cells, and ranks
    come from :func:`prefix` over the cells. No task holds a key's values, whatever the key's share of the table.
    """
    keys = list(keys)
    counts = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = counts.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # asinh keeps the order and gives a heavy tail few cells: at most some ten thousand over all doubles
    counts = counts.withColumn("_cell", F.floor(F.asinh("_v") * 64.0).cast("long"))
    ranked = prefix(counts, keys, ["_cell", "_v"], 1, sums={"_to": F.col("_n")}, back_sums={"_rest": F.col("_n")})
    ranked = ranked.withColumns({"_from": F.col("_to") - F.col("_n"),
                                 "_total": F.col("_to") + F.col("_rest") - F.col("_n")})
    aggs = []
    for name, p in probs.items():
        target = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(target), F.ceil(target)

        def at(rank):
            return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

        aggs.append((at(low) + (at(high) - at(low)) * F.max(target - low)).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


class Fold:
    """One key's sequential walk: ``step`` gets its rows in order, ``close`` ends it; both give output tuples."""

    def step(self, row):
        raise NotImplementedError

    def close(self):
        return ()


def dealt(df: DataFrame, *keys: str, slow: bool = False) -> DataFrame:
    """``df`` with each key's rows in one partition.

    By a hash of the keys, not by the keys: a join by the same keys would count as having dealt them already, and Spark,
    which may still turn that join into a broadcast, would then read its rows in pieces. ``slow``: Python works long on a
    row, so partitions that are small in bytes are not put together; a few large tasks would keep the other cores waiting.
    """
    key = F.xxhash64(*keys)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key) if slow else df.repartition(key)


def fold_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[tuple], Fold], schema: StructType,
    *, slow: bool = False
) -> DataFrame:
    """Walk each key's rows in order with a small carried state; keys are spread over the cluster.

    Rows stream through in Arrow batches, so neither a key nor a partition is ever held in memory. ``slow``: a step is
    long work (see ``dealt``).
    """
    keys = list(keys)
    arranged = dealt(df, *keys, slow=slow).sortWithinPartitions(*keys, *order)
    names = schema.names

    def walk(batches):
        current, state = None, None
        for pdf in batches:
            out = []
            row_keys = zip(*[pdf[k].tolist() for k in keys])
            for key, row in zip(row_keys, pdf.itertuples(index=False)):
                if key != current:
                    if state is not None:
                        out.extend(state.close())
                    current, state = key, make(key)
                out.extend(state.step(row))
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None:
            out = list(state.close())
            if out:
                yield pd.DataFrame(out, columns=names)

    return arranged.mapInPandas(walk, schema)


def rescaled_gain(gain: float, rate: float, reference: float = 5.0) -> float:
    """An EMA gain tuned at ``reference`` rows per second, with the same time constant at ``rate``."""
    return 1.0 - (1.0 - gain) ** (reference / rate)


def rated(df: DataFrame, rate: float | DataFrame) -> DataFrame:
    """``df`` with its sampling ``rate`` in frames per second: one number for all matches, or a table ``match_id, rate`` (5
    where that has none)."""
    if isinstance(rate, DataFrame):
        return df.join(rate.select("match_id", F.col("rate").cast("double").alias("rate")), "match_id", "left").na.fill({"rate": 5.0})
    return df.withColumn("rate", F.lit(float(rate)))


def frames_in(seconds: float, rate: Column) -> Column:
    """:func:`frames_for` over a column of rates."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(seconds)) * rate)).cast("long")


def frames_for(seconds: float, rate: float) -> int:
    """A duration in whole frames, at least one."""
    return max(1, int(round(seconds * rate)))


def clip(c, low, high) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def isfinite(c) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
