"""Joins in time and space that never emit all pairs of a group.

Nearest-in-time lookups merge both sides into one ordered stream and read the last and next known value
(:func:`neighbors`); windows and intervals are bucketed equi joins whose bucket is no wider than the rule needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_of, halo, prefix


def neighbors(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, right_t: str | None = None,
              payload: Sequence[str] = (), *, strict_prev: bool = False, block: float = 600.0,
              reach: float | None = None) -> DataFrame:
    """Add ``prev`` and ``next``: structs (``t`` + payload) of the right rows around each left row's time.

    Right rows at exactly the left time count as ``next``, and as ``prev`` unless ``strict_prev``. With ``reach`` only
    right rows at most that far away matter: they are copied to the blocks that may ask for them, in one pass.
    """
    keys, right_t = list(keys), right_t or t
    row = F.struct(*[F.col(c) for c in left.columns])
    value = F.struct(F.col(right_t).cast("double").alias("t"), *[F.col(c) for c in payload])
    a = left.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_left"), row.alias("_row"))
    b = right.where(F.col(right_t).isNotNull()).select(
        *keys, F.col(right_t).cast("double").alias("_t"), F.lit(0).alias("_left"), value.alias("_value"))
    # which side comes first at equal times decides whether an equal time counts
    fwd = F.when(F.col("_left") == 1, 0 if strict_prev else 1).otherwise(1 if strict_prev else 0)
    if reach is None:
        both = a.unionByName(b, allowMissingColumns=True).withColumns({"_fwd": fwd, "_bwd": 1 - F.col("_left")})
        both = prefix(both, keys, ["_t", "_fwd"], block, back_order=["_t", "_bwd"],
                      fills={"prev": F.col("_value")}, back_fills={"next": F.col("_value")})
    else:
        a = a.withColumn("_blk", block_of("_t", block))
        b = halo(b, "_t", block, back=reach, ahead=reach).drop("_own")
        both = a.unionByName(b, allowMissingColumns=True).withColumns({"_fwd": fwd, "_bwd": 1 - F.col("_left")})
        part = Window.partitionBy(*keys, "_blk")
        both = both.withColumns({
            "prev": F.last("_value", ignorenulls=True).over(
                part.orderBy("_t", "_fwd").rowsBetween(Window.unboundedPreceding, 0)),
            "next": F.last("_value", ignorenulls=True).over(
                part.orderBy(F.col("_t").desc(), F.col("_bwd").desc()).rowsBetween(Window.unboundedPreceding, 0))})
    return both.where(F.col("_left") == 1).select("_row.*", "prev", "next")


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, right_t: str | None = None,
                 payload: Sequence[str] = (), block: float = 600.0) -> DataFrame:
    """Each left row takes the right row nearest in time: the earlier one only when strictly closer."""
    out = neighbors(left, right, keys, t, right_t, payload, strict_prev=True, block=block)
    back, ahead = F.col(t) - F.col("prev.t"), F.col("next.t") - F.col(t)
    earlier = F.col("next").isNull() | (back < ahead)
    pick = F.when(F.col("prev").isNotNull() & earlier, F.col("prev")).otherwise(F.col("next"))
    return out.withColumn("near", pick).drop("prev", "next")


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, gap: float, flag: str,
           block: float = 600.0) -> DataFrame:
    """Add ``flag``: whether any right row lies strictly closer than ``gap`` in time."""
    out = neighbors(left, right, keys, t, block=block, reach=gap)
    back = F.coalesce(F.col(t) - F.col("prev.t") < gap, F.lit(False))
    ahead = F.coalesce(F.col("next.t") - F.col(t) < gap, F.lit(False))
    return out.withColumn(flag, back | ahead).drop("prev", "next")


def first_in_window(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, before: float, after: float,
                    name: str, right_t: str | None = None) -> DataFrame:
    """First right time inside ``[t - before, t + after]`` of each left row, else NULL."""
    shifted = left.withColumn("_from", F.col(t) - before)
    out = neighbors(shifted, right, keys, "_from", right_t, reach=before + after)
    return out.withColumn(name, F.when(F.col("next.t") <= F.col(t) + after, F.col("next.t"))).drop(
        "prev", "next", "_from")


def nearest_player(points: DataFrame, obs: DataFrame, ids: Sequence[str], radius: float) -> DataFrame:
    """The player nearest each point around its frame.

    ``points``: ``match_id, frame, px, py, lag`` plus ``ids``. Frames ``c-lag .. c+lag`` around ``c = max(0, frame -
    lag)`` are looked at; smallest distance wins, then the earlier frame, then the lower track.
    """
    ids = list(ids)
    center = F.greatest(F.lit(0), F.col("frame") - F.col("lag"))
    spread = points.select("match_id", *ids, "px", "py",
                           F.explode(F.sequence(-F.col("lag"), F.col("lag"))).alias("_off"), center.alias("_c"))
    spread = spread.withColumn("_f", F.col("_c") + F.col("_off"))
    o = obs.select(F.col("match_id").alias("_m"), F.col("frame").alias("_of"), "track_id", "team", "x", "y")
    pairs = spread.join(o, (spread.match_id == o["_m"]) & (spread["_f"] == o["_of"]))
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    best = F.min(F.struct(d.alias("d"), F.col("_off").alias("o"), "track_id", "team"))
    found = pairs.where(d <= radius).groupBy("match_id", *ids).agg(best.alias("_b"))
    return points.join(found, ["match_id", *ids], "left").select(
        *points.columns, F.col("_b.track_id").alias("player_track"), F.col("_b.team").alias("player_team"),
        F.col("_b.d").alias("player_distance"))


def image_possession(lock: DataFrame, dets: DataFrame, radius: float = 0.08) -> DataFrame:
    """Touches per match from image positions: nearest foot point to the locked ball, frame by frame."""
    ball = lock.where(F.col("locked") & F.col("u").isNotNull()).select("match_id", "frame", "u", "v")
    near = dets.join(ball, ["match_id", "frame"])
    du = (F.col("x1") + F.col("x2")) / 2.0 - F.col("u")
    d = F.when(F.col("v").isNull(), F.abs(du)).otherwise(F.hypot(du, F.col("y2") - F.col("v")))
    best = near.groupBy("match_id", "frame").agg(F.min(F.struct(d.alias("d"), "det_id", "team")).alias("b"))
    best = best.where(F.col("b.d") <= radius)
    out = best.groupBy("match_id").agg(
        F.count(F.when(F.col("b.team") == 0, 1)).alias("touches_0"),
        F.count(F.when(F.col("b.team") == 1, 1)).alias("touches_1"),
        F.count(F.lit(1)).alias("contested_frames"))
    total = F.nullif(F.col("touches_0") + F.col("touches_1"), F.lit(0))
    return out.withColumns({
        "share_0": F.coalesce(F.col("touches_0") / total, F.lit(0.0)),
        "share_1": F.coalesce(F.col("touches_1") / total, F.lit(0.0))})


def window_pieces(windows: DataFrame, clips: DataFrame, ids: Sequence[str], block: float = 60.0) -> DataFrame:
    """Cut game windows ``(match_id, ids, start_s, end_s)`` at clip borders; local start and duration per piece.

    Both sides are spread over time blocks; a pair is emitted only in the block where the overlap starts.
    """
    def blocks(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / block), F.floor(b / block)))

    w = windows.select("match_id", *ids, F.greatest("start_s", F.lit(0.0)).alias("ws"), F.col("end_s").alias("we"))
    w = w.where(F.col("we") > F.col("ws")).withColumn("_b", blocks(F.col("ws"), F.col("we")))
    c = clips.select("match_id", "path", F.col("start_s").alias("cs"),
                     (F.col("start_s") + F.col("duration_s")).alias("ce"))
    c = c.withColumn("_b", blocks(F.col("cs"), F.col("ce")))
    lo, hi = F.greatest("ws", "cs"), F.least("we", "ce")
    return w.join(c, ["match_id", "_b"]).where((hi > lo) & (F.floor(lo / block) == F.col("_b"))).select(
        "match_id", *ids, "path", (lo - F.col("cs")).alias("start_s"), (hi - lo).alias("duration_s"))


def clip_at(points: DataFrame, clips: DataFrame, t: str = "time_s") -> DataFrame:
    """The clip playing at each game time (clamped to the game) and the time inside it."""
    total = clips.groupBy("match_id").agg(F.max(F.col("start_s") + F.col("duration_s")).alias("_total"))
    at = points.join(total, "match_id").withColumn(
        "_at", F.greatest(F.lit(0.0), F.least(F.col(t).cast("double"), F.col("_total"))))
    out = neighbors(at, clips, ["match_id"], "_at", "start_s", ["path"])
    clip = F.coalesce("prev", "next")
    return out.select(*points.columns, clip["path"].alias("clip"),
                      F.greatest(F.lit(0.0), F.col("_at") - clip["t"]).alias("clip_t"))
