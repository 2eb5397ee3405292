"""Ball motion per frame and what the event rules ask of it.

``ball`` rows: ``match_id, frame, t, x, y, measured`` with one row for every frame from 0 up (unknown position NULL).
Every rule looks a bounded time back or ahead, so all windows run over ``(match, time block)`` with a halo.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, exact_percentiles, halo, runs

# Fixed values of the motion rules (meters, seconds, meters per second)
STATIC_MS, KICK_MS, SHOT_MS, CLEAR_MS, MAX_MS = 4.0, 12.0, 18.0, 20.0, 45.0
STATIC_S, WINDOW_S, MAX_STEP_S, HORIZON_S, LOOK_BACK_S = 1.0, 0.4, 1.0, 3.0, 1.5
STRAIGHT, MARGIN_M = 0.7, 3.0
CENTER_M, RESET_S, RESET_WINDOW_S = 12.0, 2.0, 60.0
TIME_BLOCK_S = 600.0


def drop_off_pitch(ball: DataFrame, length: float, width: float, margin: float = MARGIN_M) -> DataFrame:
    inside = F.col("x").between(-margin, length + margin) & F.col("y").between(-margin, width + margin)
    return ball.withColumns({"x": F.when(inside, F.col("x")), "y": F.when(inside, F.col("y"))})


def reject_spikes(ball: DataFrame, factor: float = 4.0) -> DataFrame:
    """Blank positions far from the median of their five-frame neighborhood, relative to the match's usual step."""
    rows = halo(ball, "frame", BLOCK, back=2, ahead=2)
    w = Window.partitionBy("match_id", "_blk").orderBy("frame")

    def middle(s):
        n = F.size(s)
        return F.when(n >= 3, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)

    # each neighbor is looked up once, and the sorted five are a column: an expression used twice would be worked out twice
    rows = rows.withColumns({f"_{c}{k}": F.lag(c, k).over(w) for c in "xy" for k in (2, 1, -1, -2)}).where("_own")
    rows = rows.withColumns({f"_{c}s": F.sort_array(F.array_compact(F.array(f"_{c}2", f"_{c}1", c, f"_{c}-1", f"_{c}-2"))) for c in "xy"})
    step = F.hypot(F.col("x") - F.col("_x1"), F.col("y") - F.col("_y1"))
    rows = rows.withColumns({"_mx": middle("_xs"), "_my": middle("_ys"), "_step": step})
    usual = exact_percentiles(rows, ["match_id"], F.col("_step"), {"_usual": 0.5})
    limit = F.greatest(F.coalesce("_usual", F.lit(1.0)), F.lit(0.5)) * factor * 3.0
    far = F.hypot(F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")) > limit
    judged = rows.join(usual, "match_id", "left").withColumn("_keep", ~F.coalesce(far, F.lit(False)))
    return judged.select(
        *[F.when(F.col("_keep"), F.col(c)).alias(c) if c in ("x", "y") else F.col(c) for c in ball.columns])


def _since(c: str, ms: int):
    """The row ``c`` if it is at most ``ms`` old. Frames that begin with the partition pass each row once, where one that moves
    at both ends would be gone through again for every row."""
    return F.when(F.col(c)["t_ms"] >= F.col("t_ms") - ms, F.col(c))


def ball_motion(ball: DataFrame, length: float | None = None, width: float | None = None) -> DataFrame:
    """Add ``t_ms, speed, vx, vy, straight`` from the net displacement over the last 0.4 s."""
    if length is not None:
        ball = drop_off_pitch(ball, length, width)
    clean = reject_spikes(ball).withColumn("t_ms", F.round(F.col("t") * 1000).cast("long"))
    rows = halo(clean, "t", TIME_BLOCK_S, back=WINDOW_S + MAX_STEP_S + 0.1, ahead=0.0)
    part = Window.partitionBy("match_id", "_blk")
    w = part.orderBy("t_ms")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    rows = rows.withColumn("_step", step).withColumns({
        "_path": F.coalesce(F.sum("_step").over(upto), F.lit(0.0)),
        "_gaps": F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).over(upto)})
    here = F.struct("t_ms", "t", "x", "y", "_path", "_gaps")
    window_ms, reach_ms = round(WINDOW_S * 1000), round((WINDOW_S + MAX_STEP_S) * 1000)
    rows = rows.withColumns({
        "_back": F.last(here).over(w.rangeBetween(Window.unboundedPreceding, -window_ms)),
        "_begin": F.first(F.when(F.col("frame") == 0, here), ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))})
    rows = rows.where("_own").withColumn("_b", F.coalesce(_since("_back", reach_ms), _since("_begin", window_ms - 1)))
    span = F.col("t") - F.col("_b.t")
    ok = (F.col("x").isNotNull() & F.col("_b.x").isNotNull() & (F.col("_gaps") == F.col("_b._gaps"))
          & (span >= WINDOW_S * 0.6) & (span <= WINDOW_S + MAX_STEP_S))
    nx, ny = F.col("x") - F.col("_b.x"), F.col("y") - F.col("_b.y")
    net = F.hypot(nx, ny)
    path = F.col("_path") - F.col("_b._path")
    rows = rows.withColumn("_ok", ok & (net / F.nullif(span, F.lit(0.0)) <= MAX_MS))

    def known(c):
        return F.when(F.col("_ok"), c)

    safe = F.nullif(span, F.lit(0.0))
    return rows.select(*ball.columns, "t_ms", known(net / safe).alias("speed"), known(nx / safe).alias("vx"),
                       known(ny / safe).alias("vy"),
                       known(F.when(path > 1e-6, net / F.nullif(path, F.lit(0.0))).otherwise(0.0)).alias("straight"))


def is_kick(threshold: float):
    return F.coalesce((F.col("speed") >= threshold) & (F.col("straight") >= STRAIGHT), F.lit(False))


def frame_facts(motion: DataFrame, length: float, width: float) -> DataFrame:
    """Per frame: the next kick after it, where a kick started, where the ball is 3 s later, center restarts."""
    rows = halo(motion, "t", TIME_BLOCK_S, back=LOOK_BACK_S + 1.0, ahead=6.5)
    part = Window.partitionBy("match_id", "_blk")
    w, back_w = part.orderBy("t_ms"), part.orderBy(F.col("t_ms").desc())
    still = F.coalesce(F.col("speed") < STATIC_MS, F.lit(False))
    center = F.hypot(F.col("x") - length / 2.0, F.col("y") - width / 2.0) <= CENTER_M
    rows = rows.withColumns({
        "still": still,
        "_kick": F.when(is_kick(KICK_MS), F.struct("t_ms", F.struct("frame", "t", "x", "y", "speed").alias("v"))),
        "_calm": F.coalesce((F.col("measured") > 0) & center, F.lit(False)) & still,
    })
    horizon, keep_ms = round(HORIZON_S * 1000), round((RESET_S + 1.0) * 1000)
    begin = Window.unboundedPreceding

    def ahead(c, from_ms):
        """The first row with ``c`` from ``from_ms`` on: the last one of a frame that runs from the end."""
        return F.last(c, ignorenulls=True).over(back_w.rangeBetween(begin, -from_ms))

    def until(c, ms, value):
        return F.when(F.col(c)["t_ms"] <= F.col("t_ms") + ms, value)

    rows = rows.withColumns({
        "_later": ahead(F.struct("t_ms", "x", "y"), horizon),
        "_broke": ahead(F.when(~F.col("_calm"), F.struct("t_ms", "t")), 1),
        "_next": ahead(F.col("_kick"), 0)})
    rows = rows.withColumns({
        "_seen": F.last(F.struct("x", "y")).over(w.rangeBetween(begin, horizon)),
        "_kept": F.last("t").over(w.rangeBetween(begin, keep_ms))})
    ends = F.coalesce(until("_broke", keep_ms, F.col("_broke.t")), F.col("_kept"))
    rows = rows.withColumns({
        "later": F.coalesce(until("_later", horizon + 1000, F.struct("_later.x", "_later.y")), F.col("_seen")),
        "reset": F.col("_calm") & (F.round((ends - F.col("t")) * 1000) >= RESET_S * 1000),
        "_next3": until("_next", 3000, F.col("_next.v")), "_next5": until("_next", 5000, F.col("_next.v")),
    })
    rows = rows.withColumn("_place", F.struct("frame", "t", "x", "y", "later"))
    here = F.struct("t_ms", F.col("_place").alias("v"))
    back_ms = round(LOOK_BACK_S * 1000)
    # the row after a pause is the first in reach of those whose look-back ends in the pause
    gap = F.lead("t_ms").over(w) - F.col("t_ms") > 1000
    rows = rows.withColumn("_after", F.when(gap, F.lead("_place").over(w)))
    rows = rows.withColumns({
        "_still": F.last(F.when(F.col("still"), here), ignorenulls=True).over(w.rangeBetween(begin, 0)),
        "_old": F.last(F.struct("t_ms", F.col("_place").alias("v"), "_after")).over(w.rangeBetween(begin, -back_ms)),
        "_first": F.first("_place").over(w.rangeBetween(begin, 0)),
        "kick_after_3": F.lead("_next3").over(w), "kick_after_5": F.lead("_next5").over(w)})
    origin = F.coalesce(
        _since("_still", back_ms - 1)["v"], _since("_old", back_ms + 1000)["v"],
        F.when(F.col("_old").isNotNull(), F.col("_old._after")).otherwise(F.col("_first")))
    rows = rows.withColumn("origin", origin)
    return rows.where("_own").select(*motion.columns, "still", "later", "reset", "origin", "kick_after_3",
                                     "kick_after_5")


def static_runs(facts: DataFrame, min_s: float = STATIC_S) -> DataFrame:
    """Spells of a resting ball: first and end frame, times, the place, and the first kick after."""
    labeled = runs(facts, ["match_id"], "frame", F.col("still"))
    carry = [F.max_by(c, "frame").alias(c) for c in ("kick_after_3", "kick_after_5") if c in facts.columns]
    out = labeled.groupBy("match_id", "run").agg(
        F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), F.min("t").alias("start_t"), F.max("t").alias("last_t"),
        F.min_by("x", "frame").alias("x"), F.min_by("y", "frame").alias("y"), *carry)
    return out.where(F.round((F.col("last_t") - F.col("start_t")) * 1000) >= min_s * 1000)


def goal_mouth_hits(facts: DataFrame, length: float, width: float) -> DataFrame:
    """Frames with the ball at a goal mouth moving in (``side`` 0 left, 1 right)."""
    mouth = F.abs(F.col("y") - width / 2.0) <= 3.66 + 1.5
    side = (F.when((F.col("x") <= 2.5) & (F.col("vx") < -KICK_MS), 0)
            .when((F.col("x") >= length - 2.5) & (F.col("vx") > KICK_MS), 1))
    return facts.where(mouth & F.col("vx").isNotNull()).withColumn("side", side).where(F.col("side").isNotNull())


def in_play(lock: DataFrame, min_frames: int = 5) -> DataFrame:
    """Locked runs of at least ``min_frames`` frames: one row per spell."""
    labeled = runs(lock, ["match_id"], "frame", F.col("locked"))
    return labeled.groupBy("match_id", "run").agg(
        F.min("frame").alias("start_frame"), F.count(F.lit(1)).alias("frames"), (F.max("frame") + 1).alias("end_frame")).where(
        F.col("frames") >= min_frames)


def pan_rate(telemetry: DataFrame) -> DataFrame:
    """Absolute change of yaw per frame; unknown counts as no movement."""
    rows = halo(telemetry, "frame", BLOCK, back=1, ahead=0)
    w = Window.partitionBy("match_id", "_blk").orderBy("frame")
    rate = F.coalesce(F.abs(F.col("yaw") - F.lag("yaw").over(w)), F.lit(0.0))
    return rows.withColumn("pan_rate", rate).where("_own").drop("_blk", "_own")


def status_counts(track: DataFrame) -> DataFrame:
    return track.groupBy("match_id", "status").agg(F.count(F.lit(1)).alias("n"))
