"""Crop paths that follow a player, and positions between analysis frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import with_between_rotations
from ..session import cut
from .blocks import exact_percentiles, halo
from .joins import neighbors

# Fixed values of the framing rules
PLAYER_SHARE, MIN_CROP_PX, RATE_HZ, SMOOTH_S, MAX_GAP_S, TAIL_S = 0.25, 480.0, 60.0, 0.7, 2.0, 1.0
KEY = ["match_id", "track_id", "clip_id"]


def _even(c):
    return F.greatest(F.lit(2.0), F.bround(c / 2.0, 0) * 2.0)


def clip_end(boxes: DataFrame, clips: DataFrame) -> DataFrame:
    """Where each clip ``(match_id, track_id, clip_id, start_s, duration_s)`` really ends, and why."""
    steps = halo(boxes.select("match_id", "track_id", "t"), "t", 600.0, back=0.0, ahead=MAX_GAP_S)
    w = Window.partitionBy("match_id", "track_id", "_blk").orderBy("t")
    after = F.lead("t").over(w)
    last = boxes.groupBy("match_id", "track_id").agg(F.max("t").alias("_last"), F.count(F.lit(1)).alias("_n"))
    steps = steps.withColumn("_nt", after).where("_own")
    # no sighting within the gap limit: the track pauses (or ends) here
    stops = steps.join(last, ["match_id", "track_id"]).where(
        (F.col("_nt").isNull() | (F.col("_nt") - F.col("t") > MAX_GAP_S)) & (F.col("t") < F.col("_last"))).select(
        "match_id", "track_id", "t")
    rows = clips.join(last, ["match_id", "track_id"]).where(F.col("_n") >= 2)
    want = F.col("start_s") + F.greatest(F.col("duration_s"), F.lit(0.0))
    early = F.col("_last") < want - TAIL_S
    rows = rows.withColumns({"_end": F.when(early, F.col("_last") + TAIL_S).otherwise(want), "_early": early})
    rows = neighbors(rows, stops, ["match_id", "track_id"], "start_s", "t")
    cut_here = F.col("next.t") < F.col("_end")
    end = F.when(cut_here, F.col("next.t")).otherwise(F.col("_end"))
    why = F.when(cut_here, "gap in the track").when(F.col("_early"), "track ended").otherwise("")
    return rows.select(*KEY, "start_s", end.alias("end_s"), why.alias("truncated")).where(
        F.col("end_s") > F.col("start_s"))


#: clips of one track and minute that meet the boxes of that minute in one place
SHARE_CLIPS = 256


def _inside(boxes: DataFrame, ends: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Boxes within a clip of their track. Both sides meet by minute, so a clip meets the boxes around it only.

    Where many clips show one track in one minute they are dealt to shares, and each share has the minute's boxes: no task
    makes all the pairs of a track that is asked for very often.
    """
    minute = lambda c: F.floor(F.col(c) / bucket).cast("long")
    place = ["match_id", "track_id", "_m"]
    spans = ends.select(*KEY, "start_s", "end_s", F.explode(F.sequence(minute("start_s"), minute("end_s"))).alias("_m"))
    shares = spans.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / SHARE_CLIPS).cast("int").alias("_shares"))
    spans = spans.join(shares, place).withColumn("_share", F.pmod(F.xxhash64("clip_id"), F.col("_shares")).cast("int")).drop("_shares")
    dealt = boxes.withColumn("_m", minute("t")).join(shares, place).withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    return dealt.join(spans, [*place, "_share"]).where(F.col("t").between(F.col("start_s"), F.col("end_s"))).drop("_m", "_share")


def crop_size(boxes: DataFrame, ends: DataFrame, width: int, height: int) -> DataFrame:
    """Crop width and height per clip from the median box height inside it."""
    inside = _inside(boxes, ends)
    middle = exact_percentiles(inside, KEY, F.abs(F.col("y2") - F.col("y1")) * width, {"_h": 0.5})
    rows = ends.select(*KEY).join(middle, KEY, "left")
    target = F.when(F.col("_h") > 0, F.col("_h") / PLAYER_SHARE).otherwise(MIN_CROP_PX)
    rows = rows.withColumn("crop_h", _even(F.least(F.greatest(target, F.lit(MIN_CROP_PX)), F.lit(float(height)))))
    return rows.select(*KEY, _even(F.least(F.col("crop_h") * width / height, F.lit(float(width)))).alias("crop_w"), "crop_h")


#: points of crop paths that one task makes
TASK_POINTS = 250_000


def deal_clips(ends: DataFrame, steps: Column) -> DataFrame:
    """Clips dealt to tasks by the points they become: a row of a few bytes is hundreds of points, so the size of ``ends``
    says nothing about them."""
    points = ends.agg(F.sum(steps.cast("long") + 1)).first()[0] or 0
    return ends.repartition(max(1, -(-points // TASK_POINTS)), *KEY)


def crop_path(boxes: DataFrame, clips: DataFrame, width: int, height: int, rate_hz: float = RATE_HZ,
              smooth_s: float = SMOOTH_S) -> DataFrame:
    """Crop corner over time per clip: ``t`` from the clip's start, ``x``, ``y``; only changes and the two ends.

    ``boxes``: ``match_id, track_id, t, x1, y1, x2, y2`` over the frame width.
    """
    ends = cut(clip_end(boxes, clips))
    length = F.col("end_s") - F.col("start_s")
    steps = F.greatest(F.lit(1), F.ceil(length * rate_hz).cast("int"))
    grid = deal_clips(ends, steps).withColumn("i", F.explode(F.sequence(F.lit(0), steps))).withColumn("_n", steps)
    # evenly spaced, snapped to the command rate; the last point is the exact end
    snapped = F.bround(F.col("i") * length / F.col("_n") * rate_hz, 0) / rate_hz
    grid = grid.withColumn("_g", F.when(F.col("i") == F.col("_n"), length).otherwise(snapped))
    grid = grid.where((F.col("i") == F.col("_n")) | (F.col("_g") < length - 1e-9)).dropDuplicates([*KEY, "_g"])
    grid = grid.withColumn("_at", F.col("start_s") + F.col("_g"))
    place = boxes.select("match_id", "track_id", "t", ((F.col("x1") + F.col("x2")) * (width / 2.0)).alias("cx"),
                         ((F.col("y1") + F.col("y2")) * (width / 2.0)).alias("cy"))
    # only sightings inside the clip count; outside them the nearest one is held
    inside = _inside(place, ends)
    enough = inside.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= 2)
    around = neighbors(ends.join(enough, KEY, "left_anti").select(*KEY, "start_s"), place, ["match_id", "track_id"], "start_s", "t", ["cx", "cy"])
    later = F.col("next.t") - F.col("start_s") < F.col("start_s") - F.col("prev.t")
    lone = around.withColumn("s", F.when(F.col("prev").isNull() | F.coalesce(later, F.lit(False)), F.col("next")).otherwise(F.col("prev"))).where(
        F.col("s").isNotNull()).select(*KEY, "s.t", "s.cx", "s.cy")
    used = inside.join(enough.select(*KEY), KEY, "left_semi").select(*KEY, "t", "cx", "cy").unionByName(lone)
    pts = neighbors(grid.select(*KEY, "i", "_n", "_g", "_at"), used, KEY, "_at", "t", ["cx", "cy"])
    p, n = F.col("prev"), F.col("next")
    share = (F.col("_at") - p["t"]) / F.nullif(n["t"] - p["t"], F.lit(0.0))

    def mix(c):
        return F.when(n.isNull(), p[c]).when(p.isNull(), n[c]).when(share.isNull(), p[c]).otherwise(
            p[c] + share * (n[c] - p[c]))

    pts = cut(pts.select(*KEY, "i", "_n", "_g", mix("cx").alias("_x"), mix("cy").alias("_y")))
    k = max(1, round(smooth_s * rate_hz))
    before, behind = k // 2, k - 1 - k // 2
    block = 4096
    reach = max(before, behind) + 2
    rows = halo(pts.withColumn("_pos", F.col("i").cast("long")), "_pos", block, back=reach, ahead=reach)
    w = Window.partitionBy(*KEY, "_blk").orderBy("_pos")
    span = w.rowsBetween(-before, behind)
    # edge padding: missing neighbors repeat the first or last value
    lack_before = F.greatest(F.lit(0), F.lit(before + 1) - F.row_number().over(w))
    left = F.count(F.lit(1)).over(w.rowsBetween(1, behind)) if behind else F.lit(0)
    lack_after = F.lit(behind) - left

    def smooth(c):
        if k <= 1:
            return F.col(c)
        head = F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
        tail = F.last(c).over(w.rowsBetween(0, Window.unboundedFollowing))
        return (F.sum(c).over(span) + lack_before * head + lack_after * tail) / float(k)

    total = F.col("_n")
    rows = rows.withColumns({"_sx": smooth("_x"), "_sy": smooth("_y")})
    rows = rows.withColumns({
        "_sx": F.when(total < 2, F.col("_x")).otherwise(F.col("_sx")),
        "_sy": F.when(total < 2, F.col("_y")).otherwise(F.col("_sy"))})
    rows = rows.join(crop_size(boxes, ends, width, height), KEY)

    def corner(c, size, limit):
        free = F.greatest(F.lit(0.0), limit - size)
        return F.bround(F.least(F.greatest(c - size / 2.0, F.lit(0.0)), free), 0).cast("long")

    rows = rows.withColumns({"x": corner(F.col("_sx"), F.col("crop_w"), F.lit(float(width))),
                             "y": corner(F.col("_sy"), F.col("crop_h"), F.lit(float(height)))})
    w = Window.partitionBy(*KEY, "_blk").orderBy("_pos")
    same = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))
    rows = rows.withColumn("_same", F.coalesce(same, F.lit(False))).where("_own")
    return rows.where(~F.col("_same") | (F.col("i") == F.col("_n"))).select(*KEY, F.col("_g").alias("t"), "x", "y",
                                                                           "crop_w", "crop_h")


def resample_boxes(boxes: DataFrame, fps: float, rate: float, frames: DataFrame) -> DataFrame:
    """Boxes at a finer rate: moved linearly when the next frame has the track, held otherwise.

    ``frames``: ``match_id, last_frame``. Output position ``p = k * fps / rate`` for each output index ``k``.
    """
    rows = halo(boxes, "frame", 4096, back=0, ahead=1)
    w = Window.partitionBy("match_id", "track_id", "_blk").orderBy("frame")
    after = F.lead(F.struct("frame", "x1", "y1", "x2", "y2")).over(w)
    rows = rows.withColumn("_n", after).where("_own").join(frames, "match_id")
    lo = F.ceil(F.col("frame") * rate / fps - 1e-9)
    hi = F.when(F.col("frame") >= F.col("last_frame"), lo).otherwise(F.ceil((F.col("frame") + 1) * rate / fps - 1e-9) - 1)
    rows = rows.where(hi >= lo).withColumn("k", F.explode(F.sequence(lo, hi)))
    share = F.col("k") * fps / rate - F.col("frame")
    rows = rows.where((F.col("frame") < F.col("last_frame")) | (share <= 1e-9))
    moves = F.col("_n.frame") == F.col("frame") + 1

    def mix(c):
        return F.when(moves, F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * share).otherwise(F.col(c)).alias(c)

    return rows.select("match_id", "track_id", F.col("k").cast("long").alias("k"), *[mix(c) for c in ("x1", "y1", "x2", "y2")])


def resample_ball(ball: DataFrame, fps: float, rate: float) -> DataFrame:
    """Ball between frames: only where both neighbors see it; ``measured`` from the nearer frame."""
    rows = halo(ball, "frame", 4096, back=0, ahead=1)
    w = Window.partitionBy("match_id", "_blk").orderBy("frame")
    after = F.lead(F.struct("frame", "x", "y", "measured")).over(w)
    rows = rows.withColumn("_n", after).where("_own").where(F.col("x").isNotNull())
    lo = F.ceil(F.col("frame") * rate / fps - 1e-9)
    hi = F.when(F.col("_n").isNull(), lo).otherwise(F.ceil((F.col("frame") + 1) * rate / fps - 1e-9) - 1)
    rows = rows.where(hi >= lo).withColumn("k", F.explode(F.sequence(lo, hi)))
    share = F.col("k") * fps / rate - F.col("frame")
    exact = share <= 1e-9
    rows = rows.where(exact | F.col("_n.x").isNotNull())

    def mix(c):
        return F.when(exact, F.col(c)).otherwise(F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * share).alias(c)

    near = F.when(exact | (share < 0.5), F.col("measured")).otherwise(F.col("_n.measured"))
    return rows.select("match_id", F.col("k").cast("long").alias("k"), mix("x"), mix("y"), near.alias("measured"))


def resample_pose(frames: DataFrame, fps: float, rate: float) -> DataFrame:
    """Camera pose ``(match_id, frame, q, focal)`` between frames: shortest-arc rotation, linear focal length."""
    rows = halo(frames.select("match_id", "frame", "q", "focal"), "frame", 4096, back=0, ahead=1)
    w = Window.partitionBy("match_id", "_blk").orderBy("frame")
    rows = rows.withColumn("_n", F.lead(F.struct("frame", "q", "focal")).over(w)).where("_own")
    lo = F.ceil(F.col("frame") * rate / fps - 1e-9)
    hi = F.when(F.col("_n").isNull(), lo).otherwise(F.ceil((F.col("frame") + 1) * rate / fps - 1e-9) - 1)
    rows = rows.where(hi >= lo).withColumn("k", F.explode(F.sequence(lo, hi)))
    rows = rows.withColumns({"_s": F.col("k") * fps / rate - F.col("frame"), "_q2": F.coalesce("_n.q", "q")})
    rows = rows.where(F.col("_n").isNotNull() | (F.col("_s") <= 1e-9))
    rows = with_between_rotations(rows, "q", "_q2", F.col("_s"), "_mid")
    return rows.select("match_id", F.col("k").cast("long").alias("k"), F.col("_mid").alias("q"),
                       (F.col("focal") + (F.coalesce("_n.focal", "focal") - F.col("focal")) * F.col("_s")).alias("focal"))
