"""Image to ground and back, orientation from logged yaw, slow drift, and how clicks fit.

``calibrations``: one row per match with ``position ARRAY(3), base ARRAY(9), focal_scale, aspect``. ``frames``:
``match_id, frame, q ARRAY(9), focal, ok``. Calibrations are a per-match dimension; whether they are broadcast is left
to their measured size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels
from ..session import cut
from .blocks import BLOCK, exact_percentiles, halo, prefix
from .joins import neighbors

# Pitch markings in meters, pan-fit rules
GOAL_WIDTH, SPOT, CIRCLE = 7.32, 11.0, 9.15
PAN_WINDOWS, PAN_MIN_DEG, PAN_MIN_SAMPLES, PAN_ALIGNED, PAN_MIN_SCALE = (20, 10, 5), 1.0, 30, 0.99, 0.2


def _camera(frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    return frames.join(calibrations.select("match_id", "position", "base", "focal_scale", "aspect"), "match_id")


def _args():
    return [F.col(c) for c in ("q", "focal", "base", "position", "focal_scale", "aspect")]


def project_detections(dets: DataFrame, frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Add ``x, y, sigma_m, valid, height_px``: the foot point on the ground and what four pixels there mean."""
    rows = dets.join(_camera(frames.select("match_id", "frame", "q", "focal", "ok"), calibrations),
                     ["match_id", "frame"], "left")
    u, v = (F.col("x1") + F.col("x2")) / 2.0, F.col("y2")
    hx, hy = G.ground_hit(u, v, *_args())
    sx, sy = G.ground_hit(u, v + G.FOOT_PIXELS / G.FULL_WIDTH, *_args())
    rows = rows.withColumns({"_hx": hx, "_hy": hy, "_sx": sx, "_sy": sy})
    valid = F.coalesce(F.col("ok"), F.lit(False)) & F.col("_hx").isNotNull() & F.col("_sx").isNotNull()
    rows = rows.withColumn("valid", valid)
    return rows.select(
        *dets.columns, F.when(F.col("valid"), F.col("_hx")).alias("x"), F.when(F.col("valid"), F.col("_hy")).alias("y"),
        F.when(F.col("valid"), F.hypot(F.col("_sx") - F.col("_hx"), F.col("_sy") - F.col("_hy"))).alias("sigma_m"),
        "valid", ((F.col("y2") - F.col("y1")) * G.FULL_WIDTH).alias("height_px"))


def frame_aim(frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Ground point under the picture's center, NULL above the horizon."""
    rows = _camera(frames, calibrations)
    x, y = G.ground_hit(F.lit(0.5), F.col("aspect") * 0.5, *_args())
    return rows.select("match_id", "frame", x.alias("aim_x"), y.alias("aim_y"))


def project_ball(track: DataFrame, frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """One row per frame: ground position of a tracked or forecast ball; ``measured`` only when it was detected."""
    seen = track.where(F.col("status").isin("tracking", "coasting") & F.col("u").isNotNull() & F.col("v").isNotNull())
    rows = _camera(frames, calibrations).join(seen.select("match_id", "frame", "status", "u", "v"),
                                              ["match_id", "frame"], "left")
    x, y = G.ground_hit(F.col("u"), F.col("v"), *_args())
    measured = F.when(x.isNotNull() & (F.col("status") == "tracking"), 1.0).otherwise(0.0)
    return rows.select("match_id", "frame", x.alias("x"), y.alias("y"), measured.alias("measured"))


def pitch_to_pixels(points: DataFrame, frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Image position of ground points ``(match_id, frame, x, y)``; NULL behind the camera."""
    rows = points.join(_camera(frames.select("match_id", "frame", "q", "focal"), calibrations), ["match_id", "frame"])
    u, v = G.to_pixels(F.col("x"), F.col("y"), *_args())
    return rows.select(*points.columns, u.alias("u"), v.alias("v"))


def landmarks(matches: DataFrame) -> DataFrame:
    """The named pitch points of each match, from its ``length`` and ``width``."""
    length, width = F.col("length"), F.col("width")
    hl, hw, zero = length / 2.0, width / 2.0, F.lit(0.0)
    points = [
        ("corner near-left", zero, zero), ("corner near-right", length, zero),
        ("corner far-right", length, width), ("corner far-left", zero, width),
        ("goal post left-near", zero, hw - GOAL_WIDTH / 2), ("goal post left-far", zero, hw + GOAL_WIDTH / 2),
        ("goal post right-near", length, hw - GOAL_WIDTH / 2), ("goal post right-far", length, hw + GOAL_WIDTH / 2),
        ("halfway near", hl, zero), ("halfway far", hl, width), ("center spot", hl, hw),
        ("penalty spot left", F.lit(SPOT), hw), ("penalty spot right", length - SPOT, hw),
        ("center circle near", hl, hw - CIRCLE), ("center circle far", hl, hw + CIRCLE),
        ("center circle left", hl - CIRCLE, hw), ("center circle right", hl + CIRCLE, hw),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("label"), x.cast("double").alias("x"), y.cast("double").alias("y"))
                     for n, x, y in points])
    return matches.select("match_id", F.explode(rows).alias("p")).select("match_id", "p.label", "p.x", "p.y")


def projected_landmarks(marks: DataFrame, at: DataFrame, frames: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Image positions of a match's landmarks in the frames ``at`` (``match_id, frame``), where in front of the camera."""
    named = marks.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("label", "x", "y"))).alias("_marks"))
    # a frame meets its pose before it is spread over the landmarks, so it is shuffled once and not once for each
    poses = frames.select("match_id", "frame", "q", "focal").join(at.select("match_id", "frame"), ["match_id", "frame"])
    views = _camera(poses, calibrations).join(named, "match_id")
    rows = views.withColumn("_p", F.explode("_marks"))
    u, v = G.to_pixels(F.col("_p.x"), F.col("_p.y"), *_args())
    return rows.select("match_id", "frame", "_p.label", u.alias("u"), v.alias("v")).where(F.col("u").isNotNull())


def reprojection_rms(clicks: DataFrame, frames: DataFrame, calibrations: DataFrame, marks: DataFrame) -> DataFrame:
    """Per match: root mean square pixel error (at full width) of clicked landmarks."""
    named = clicks.withColumn("label", labels.upgrade_label(F.col("label"))).withColumnsRenamed({"u": "cu", "v": "cv"})
    seen = pitch_to_pixels(named.join(marks, ["match_id", "label"]), frames, calibrations).where(F.col("u").isNotNull())
    du, dv = F.col("u") - F.col("cu"), F.col("v") - F.col("cv")
    return seen.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("clicks"), (F.sqrt(F.avg(du * du + dv * dv)) * G.FULL_WIDTH).alias("rms_px"))


def dedupe_clicks(clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest click per (frame, label), and the labels clicked twice in one frame."""
    best = clicks.groupBy("match_id", "frame", "label").agg(
        F.max_by(F.struct("pid", "u", "v"), "pid").alias("c"), F.count(F.lit(1)).alias("n"))
    kept = best.select("match_id", "frame", "label", "c.pid", "c.u", "c.v")
    return kept, best.where(F.col("n") > 1).select("match_id", "label").distinct()


def log_orientation(frames: DataFrame, model: DataFrame) -> DataFrame:
    """Rotation per frame from logged yaw; a missing yaw holds the last one.

    ``frames``: ``match_id, frame, yaw``; ``model``: ``match_id, axis ARRAY(3), scale, yaw0``.
    """
    held = prefix(frames.select("match_id", "frame", "yaw"), ["match_id"], ["frame"], fills={"held": F.col("yaw")})
    rows = held.join(model, "match_id")
    angle = F.radians(F.col("scale") * (F.col("held") - F.col("yaw0")))
    ax = [F.col("axis")[i] for i in range(3)]
    norm = F.sqrt(ax[0] * ax[0] + ax[1] * ax[1] + ax[2] * ax[2])
    rows = rows.withColumn("_k", angle / norm)
    rows = G.with_rotation(rows, tuple(F.col("_k") * a for a in ax), "q")
    return rows.select("match_id", "frame", F.coalesce("q", G.identity()).alias("q"))


def apply_drift(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """Correct ``q`` and ``focal`` by anchors ``(match_id, frame, rot ARRAY(9), scale)``: along the shortest arc between
    two anchors, held outside, untouched in matches without anchors."""
    out = neighbors(frames, anchors, ["match_id"], "frame", payload=["rot", "scale"], block=BLOCK)
    p, n = F.col("prev"), F.col("next")
    share = F.when(n["t"] > p["t"], (F.col("frame") - p["t"]) / F.nullif(n["t"] - p["t"], F.lit(0.0))).otherwise(0.0)
    inner = p.isNotNull() & n.isNotNull()
    scale = F.when(inner, p["scale"] + share * (n["scale"] - p["scale"])).otherwise(
        F.coalesce(p["scale"], n["scale"], F.lit(1.0)))
    out = out.withColumns({"_share": share, "_scale": scale, "_a": F.coalesce(p["rot"], n["rot"], G.identity()),
                           "_b": F.coalesce(n["rot"], p["rot"], G.identity())})
    out = G.with_between_rotations(out, "_a", "_b", F.col("_share"), "_rot")
    keep = [c for c in frames.columns if c not in ("q", "focal")]
    return out.select(*keep, G.product(F.col("_rot"), F.col("q")).alias("q"),
                      (F.col("focal") * F.col("_scale")).alias("focal"))


def pan_scale(frames: DataFrame, tilt_deg: float = 0.0) -> DataFrame:
    """Rotation per degree of logged yaw, from frames ``(match_id, frame, q, ok, yaw)`` a window apart.

    The widest window with enough aligned samples is used; no row for a match that cannot be fitted.
    """
    lean = math.radians(90.0 - tilt_deg)
    axis = (0.0, math.sin(lean), math.cos(lean))
    parts = []
    for size in PAN_WINDOWS:
        at = frames.where(F.col("frame") % size == 0).select("match_id", "frame", "q", "ok", "yaw")
        rows = halo(at, "frame", BLOCK, back=size, ahead=0)
        w = Window.partitionBy("match_id", "_blk").orderBy("frame")
        before = F.lag(F.struct("frame", "q", "ok", "yaw")).over(w)
        rows = rows.withColumn("b", before).where("_own").where(
            (F.col("b.frame") == F.col("frame") - size) & F.col("ok") & F.col("b.ok"))
        rows = rows.withColumn("_turn", G.product(F.col("q"), F.col("b.q"), transpose_b=True))
        rows = G.with_rotation_vector(rows, "_turn", ("_vx", "_vy", "_vz"))
        rows = rows.withColumn("dyaw", F.col("yaw") - F.col("b.yaw"))
        size_of = F.sqrt(F.col("_vx") ** 2 + F.col("_vy") ** 2 + F.col("_vz") ** 2)
        signed = F.col("_vx") * axis[0] + F.col("_vy") * axis[1] + F.col("_vz") * axis[2]
        ok = (F.abs("dyaw") >= PAN_MIN_DEG) & (size_of >= 1e-9) & (F.abs(signed) >= size_of * PAN_ALIGNED)
        parts.append(rows.where(ok).select("match_id", F.lit(size).alias("window"), signed.alias("signed"), "dyaw"))
    samples = cut(reduce(DataFrame.unionByName, parts))
    counts = samples.groupBy("match_id", "window").agg(F.count(F.lit(1)).alias("samples"))
    chosen = counts.where(F.col("samples") >= PAN_MIN_SAMPLES).groupBy("match_id").agg(
        F.max_by(F.struct("window", "samples"), "window").alias("w")).select("match_id", "w.window", "w.samples")
    used = samples.join(chosen, ["match_id", "window"])
    middle = exact_percentiles(used, ["match_id"], F.col("signed") / F.radians("dyaw"), {"scale": 0.5})
    fit = used.join(middle.where(F.abs("scale") >= PAN_MIN_SCALE), "match_id")
    off = F.degrees(F.abs(F.col("signed") - F.radians(F.col("scale") * F.col("dyaw"))))
    known = frames.where(F.col("yaw").isNotNull()).groupBy("match_id").agg(F.min_by("yaw", "frame").alias("yaw0"))
    out = fit.groupBy("match_id").agg(F.first("scale").alias("scale"), F.first("samples").alias("samples"),
                                      F.sqrt(F.avg(off * off)).alias("rms_deg"))
    return out.join(known, "match_id").select("match_id", F.array(*[F.lit(a) for a in axis]).alias("axis"), "scale",
                                              "yaw0", "rms_deg", "samples")


def diagnose_fit(calibrations: DataFrame) -> DataFrame:
    """Which clicks agree with the fit: residual within three times the best, at least two meters."""
    low = F.array_min("residuals")
    tol = F.greatest(F.lit(2.0), low * 3.0)
    spots = F.transform("residuals", lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    good = F.filter(spots, lambda s: s["r"] <= tol)
    bad = F.filter(spots, lambda s: s["r"] > tol)
    return calibrations.select("match_id", tol.alias("tolerance_m"), F.transform(good, lambda s: s["i"]).alias("agreeing"),
                               F.transform(bad, lambda s: s["i"]).alias("disagreeing"))
