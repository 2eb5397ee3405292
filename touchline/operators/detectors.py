"""Comparing detectors: box overlap, size bands, per-frame counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import exact_percentiles
from .topk import top_k

FRAME = ["match_id", "frame"]
CELL = 0.1  # grid cell over the frame width; a box lies in few cells


def box_overlaps(a: DataFrame, b: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Pairs of boxes in a frame with at least ``min_iou`` overlap.

    Both sides are placed on a grid; a pair meets in every cell both touch and is kept only in the cell holding the
    upper left corner of the overlap, so far-apart boxes never meet and no pair comes twice.
    """
    def placed(df, tag):
        def cells(lo, hi):
            return F.explode(F.sequence(F.floor(F.col(lo) / CELL), F.floor(F.col(hi) / CELL)))

        named = df.select(*FRAME, F.col("det_id").alias(f"{tag}_id"), *[F.col(c).alias(f"{tag}{c}") for c in ("x1", "y1", "x2", "y2")])
        return named.withColumn("_cx", cells(f"{tag}x1", f"{tag}x2")).withColumn("_cy", cells(f"{tag}y1", f"{tag}y2"))

    pairs = placed(a, "a").join(placed(b, "b"), [*FRAME, "_cx", "_cy"])
    x1, y1 = F.greatest("ax1", "bx1"), F.greatest("ay1", "by1")
    inter = F.greatest(F.least("ax2", "bx2") - x1, F.lit(0.0)) * F.greatest(F.least("ay2", "by2") - y1, F.lit(0.0))
    area = ((F.col("ax2") - F.col("ax1")) * (F.col("ay2") - F.col("ay1"))
            + (F.col("bx2") - F.col("bx1")) * (F.col("by2") - F.col("by1")))
    iou = inter / F.nullif(area - inter, F.lit(0.0))
    home = (F.floor(x1 / CELL) == F.col("_cx")) & (F.floor(y1 / CELL) == F.col("_cy"))
    return pairs.where(home).select(*FRAME, "a_id", "b_id", iou.alias("iou")).where(F.col("iou") >= min_iou)


def iou_match(a: DataFrame, b: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """One-to-one pairs, best overlap first, then lower ids.

    A frame's pairs are few, as boxes of one frame; they are sorted and walked in one expression, after one exchange by
    frame. Nothing runs while the plan is built.
    """
    pairs = box_overlaps(a, b, min_iou).groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("iou")).alias("rank"), "a_id", "b_id"))).alias("_pairs"))
    none = F.filter("_pairs", lambda p: F.lit(False))
    free = lambda taken, p: ~F.exists(taken, lambda q: (q["a_id"] == p["a_id"]) | (q["b_id"] == p["b_id"]))
    taken = F.aggregate("_pairs", none, lambda taken, p: F.when(free(taken, p), F.array_append(taken, p)).otherwise(taken))
    return pairs.select(*FRAME, F.explode(taken).alias("_p")).select(
        *FRAME, "_p.a_id", "_p.b_id", (-F.col("_p.rank")).alias("iou"))


def pair_totals(a: DataFrame, b: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Matched, only-a and only-b counts per match."""
    def count(df, name):
        return df.groupBy("match_id").agg(F.count(F.lit(1)).alias(name))

    rows = count(a, "n_a").join(count(b, "n_b"), "match_id", "full").join(
        count(iou_match(a, b, min_iou), "m"), "match_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b", "m")}
    return rows.select("match_id", n["m"].alias("matched"), (n["n_a"] - n["m"]).alias("only_a"),
                       (n["n_b"] - n["m"]).alias("only_b"))


def height_bands(dets: DataFrame) -> DataFrame:
    """Detections per height band and in all (``band`` "all"), per match."""
    h = F.col("height_px")
    band = (F.when(h < 14, "h<14").when(h < 24, "14-24").when(h < 40, "24-40").when(h < 60, "40-60").otherwise(">=60"))
    out = dets.withColumn("band", band).groupBy("match_id", "band").count()
    total = out.rollup("match_id", "band").agg(F.sum("count").alias("n")).where(F.col("match_id").isNotNull())
    return total.select("match_id", F.coalesce("band", F.lit("all")).alias("band"), "n")


def detector_table(dets: DataFrame, frames: DataFrame, min_height: float) -> DataFrame:
    """Per match: totals, above the height floor, median per frame, median confidence, frames with a ball."""
    person, ball = F.col("cls") != "ball", F.col("cls") == "ball"
    tall = person & (F.col("height_px") >= min_height)
    per = frames.select(*FRAME).join(dets.groupBy(*FRAME).agg(
        F.count(F.when(person, 1)).alias("people"), F.count(F.when(tall, 1)).alias("tall"),
        F.count(F.when(ball, 1)).alias("balls")), FRAME, "left").na.fill(0, ["people", "tall", "balls"])
    sums = per.groupBy("match_id").agg(F.sum("people").alias("detections"), F.sum("tall").alias("above_floor"),
                                       F.sum("balls").alias("balls"),
                                       F.count(F.when(F.col("balls") > 0, 1)).alias("frames_with_ball"))
    mid = exact_percentiles(per, ["match_id"], F.col("tall"), {"median_per_frame": 0.5})
    conf = exact_percentiles(dets.where(person), ["match_id"], F.col("conf"), {"median_conf": 0.5})
    return sums.join(mid, "match_id", "left").join(conf, "match_id", "left")


def class_mix(dets: DataFrame) -> DataFrame:
    return dets.groupBy("match_id", "cls").agg(F.count(F.lit(1)).alias("n"))


def ball_recall(track: DataFrame, dets: DataFrame, reach: float = 0.03) -> DataFrame:
    """Of the frames with a tracked ball, those with a detection centered within ``reach``."""
    seen = track.where(F.col("status") == "tracking").select(*FRAME, "u", "v")
    near = F.hypot((F.col("x1") + F.col("x2")) / 2.0 - F.col("u"), (F.col("y1") + F.col("y2")) / 2.0 - F.col("v")) <= reach
    per = seen.join(dets.select(*FRAME, "x1", "y1", "x2", "y2"), FRAME, "left").groupBy(*FRAME).agg(
        F.coalesce(F.bool_or(near), F.lit(False)).alias("hit"))
    return per.groupBy("match_id").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.lit(1)).alias("frames"))


def disagreement_topk(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """Frames whose detection counts differ most, ``k`` per match."""
    def count(df, name):
        return df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(name))

    both = count(a, "n_a").join(count(b, "n_b"), FRAME, "full").na.fill(0, ["n_a", "n_b"])
    both = both.withColumn("diff", F.abs(F.col("n_a") - F.col("n_b")))
    return top_k(both, ["match_id"], [F.col("diff").desc(), F.col("frame")], k)
