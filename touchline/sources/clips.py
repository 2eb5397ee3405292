"""Clips of a recording, the game clock, and the archive's listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels


def plan_clips(clips: DataFrame) -> DataFrame:
    """Clips of each match in name order, each once, with where they start on the game clock.

    Names are compared whole. The window is over a match's clip files, one row each: a recording has a handful, and
    their number doesn't grow with the footage of other matches. Of a file listed twice one listing counts whole: the greatest, column by column.
    """
    own = [c for c in clips.columns if c not in ("match_id", "path")]
    once = clips.groupBy("match_id", "path").agg(F.max(F.struct(*own)).alias("_one")).select("match_id", "path", *(F.col(f"_one.{c}").alias(c) for c in own))
    order = Window.partitionBy("match_id").orderBy(F.regexp_extract("path", r"([^/]*)$", 1), "path")
    to = F.sum("duration_s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return once.select(*clips.columns, (to - F.col("duration_s")).alias("start_s"),
                       F.row_number().over(order).cast("long").alias("clip_no"))


def check_clips(planned: DataFrame) -> DataFrame:
    """The first clip of each match that differs from clip 1, and how."""
    first = planned.where("clip_no = 1").select("match_id", *[F.col(c).alias(f"_{c}") for c in ("codec", "width", "height", "fps", "has_audio")])
    rows = planned.where("clip_no > 1").join(first, "match_id")
    why = F.concat_ws(", ", F.array_compact(F.array(
        F.when(F.col("codec") != F.col("_codec"), F.concat(F.lit("codec "), "codec", F.lit(" vs "), "_codec")),
        F.when((F.col("width") != F.col("_width")) | (F.col("height") != F.col("_height")),
               F.concat(F.lit("frame "), "width", F.lit("x"), "height", F.lit(" vs "), "_width", F.lit("x"), "_height")),
        F.when(F.abs(F.col("fps") - F.col("_fps")) > 0.01, F.concat(
            F.format_string("%.2f", "fps"), F.lit(" fps vs "), F.format_string("%.2f", "_fps"), F.lit(" fps"))),
        F.when(F.col("has_audio") != F.col("_has_audio"), F.lit("one has audio and the other does not")))))
    bad = rows.withColumn("why", why).where(F.col("why") != "")
    worst = bad.groupBy("match_id").agg(F.min_by(F.struct("clip_no", "why"), "clip_no").alias("w"))
    return worst.select("match_id", F.concat(F.lit("clip "), F.col("w.clip_no").cast("string"),
                                             F.lit(" does not match clip 1 ("), F.col("w.why"), F.lit(")")).alias("problem"))


def game_time(points: DataFrame, planned: DataFrame, marks: DataFrame, t: str = "time_s", video: str = "video") -> DataFrame:
    """Game clock and half of times measured on a clip (or on the whole recording, ``video`` = "game")."""
    c = planned.select("match_id", F.col("path").alias(video), F.col("start_s").alias("_off"))
    rows = points.join(c, ["match_id", video], "left").join(marks.select("match_id", "start_s", "half_s", "end_s"), "match_id", "left")
    at = F.when(F.col(video) == "game", F.col(t)).otherwise(F.col(t) + F.col("_off"))
    rows = rows.withColumn("game_s", at)
    half = labels.half_of(F.col("game_s"), F.col("start_s"), F.col("half_s"), F.col("end_s"))
    return rows.withColumn("half", half.cast("long")).select(
        *points.columns, "game_s", "half", labels.half_label(F.col("half")).alias("half_label"))


def half_window(marks: DataFrame) -> DataFrame:
    """Start and end of the whole game and of each half, for marked matches."""
    ok = marks.where(F.col("start_s").isNotNull() & F.col("half_s").isNotNull() & F.col("end_s").isNotNull())
    parts = F.array(*[F.struct(F.lit(n).alias("window"), F.col(a).alias("from_s"), F.col(b).alias("to_s")) for n, a, b in (
        ("Whole game", "start_s", "end_s"), ("First half", "start_s", "half_s"), ("Second half", "half_s", "end_s"))])
    return ok.select("match_id", F.explode(parts).alias("w")).select("match_id", "w.*")


def match_summaries(matches: DataFrame, segments: DataFrame, calibrations: DataFrame, reports: DataFrame, events: DataFrame,
                    reels: DataFrame) -> DataFrame:
    """One row per match: segments, calibration and report present, events and highlights counted."""
    def count(df, name):
        return df.groupBy("match_id").agg(F.count(F.lit(1)).alias(name))

    out = matches.select("match_id")
    for df, name in ((segments, "segments"), (calibrations, "_cal"), (reports, "_rep"), (events, "n_events"), (reels, "n_highlights")):
        out = out.join(count(df, name), "match_id", "left")
    out = out.na.fill(0)
    return out.select("match_id", "segments", (F.col("_cal") > 0).alias("has_calibration"), (F.col("_rep") > 0).alias("has_report"),
                      "n_events", "n_highlights")


def listed_matches(matches: DataFrame, segments: DataFrame, calibrations: DataFrame, replays: DataFrame, teams: DataFrame) -> DataFrame:
    """``ready_matches`` with what a listing shows of those that can be shown: ``team_names``, ``team_colors`` (of teams 0 and 1,
    each an RGB triple or null), ``frame_count`` and ``fps``.

    ``matches`` also has ``team_names``; ``segments`` ``frame_count, fps`` (of several windows those of the first one);
    ``teams`` ``match_id, team, kit_r, kit_g, kit_b`` of the reports, where there are any.
    """
    triple = F.when(F.col("kit_r").isNotNull(), F.array("kit_r", "kit_g", "kit_b"))
    colors = teams.where(F.col("team").isin(0, 1)).groupBy("match_id").agg(F.array(*[F.max(F.when(F.col("team") == k, triple)) for k in (0, 1)]).alias("team_colors"))
    window = segments.groupBy("match_id").agg(F.min_by(F.struct("frame_count", "fps"), F.struct("start_s", "end_s")).alias("_w"))
    rows = ready_matches(matches, segments, calibrations, replays).join(matches.select("match_id", "team_names"), "match_id").join(
        colors, "match_id", "left").join(window, "match_id", "left")
    none = F.array(F.lit(None), F.lit(None)).cast("array<array<int>>")
    shown = {"team_names": F.col("team_names"), "team_colors": F.coalesce(F.col("team_colors").cast("array<array<int>>"), none),
             "frame_count": F.col("_w.frame_count"), "fps": F.col("_w.fps")}
    return rows.select("match_id", "streamable", "reason", "start_s", "end_s", *(F.when(F.col("streamable"), c).alias(n) for n, c in shown.items()))


def ready_matches(matches: DataFrame, segments: DataFrame, calibrations: DataFrame, replays: DataFrame) -> DataFrame:
    """Which matches can be shown, and why not the others. ``segments``: one usable window per match or none."""
    def has(df, name):
        return df.select("match_id").distinct().withColumn(name, F.lit(True))

    rows = matches.select("match_id", "listed_segments").join(has(calibrations, "_c"), "match_id", "left").join(
        has(replays, "_r"), "match_id", "left").join(
        segments.groupBy("match_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")), "match_id", "left")
    reason = (F.when((F.col("listed_segments") == 0) | F.col("_c").isNull() | F.col("_r").isNull(), "no calibration or replay yet")
              .when(F.col("start_s").isNull(), "segment not found"))
    ok = reason.isNull()
    return rows.select("match_id", ok.alias("streamable"), reason.alias("reason"),
                       F.when(ok, F.col("start_s")).alias("start_s"), F.when(ok, F.col("end_s")).alias("end_s"))
