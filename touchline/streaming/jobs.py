"""Live momentum, play spells and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.events import reconcile
from ..operators.metrics import POSSESSION_RADIUS_M
from ..session import cut
from ..sources.reports import with_event_defaults
from .ordered import ORIGIN_MS


def _stamped(stream: DataFrame, delay: str) -> DataFrame:
    ms = F.round(F.col("t") * 1000).cast("long") + ORIGIN_MS
    return stream.withColumn("ts", F.timestamp_millis(ms)).withWatermark("ts", delay)


def momentum_stream(stream: DataFrame, delay: str = "10 seconds", bucket: str = "60 seconds",
                    radius: float = POSSESSION_RADIUS_M) -> DataFrame:
    """Momentum per event-time bucket from observations that carry their frame's aim (``aim_x, aim_y``).

    Two chained windowed aggregates: the nearest labeled player per frame, then wins per bucket. Rows later than the
    watermark are dropped.
    """
    rows = _stamped(stream, delay).where(F.col("aim_x").isNotNull() & F.col("aim_y").isNotNull())
    d = F.hypot(F.col("x") - F.col("aim_x"), F.col("y") - F.col("aim_y"))
    best = F.min(F.when(F.col("team") >= 0, F.struct(d.alias("d"), F.col("det_id").alias("o"), F.col("team").alias("team"))))
    frames = rows.groupBy("match_id", "frame", F.window("ts", bucket)).agg(F.first("aim_x").alias("aim_x"), best.alias("best"))
    hit = F.coalesce(F.col("best.d") <= radius, F.lit(False))
    out = frames.groupBy("match_id", "window").agg(
        F.count(F.when(hit & (F.col("best.team") == 0), 1)).alias("w0"),
        F.count(F.when(hit & (F.col("best.team") == 1), 1)).alias("w1"),
        F.count(F.when(~hit, 1)).alias("uncontested_frames"), F.avg("aim_x").alias("x"))
    total = F.col("w0") + F.col("w1")
    share = F.col("w0") / F.nullif(total, F.lit(0))
    length = F.col("window.end").cast("double") - F.col("window.start").cast("double")
    return out.where(total > 0).select(
        "match_id", F.floor((F.col("window.start").cast("double") - ORIGIN_MS / 1000) / length).cast("long").alias("minute"),
        F.bround(share, 3).alias("team_0"), F.bround(1.0 - share, 3).alias("team_1"), F.bround("x", 1).alias("action_x"),
        total.alias("contested_frames"), "uncontested_frames")


def play_sessions(stream: DataFrame, fps: float, delay: str = "10 seconds", min_frames: int = 5) -> DataFrame:
    """Spells of live play: locked frames without a hole, at least ``min_frames`` long."""
    rows = _stamped(stream, delay).where("locked")
    gap = f"{int(1500 / fps)} milliseconds"
    out = rows.groupBy("match_id", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"))
    return out.where(F.col("frames") >= min_frames).select("match_id", "start_frame", "frames", "end_frame")


def reconcile_batches(log_path: str, source: str | None = None):
    """A ``foreachBatch`` function that brings a review log (parquet by match) in line with fresh scans.

    A micro-batch holds whole scans of its matches. A scan that found nothing is a row without ``time_s``: it empties
    the match of outdated rows. Running a batch again changes nothing, so a restart is safe; only the matches in the
    batch are rewritten. A match whose rows all go keeps its folder with no row of it.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scans = cut(batch)
        fresh = scans.where(F.col("time_s").isNotNull())
        touched = scans.select("match_id").distinct()
        log = with_event_defaults(spark.read.parquet(log_path)).join(touched, "match_id", "left_semi").select(*fresh.columns)
        kept = cut(reconcile(log, fresh, source)[0])
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(log_path)

    return run
