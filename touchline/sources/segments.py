"""Recorded segments: chunked frame and detection tables, and the ball scan's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import prefix

KEY = ["match_id", "segment_id"]


def leading_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks up to the first hole, with the number of frames before each (``first_frame``).

    ``chunks``: ``match_id, segment_id, chunk, n_frames``.
    """
    rows = prefix(chunks, KEY, ["chunk"], sums={"_place": F.lit(1), "_to": F.col("n_frames")})
    return rows.where(F.col("_place") - 1 == F.col("chunk")).select(
        *chunks.columns, (F.col("_to") - F.col("n_frames")).alias("first_frame"))


def assemble(chunks: DataFrame, frames: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames and detections of the readable chunks on the segment's own frame count.

    ``frames`` and ``detections`` carry ``chunk`` and chunk-local ``frame``; older detections lack ``det_track``.
    """
    lead = leading_chunks(chunks).select(*KEY, "chunk", "first_frame")
    if "det_track" not in detections.columns:
        detections = detections.withColumn("det_track", F.lit(None).cast("int"))

    def moved(df):
        at = (F.col("frame") + F.col("first_frame")).alias("frame")
        return df.join(lead, [*KEY, "chunk"]).select(*[at if c == "frame" else F.col(c) for c in df.columns if c != "chunk"])

    return moved(frames), moved(detections.withColumn("det_track", F.when(F.col("det_track") >= 0, F.col("det_track"))))


def read_segment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read ``chunks``, ``frames`` and ``detections`` tables under ``path``; columns may differ between chunk versions."""
    def table(name):
        return spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}")

    return assemble(table("chunks"), table("frames"), table("detections"))


BALL_DOCUMENT = ("match_id long, frames array<struct<i:bigint,t:double,status:string,u:double,v:double,conf:double,"
                 "vx:double,vy:double>>")


def read_ball_track(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame from ball-scan documents (one per segment)."""
    docs = spark.read.schema(BALL_DOCUMENT).option("multiLine", "true").json(path)
    return docs.select("match_id", F.explode("frames").alias("f")).select(
        "match_id", F.col("f.i").alias("frame"), "f.t", "f.status", "f.u", "f.v", "f.conf", "f.vx", "f.vy")


def nulls_for_unknown(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinity become NULL; a track id of -1 becomes NULL."""
    def clean(c):
        if c == "det_track":
            return F.when(F.col(c) >= 0, F.col(c))
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))

    return df.withColumns({c: clean(c) for c in columns})
