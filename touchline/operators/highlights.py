"""Scored moments and the reels picked from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Fold, fold_sorted
from .events import verdict

# Seconds per tier, weights
TIERS = {"clip": 24.0, "goals": 90.0, "match": 300.0}
LEAD_S, TAIL_S, MIN_GAP_S, MIN_CLIP_S, MAX_CLIP_S = 4.0, 6.0, 20.0, 15.0, 30.0


def _window(t: Column) -> dict[str, Column]:
    return {"start_s": F.greatest(F.lit(0.0), t - LEAD_S), "end_s": t + TAIL_S}


def build_moments(log: DataFrame, momentum: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """Moments with weights from events ``(match_id, event_id, time_s, type, source, verdict, ...)`` and momentum swings.

    ``ord`` is the input order that decides between equal weights.
    """
    kind = F.col("type")
    factor = (F.when(kind == "goal", 3.0).when(kind == "penalty", 2.5).when(kind.isin("shot", "save", "block"), 1.6)
              .when(kind == "corner", 1.3).when(kind.isin("clearance", "tackle"), 1.2).otherwise(1.0))
    note = F.when(F.col("note") != "", F.concat(F.lit(": "), F.col("note"))).otherwise("")
    source = F.coalesce(F.col("source"), F.lit("manual"))
    events = log.where(verdict() != "false").select(
        "match_id", "time_s", *[c.alias(n) for n, c in _window(F.col("time_s")).items()],
        (F.when(source == "manual", 10.0).otherwise(1.0) * factor).alias("weight"),
        F.concat(kind, F.lit(" ("), source, F.lit(")"), note).alias("reason"), kind.alias("event_type"),
        F.col("team").cast("long").alias("team"), "video",
        F.struct(F.lit(0).alias("k"), F.col("time_s").alias("t"), F.col("event_id").cast("long").alias("i")).alias("ord"))
    out = events
    if momentum is not None:
        swing = F.abs(F.col("team_0") - 0.5)
        center = F.col("minute") * 60.0 + 30.0
        m = momentum.where(swing >= 0.25).withColumns({"time_s": center, "_swing": swing})
        out = out.unionByName(m.select(
            "match_id", "time_s", *[c.alias(n) for n, c in _window(F.col("time_s")).items()],
            (F.col("_swing") * 8.0).alias("weight"),
            F.concat(F.lit("momentum swing ("), F.bround(F.col("team_0") * 100, 0).cast("long").cast("string"),
                     F.lit("% action share)")).alias("reason"), F.lit("other").alias("event_type"),
            F.lit(-1).cast("long").alias("team"), F.lit("").alias("video"),
            F.struct(F.lit(1).alias("k"), F.col("time_s").alias("t"), F.col("minute").cast("long").alias("i")).alias("ord")))
    if durations is not None:
        out = out.join(durations.select("match_id", "duration_s"), "match_id", "left")
        out = out.where(F.col("duration_s").isNull() | (F.col("start_s") < F.col("duration_s"))).drop("duration_s")
    return out


def clamp_moment(moments: DataFrame, duration: Column) -> DataFrame:
    """Trim to the recording; windows outside it or shorter than 0.05 s are dropped."""
    lo, hi = F.greatest(F.lit(0.0), F.col("start_s")), F.least(duration, F.col("end_s"))
    ok = (duration > 0) & (F.col("start_s") < duration) & (F.col("end_s") > 0) & (hi - lo >= 0.05)
    return moments.where(ok).withColumns({"start_s": lo, "end_s": hi})


def moment_on_source(moments: DataFrame, source: str, clips: DataFrame) -> DataFrame:
    """Clip window on the combined recording for moments found on a clip with a known offset."""
    c = clips.select("match_id", F.col("path").alias("video"), F.col("start_s").alias("_off"))
    rows = moments.join(c, ["match_id", "video"], "left")
    off = F.when((F.col("video") != "") & (F.col("video") != source), F.col("_off"))
    return rows.withColumns({
        "clip_start_s":
        F.when(off.isNotNull(), F.greatest(F.lit(0.0), F.col("start_s") + off)),
        "clip_end_s": F.col("end_s") + off}).drop("_off")


def select_reels(moments: DataFrame, tiers: dict[str, float] = TIERS, min_gap_s: float = MIN_GAP_S) -> DataFrame:
    """Moments of each tier's reel: by weight, skipping what would pass the budget or sits near a chosen moment.

    One shuffle brings a match's moments of a tier together in order of weight, where they are walked with the chosen
    times as state; a moment lasts at least 15 s, so the budget bounds them.
    """
    parts = []
    strong = moments.groupBy("match_id").agg(F.max(F.col("event_type").isin("goal", "penalty")).alias("_strong"))
    length = F.greatest(F.lit(MIN_CLIP_S), F.col("end_s") - F.col("start_s"))
    for tier in tiers:
        rows = moments
        if tier == "goals":
            rows = moments.join(strong, "match_id").where(
                F.when(F.col("_strong"), F.col("event_type").isin("goal", "penalty"))
                .otherwise(F.col("event_type").isin("shot", "save", "block"))).drop("_strong")
        parts.append(rows.withColumns({
            "tier": F.lit(tier), "budget": F.lit(tiers[tier]),
            "length": F.least(F.lit(MAX_CLIP_S), length) if tier == "clip" else length}))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    ranked = rows.withColumn("_down", -F.col("weight"))
    chosen = fold_sorted(ranked, ["match_id", "tier"], ["_down", "ord"], lambda key: _Reel(min_gap_s), ranked.schema)
    return chosen.drop("budget", "ord", "_down")


class _Reel(Fold):
    """A reel's moments by weight: one that would pass the budget or is near a chosen moment is skipped."""

    def __init__(self, gap: float):
        self.gap, self.used, self.times = gap, 0.0, []

    def step(self, row):
        first = not self.times
        fits = first or (self.used < row.budget and self.used + row.length <= row.budget)
        if not fits or any(abs(row.time_s - t) < self.gap for t in self.times):
            return ()
        self.used += row.length
        self.times.append(row.time_s)
        return (tuple(row),)


def reel_manifest(reels: DataFrame) -> DataFrame:
    """Reels as written out: times and weight to two decimals."""
    return reels.select("match_id", "tier", *[F.bround(c, 2).alias(c) for c in ("time_s", "start_s", "end_s", "weight")],
                        "reason", "event_type", "team", "video")


MANIFEST = ("match_id long, tier string, time_s double, start_s double, end_s double, weight double, reason string, "
            "event_type string, team long, video string")


def write_reels(reels: DataFrame, path: str) -> None:
    """The manifest as JSON, a folder for each match; a match's folder is replaced whole, other matches' stay."""
    reel_manifest(reels).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").json(path)


def read_reels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)
