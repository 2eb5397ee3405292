"""Speed, distance, momentum, possession, roles and sides from labeled player observations.

``obs`` rows: ``match_id, track_id, team, frame, t, x, y, sigma_m`` (one row per track and frame). Nearest-player
choices are ``min(struct)`` aggregates, so frames combine before the shuffle and no frame is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..session import cut
from .blocks import clip, exact_percentiles, halo, rated

# Fixed values of the measurement rules
MAX_GAP_S = 1.0
MAX_SPEED_KMH = 36.0
MIN_OBS = 8
POSSESSION_RADIUS_M = 12.0
KEEPER_ZONE_M, KEEPER_SHARE, KEEPER_MIN_OBS = 12.0, 0.9, 60
REF_MIN_OBS, REF_SPAN_M = 150, 18.0
TRACK = ("match_id", "track_id")


def on_pitch(df: DataFrame, length: float, width: float, margin: float = 1.5) -> DataFrame:
    slack = F.lit(margin) + F.coalesce(F.least("sigma_m", F.lit(4.0)), F.lit(0.0))
    return df.where(F.col("x").between(-slack, length + slack) & F.col("y").between(-slack, width + slack))


def sampling_rate(df: DataFrame, keys=("match_id",), t: str = "t", block_s: float = 600.0) -> DataFrame:
    """One ``rate`` per key: 1 / median step between distinct times; 5 when it cannot be told."""
    from .blocks import prefix
    times = df.select(*keys, t).where(F.col(t).isNotNull()).distinct()
    steps = prefix(times, keys, [t], block_s, lags={"_before": F.col(t)})
    middle = exact_percentiles(steps, keys, F.col(t) - F.col("_before"), {"_dt": 0.5})
    known = times.select(*keys).distinct().join(middle, list(keys), "left")
    rate = F.when(F.col("_dt") > 1e-6, 1.0 / F.col("_dt")).otherwise(F.lit(5.0))
    return known.select(*keys, rate.alias("rate"))


def speeds(obs: DataFrame, block_s: float = 600.0) -> DataFrame:
    """Add ``step_m``, ``seen`` (gap short enough to count) and ``speed_kmh`` per observation."""
    rows = halo(obs, "t", block_s, back=MAX_GAP_S, ahead=0.0)
    w = Window.partitionBy(*TRACK, "_blk").orderBy("t", "frame")
    px, py, pt, ps = (F.lag(c).over(w) for c in ("x", "y", "t", "sigma_m"))
    rows = rows.withColumns({
        "_step": F.hypot(F.col("x") - px, F.col("y") - py), "_gap": F.col("t") - pt,
        "_noise": F.hypot(ps, F.col("sigma_m"))}).where("_own")
    moved = (F.col("_gap") <= MAX_GAP_S) & (F.col("_step") > F.greatest(F.lit(0.35), F.col("_noise")))
    speed = F.when(moved, clip(F.col("_step") / F.greatest(F.col("_gap"), F.lit(1e-3)) * 3.6, 0.0, MAX_SPEED_KMH))
    return rows.select(*obs.columns, F.when(F.col("_gap") <= MAX_GAP_S, F.col("_step")).alias("step_m"),
                       F.coalesce(speed, F.lit(0.0)).alias("speed_kmh"))


def build_tracks(fast: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """One row per track seen often enough: counts, distance, extremes and sums that later steps add up."""
    moving = F.col("speed_kmh") > 0.5
    return fast.groupBy(*TRACK).agg(
        F.first("team").alias("team"),
        F.count(F.lit(1)).alias("observations"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.coalesce(F.sum(F.when(F.col("speed_kmh") > 0, F.col("step_m"))), F.lit(0.0)).alias("distance_m"),
        F.max("speed_kmh").alias("top_speed_kmh"),
        F.sum(F.when(moving, F.col("speed_kmh"))).alias("moving_sum"),
        F.count(F.when(moving, 1)).alias("moving_n"),
        F.count(F.when(F.col("speed_kmh") > 1.0, 1)).alias("walking_n"),
        F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
        F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    ).where(F.col("observations") >= min_obs)


def nearest_to_aim(obs: DataFrame, aim: DataFrame) -> DataFrame:
    """Per frame with an aim point: its bucketable time, aim and the nearest labeled player (first on ties)."""
    near = obs.join(aim.where(F.col("aim_x").isNotNull() & F.col("aim_y").isNotNull()), ["match_id", "frame"])
    distance = F.hypot(F.col("x") - F.col("aim_x"), F.col("y") - F.col("aim_y"))
    order = "det_id" if "det_id" in obs.columns else "track_id"
    best = F.min(F.when(F.col("team") >= 0, F.struct(distance.alias("d"), F.col(order).alias("o"), "team")))
    return near.groupBy("match_id", "frame").agg(
        F.min_by("t", order).alias("t"), F.first("aim_x").alias("aim_x"), best.alias("best"))


def momentum(obs: DataFrame, aim: DataFrame, bucket_s: float = 60.0, radius: float = POSSESSION_RADIUS_M) -> DataFrame:
    """Share of contested frames won per team and time bucket, with where the action was."""
    frames = nearest_to_aim(obs, aim).withColumn("minute", F.floor(F.col("t") / bucket_s).cast("long"))
    return momentum_of(frames, radius)


def momentum_of(frames: DataFrame, radius: float = POSSESSION_RADIUS_M) -> DataFrame:
    hit = F.coalesce(F.col("best.d") <= radius, F.lit(False))
    won = [F.count(F.when(hit & (F.col("best.team") == k), 1)) for k in (0, 1)]
    out = frames.groupBy("match_id", "minute").agg(
        won[0].alias("_w0"), won[1].alias("_w1"),
        F.count(F.when(~hit, 1)).alias("uncontested_frames"), F.avg("aim_x").alias("_x"))
    total = F.col("_w0") + F.col("_w1")
    share = F.col("_w0") / F.nullif(total, F.lit(0))
    return out.where(total > 0).select(
        "match_id", "minute", F.bround(share, 3).alias("team_0"), F.bround(1.0 - share, 3).alias("team_1"),
        F.bround("_x", 1).alias("action_x"), total.alias("contested_frames"), "uncontested_frames")


def team_metrics(tracks: DataFrame, moments: DataFrame, length: float) -> DataFrame:
    """Per match and team: players, distance, speeds, territory, possession (unweighted mean of bucket shares)."""
    teams = tracks.where(F.col("team").isin(0, 1)).groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("players_observed"), F.bround(F.sum("distance_m"), 1).alias("distance_m"),
        F.max("top_speed_kmh").alias("_top"), F.sum("moving_sum").alias("_ms"), F.sum("moving_n").alias("_mn"),
        (F.sum("sum_x") / F.sum("observations") / length).alias("_x"))
    share = moments.groupBy("match_id").agg(F.avg("team_0").alias("_share"))
    poss = F.when(F.col("team") == 0, F.coalesce("_share", F.lit(0.0))).otherwise(
        F.coalesce(1.0 - F.col("_share"), F.lit(0.0)))
    return teams.join(share, "match_id", "left").select(
        "match_id", F.col("team").cast("long").alias("team"), "players_observed", "distance_m",
        F.bround(F.when(F.col("_mn") > 0, F.col("_top")).otherwise(0.0), 1).alias("top_speed_kmh"),
        F.bround(F.coalesce(F.col("_ms") / F.nullif("_mn", F.lit(0)), F.lit(0.0)), 1).alias("mean_speed_kmh"),
        F.bround("_x", 3).alias("mean_x_fraction"), F.bround(poss, 3).alias("possession_share"))


def is_bystander() -> Column:
    """Over :func:`build_tracks` rows: lived long enough and never really moved."""
    extent = F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    lived = (F.col("observations") >= 2) & (F.col("last_t") - F.col("first_t") >= 10.0)
    still = F.col("walking_n") / F.col("observations") < 0.05
    return lived & ((extent < 8.0) | ((extent < 15.0) & still))


def bystanders(tracks: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    found = tracks.where(is_bystander())
    return found if roles is None else found.join(roles, list(TRACK), "left_anti")


def classify_roles(obs: DataFrame, length: float, evidence: DataFrame | None = None) -> DataFrame:
    """Goalkeepers (deep nearly always) and at most one referee per match (longest unlabeled wide-ranging track)."""
    stats = obs.groupBy(*TRACK).agg(
        F.first("team").alias("team"), F.count(F.lit(1)).alias("n"),
        F.avg((F.col("x") < KEEPER_ZONE_M).cast("double")).alias("left"),
        F.avg((F.col("x") > length - KEEPER_ZONE_M).cast("double")).alias("right"))
    keeper = (F.col("n") >= KEEPER_MIN_OBS) & (F.greatest("left", "right") >= KEEPER_SHARE)
    keepers = stats.where(keeper).select(
        *TRACK, F.lit("goalkeeper").alias("role"),
        F.when(F.col("left") >= F.col("right"), "left").otherwise("right").alias("side"))
    able = cut(stats.where(~keeper & (F.col("n") >= REF_MIN_OBS) & (F.col("team") == -1)).select(*TRACK, "n"))
    if evidence is not None:
        able = able.join(evidence.select(*TRACK), list(TRACK), "left_semi")
    spread = exact_percentiles(obs.join(able.select(*TRACK), list(TRACK), "left_semi"), TRACK, F.col("x"),
                               {"lo": 0.05, "hi": 0.95})
    wide = able.join(spread, list(TRACK)).where(F.col("hi") - F.col("lo") >= REF_SPAN_M)
    best = wide.groupBy("match_id").agg(F.max(F.struct("n", (-F.col("track_id")).alias("k"))).alias("b"))
    referee = best.select("match_id", (-F.col("b.k")).alias("track_id"), F.lit("referee").alias("role"),
                          F.lit(None).cast("string").alias("side"))
    return keepers.unionByName(referee)


def orientations(obs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Per match and period: mean x per team, who defends the left goal, attack directions.

    Periods are half-open. Without usable marks a match is one period, half 0.
    """
    rows = obs.where(F.col("team").isin(0, 1))
    if marks is not None:
        m = marks.select("match_id", "start_s", "half_s", "end_s")
        rows = rows.join(m, "match_id", "left")
        usable = F.col("start_s").isNotNull() & F.col("half_s").isNotNull() & F.col("end_s").isNotNull()
        half = (F.when(~usable, 0).when((F.col("t") >= F.col("start_s")) & (F.col("t") < F.col("half_s")), 1)
                .when((F.col("t") >= F.col("half_s")) & (F.col("t") < F.col("end_s")), 2))
    else:
        half = F.lit(0)
    means = rows.withColumn("half", half.cast("long")).where(F.col("half").isNotNull()).groupBy("match_id", "half").agg(
        F.avg(F.when(F.col("team") == 0, F.col("x"))).alias("mean_x_0"),
        F.avg(F.when(F.col("team") == 1, F.col("x"))).alias("mean_x_1"))
    both = F.col("mean_x_0").isNotNull() & F.col("mean_x_1").isNotNull()
    first_left = F.col("mean_x_0") <= F.col("mean_x_1")
    return means.select(
        "match_id", "half", "mean_x_0", "mean_x_1",
        F.when(both, F.when(first_left, 1).otherwise(-1)).cast("long").alias("attack_0"),
        F.when(both, F.when(first_left, -1).otherwise(1)).cast("long").alias("attack_1"))


def touches(obs: DataFrame, aim: DataFrame, radius: float = POSSESSION_RADIUS_M) -> DataFrame:
    """Frames each field player was nearest the (rounded) aim point; the later track wins a tie."""
    shown = aim.where(F.col("aim_x").isNotNull() & F.col("aim_y").isNotNull()).select(
        "match_id", "frame", F.bround("aim_x", 1).alias("ax"), F.bround("aim_y", 1).alias("ay"))
    distance = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))
    near = obs.join(shown, ["match_id", "frame"]).withColumn("_d", distance).where(F.col("_d") <= radius)
    best = near.groupBy("match_id", "frame").agg(F.min(F.struct("_d", (-F.col("track_id")).alias("k"))).alias("b"))
    return best.groupBy("match_id", (-F.col("b.k")).alias("track_id")).agg(F.count(F.lit(1)).alias("touches"))


def player_stats(fast: DataFrame, aim: DataFrame, fps: float | DataFrame, roles: DataFrame | None = None,
                 tracks: DataFrame | None = None) -> DataFrame:
    """Per field player (bystanders out): the replay's numbers, rounded to a tenth. ``tracks``: of ``build_tracks``, where known."""
    tracks = build_tracks(fast) if tracks is None else tracks
    field = rated(tracks.join(bystanders(tracks, roles).select(*TRACK), list(TRACK), "left_anti"), fps)
    hits = touches(fast.join(field.select(*TRACK), list(TRACK), "left_semi"), aim)

    def tenth(c):
        return F.bround(c, 1)

    n = F.col("observations")
    return field.join(hits, list(TRACK), "left").select(
        *TRACK, F.col("team").cast("long").alias("team"), "observations", tenth(n / F.col("rate")).alias("time_s"),
        tenth("first_t").alias("first_t"), tenth("last_t").alias("last_t"), tenth("distance_m").alias("distance_m"),
        tenth("top_speed_kmh").alias("top_speed_kmh"),
        tenth(F.coalesce(F.col("moving_sum") / F.nullif("moving_n", F.lit(0)), F.lit(0.0))).alias("mean_speed_kmh"),
        tenth(F.col("sum_x") / n).alias("mean_x"), tenth(F.col("sum_y") / n).alias("mean_y"),
        F.coalesce("touches", F.lit(0)).cast("long").alias("touches"))


def player_table(stats: DataFrame, numbers: DataFrame, names: DataFrame) -> DataFrame:
    """Player stats with team label, number and name, longest seen first. ``names``: ``match_id, team, name``."""
    n = numbers.select(*TRACK, "number", "name", "source")
    given = names.select("match_id", "team", F.col("name").alias("_given"))
    rows = stats.join(n, list(TRACK), "left").join(given, ["match_id", "team"], "left")
    return rows.select(
        *TRACK, labels.team_name(F.col("team"), F.col("_given")).alias("team"), "number",
        F.coalesce("name", F.lit("")).alias("name"), F.coalesce("source", F.lit("unassigned")).alias("source"), "time_s",
        "distance_m", "top_speed_kmh", "mean_speed_kmh", "touches", "mean_x", "mean_y").orderBy(
        "match_id", F.col("time_s").desc(), "track_id")


def momentum_on_window(moments: DataFrame, window_start_s: float) -> DataFrame:
    """Momentum keyed by minutes since the analyzed window's start."""
    return moments.withColumn("minute", F.bround(F.col("minute") - F.lit(float(window_start_s)) / 60.0, 4))


def heat_map(obs: DataFrame, cell_m: float, *by: str) -> DataFrame:
    return obs.groupBy("match_id", *by, F.floor(F.col("x") / cell_m).cast("long").alias("cell_x"),
                       F.floor(F.col("y") / cell_m).cast("long").alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))


def attack_summary(sides: DataFrame) -> DataFrame:
    """Directions per half in half order, one row per match (two halves at most)."""
    pair = F.struct("half", F.when(F.col("attack_0").isNotNull(), F.array("attack_0", "attack_1")).alias("d"))
    return sides.groupBy("match_id").agg(F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["d"])
                                         .alias("directions"))
