"""Match events from the ball and the player tracks, and the review log they are merged into.

Detectors are filters over :func:`touchline.operators.ball.frame_facts` and its resting spells, plus one nearest-player
join on a handful of frames. Sequential rules (dedupe, self spacing) are cut at silences longer than their reach and
folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..session import cut
from . import ball as B
from .blocks import BLOCK, Fold, exact_percentiles, fold_sorted, gap_pieces, halo
from .joins import first_in_window, nearest_player, neighbors, within

# Fixed values of the event rules
ATTRIBUTION_M, CORNER_M, SPOT_M, SPOT_DIST_M, SHOT_RANGE_M, SHOT_TRAVEL_M = 9.0, 7.0, 3.5, 11.0, 35.0, 12.0
THIRD, CLEAR_TRAVEL_M = 0.35, 20.0
TACKLE_M, TACKLE_STOP, TACKLE_MOVE, TACKLE_S, TACKLE_CHANGE = 2.0, 2.0, 12.0, 1.5, 10.0
EVENT_GAP_S, DUPLICATE_S = 3.0, 1.0
EVENT_COLUMNS = ("match_id", "frame", "time_s", "type", "team", "note", "source", "confidence", "player_track")


def lag_frames(motion: DataFrame) -> DataFrame:
    """Per match: 0.4 s in frames, from the median frame spacing."""
    rows = halo(motion.select("match_id", "frame", "t"), "frame", BLOCK, back=1, ahead=0)
    before = F.lag("t").over(Window.partitionBy("match_id", "_blk").orderBy("frame"))
    steps = rows.withColumn("_pt", before).where("_own")
    dt = exact_percentiles(steps, ["match_id"], F.col("t") - F.col("_pt"), {"_dt": 0.5})
    known = motion.select("match_id").distinct().join(dt, "match_id", "left")
    rate = F.when(F.col("_dt") > 1e-6, 1.0 / F.col("_dt")).otherwise(5.0)
    lag = F.when(F.col("_dt").isNull(), 2).otherwise(F.greatest(F.lit(1), F.bround(rate * 0.4, 0).cast("int")))
    return known.select("match_id", lag.alias("lag"))


def _nearest(cands: DataFrame, obs: DataFrame) -> DataFrame:
    """Give each candidate (``type``, ``frame``, ``time_s``, ``at`` frame, ``px``, ``py``, ``lag``) its player. All kinds may come
    together, so that the observations are dealt out by frame once."""
    points = cands.withColumnRenamed("frame", "event_frame").withColumnRenamed("at", "frame")
    return nearest_player(points, obs, ["type", "event_frame"], ATTRIBUTION_M)


def _attributed(found: DataFrame) -> DataFrame:
    return found.select(
        "match_id", F.col("event_frame").cast("long").alias("frame"), "time_s", "type",
        F.coalesce("player_team", F.lit(-1)).cast("long").alias("team"), "note", F.lit("ball").alias("source"), "confidence",
        F.col("player_track").cast("long").alias("player_track"))


def _candidates(cands: DataFrame, kind: str, confidence: float, note: Column, *more: str) -> DataFrame:
    return cands.select("match_id", "frame", "time_s", "at", "px", "py", "lag", F.lit(kind).alias("type"),
                        F.lit(confidence).alias("confidence"), note.alias("note"), *more)


def detect_goals(facts: DataFrame, obs: DataFrame, lags: DataFrame, length: float, width: float) -> DataFrame:
    return _attributed(_nearest(goal_candidates(facts, lags, length, width), obs))


def goal_candidates(facts: DataFrame, lags: DataFrame, length: float, width: float) -> DataFrame:
    hits = B.goal_mouth_hits(facts, length, width)
    resets = facts.where("reset").select("match_id", "t")
    after = neighbors(hits.select("match_id", "frame", "t", "x", "y", "speed", "side"), resets, ["match_id"], "t",
                      reach=B.RESET_WINDOW_S)
    goals = after.where(F.col("next.t") <= F.col("t") + B.RESET_WINDOW_S).join(lags, "match_id")
    cands = goals.select("match_id", "frame", F.col("t").alias("time_s"), F.col("frame").alias("at"),
                         F.col("x").alias("px"), F.col("y").alias("py"), "lag", "speed", "side",
                         (F.col("next.t") - F.col("t")).alias("wait"))
    note = F.concat(F.lit("ball crossed the "), F.when(F.col("side") == 0, "left").otherwise("right"),
                    F.lit(" goal line at "), labels.whole(F.col("speed")),
                    F.lit(" m/s and was reset to the center spot "), labels.whole(F.col("wait")), F.lit("s later"))
    return _candidates(cands, "goal", 0.8, note)


def _nearest_place(places: list[tuple[float, float]]) -> Column:
    return F.least(*[F.hypot(F.col("x") - px, F.col("y") - py) for px, py in places])


def detect_corners(spells: DataFrame, obs: DataFrame, lags: DataFrame, length: float, width: float) -> DataFrame:
    return _attributed(_nearest(corner_candidates(spells, lags, length, width), obs))


def corner_candidates(spells: DataFrame, lags: DataFrame, length: float, width: float) -> DataFrame:
    flags = [(0.0, 0.0), (0.0, width), (length, 0.0), (length, width)]
    near = spells.where(_nearest_place(flags) <= CORNER_M).where(F.col("kick_after_3").isNotNull())
    cands = near.join(lags, "match_id").select(
        "match_id", F.col("kick_after_3.frame").alias("frame"), F.col("kick_after_3.t").alias("time_s"),
        F.col("kick_after_3.frame").alias("at"), F.col("kick_after_3.x").alias("px"),
        F.col("kick_after_3.y").alias("py"), "lag", F.col("kick_after_3.speed").alias("speed"), "x", "y", "start_frame")
    note = F.concat(F.lit("ball was still at the corner ("), labels.whole(F.col("x")), F.lit(", "),
                    labels.whole(F.col("y")), F.lit(") then kicked at "), labels.whole(F.col("speed")), F.lit(" m/s"))
    return _candidates(cands, "corner", 0.6, note)


def detect_penalties(spells: DataFrame, whistles: DataFrame, obs: DataFrame, lags: DataFrame, length: float,
                     width: float) -> DataFrame:
    """``whistles``: ``match_id, time_s``."""
    return _attributed(_nearest(penalty_candidates(spells, whistles, lags, length, width), obs))


def penalty_candidates(spells: DataFrame, whistles: DataFrame, lags: DataFrame, length: float, width: float) -> DataFrame:
    spots = [(SPOT_DIST_M, width / 2.0), (length - SPOT_DIST_M, width / 2.0)]
    near = spells.where(_nearest_place(spots) <= SPOT_M).where(F.col("kick_after_5").isNotNull())
    heard = first_in_window(near, whistles, ["match_id"], "start_t", 20.0, 2.0, "whistle_s", right_t="time_s")
    cands = heard.where(F.col("whistle_s").isNotNull()).join(lags, "match_id").select(
        "match_id", F.col("kick_after_5.frame").alias("frame"), F.col("kick_after_5.t").alias("time_s"),
        F.col("kick_after_5.frame").alias("at"), F.col("kick_after_5.x").alias("px"),
        F.col("kick_after_5.y").alias("py"), "lag", F.col("kick_after_5.speed").alias("speed"), "whistle_s")
    note = F.concat(F.lit("kick from the penalty spot at "), labels.whole(F.col("speed")), F.lit(" m/s, whistle heard at "),
                    F.format_string("%.1f", F.col("whistle_s")), F.lit(" s"))
    return _candidates(cands, "penalty", 0.7, note)


def shot_candidates(facts: DataFrame, length: float, width: float) -> DataFrame:
    ox, oy = F.col("origin.x"), F.col("origin.y")
    goal_x = F.when(F.col("vx") < 0, 0.0).otherwise(length)
    distance = F.abs(goal_x - ox)
    to_line = (goal_x - ox) / F.when(F.abs("vx") >= 1e-6, F.col("vx"))
    aim_y = oy + F.col("vy") * to_line
    lx, ly = F.col("origin.later.x"), F.col("origin.later.y")
    travel = F.hypot(lx - ox, ly - oy)
    return facts.where(B.is_kick(B.SHOT_MS)).where(
        (distance <= SHOT_RANGE_M) & (to_line > 0) & (F.abs(aim_y - width / 2.0) <= 3.66 + 1.5)
        & (travel >= SHOT_TRAVEL_M) & (F.abs(goal_x - lx) < distance)).withColumn("distance", distance)


def detect_shots(facts: DataFrame, already: DataFrame, obs: DataFrame, lags: DataFrame, length: float,
                 width: float) -> DataFrame:
    """``already``: goal and penalty events; shots within 3 s of one are left out."""
    return _attributed(_nearest(free_shots(facts, already, lags, length, width), obs))


def free_shots(facts: DataFrame, already: DataFrame, lags: DataFrame, length: float, width: float) -> DataFrame:
    shots = shot_candidates(facts, length, width).select(
        "match_id", "frame", F.col("t").alias("time_s"), "vx", "speed", "distance", "origin")
    free = within(shots, already.select("match_id", F.bround("time_s", 3).alias("time_s")), ["match_id"], "time_s",
                  EVENT_GAP_S, "_taken").where(~F.col("_taken"))
    cands = free.join(lags, "match_id").select(
        "match_id", "frame", "time_s", F.col("origin.frame").alias("at"), F.col("origin.x").alias("px"),
        F.col("origin.y").alias("py"), "lag", "speed", "vx", "distance")
    note = F.concat(F.lit("ball kicked at "), labels.whole(F.col("speed")), F.lit(" m/s toward the "),
                    F.when(F.col("vx") < 0, "left").otherwise("right"), F.lit(" goal from "),
                    labels.whole(F.col("distance")), F.lit(" m"))
    return _candidates(cands, "shot", 0.6, note)


def orientation_at(points: DataFrame, sides: DataFrame, marks: DataFrame | None, t: str) -> DataFrame:
    """Attach the orientation of the half ``t`` falls in; the match's first orientation where there is none."""
    first = sides.groupBy("match_id").agg(F.min_by(F.struct("attack_0", "attack_1"), "half").alias("_first"))
    if marks is not None:
        m = marks.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull()).select("match_id", "half_s")
        points = points.join(m, "match_id", "left")
        half = F.when(F.col("half_s").isNull(), 0).when(F.col(t) < F.col("half_s"), 1).otherwise(2)
        points = points.withColumn("half", half.cast("long")).drop("half_s")
    else:
        points = points.withColumn("half", F.lit(0).cast("long"))
    here = sides.select("match_id", "half", F.struct("attack_0", "attack_1").alias("_here"))
    out = points.join(here, ["match_id", "half"], "left").join(first, "match_id", "left")
    side = F.coalesce("_here", "_first")
    return out.withColumns({"attack_0": side["attack_0"], "attack_1": side["attack_1"]}).drop(
        "_here", "_first", "half")


def every_half(sides: DataFrame, marks: DataFrame) -> DataFrame:
    """``sides`` with a row for both halves of a marked match: one in which no team was seen has no directions and takes none
    from the other."""
    usable = F.col("start_s").isNotNull() & F.col("half_s").isNotNull() & F.col("end_s").isNotNull()
    halves = marks.where(usable).select("match_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("half")).distinct()
    return sides.join(halves, ["match_id", "half"], "full")


def detect_clearances(facts: DataFrame, obs: DataFrame, sides: DataFrame, lags: DataFrame, length: float,
                      marks: DataFrame | None = None) -> DataFrame:
    return _cleared(_nearest(clearance_candidates(facts, lags), obs), sides, length, marks)


def clearance_candidates(facts: DataFrame, lags: DataFrame) -> DataFrame:
    """Long kicks; whether they leave the own third is known with the player's team (``_cleared``)."""
    travel = F.hypot(F.col("later.x") - F.col("x"), F.col("later.y") - F.col("y"))
    kicks = facts.where(B.is_kick(B.CLEAR_MS)).withColumn("travel", travel).where(
        (F.col("travel") >= CLEAR_TRAVEL_M) & F.col("origin.x").isNotNull())
    cands = kicks.join(lags, "match_id").select(
        "match_id", "frame", F.col("t").alias("time_s"), F.col("origin.frame").alias("at"),
        F.col("origin.t").alias("origin_t"), F.col("origin.x").alias("px"), F.col("origin.y").alias("py"), "lag", "speed", "vx", "travel")
    return _candidates(cands, "clearance", 0.5, F.lit(None).cast("string"), "origin_t", "speed", "vx", "travel")


def _cleared(found: DataFrame, sides: DataFrame, length: float, marks: DataFrame | None = None) -> DataFrame:
    found = found.where(F.col("player_team").isin(0, 1))
    placed = orientation_at(found, sides, marks, "origin_t").where(F.col("attack_0").isNotNull())
    attack = F.when(F.col("player_team") == 0, F.col("attack_0")).otherwise(F.col("attack_1"))
    own_x = F.when(attack > 0, 0.0).otherwise(length)
    out = F.col("px") - own_x
    kept = placed.where((F.abs(out) <= THIRD * length) & (out * F.col("vx") > 0))
    note = F.concat(F.lit("ball kicked at "), labels.whole(F.col("speed")), F.lit(" m/s away from the "),
                    F.when(attack > 0, "left").otherwise("right"), F.lit(" goal from "), labels.whole(F.abs(out)),
                    F.lit(" m out, traveling "), labels.whole(F.col("travel")), F.lit(" m"))
    return kept.select("match_id", F.col("event_frame").cast("long").alias("frame"), "time_s",
                       F.lit("clearance").alias("type"), F.col("player_team").cast("long").alias("team"),
                       note.alias("note"), F.lit("ball").alias("source"), F.lit(0.5).alias("confidence"),
                       F.col("player_track").cast("long").alias("player_track"))


def detect_tackles(facts: DataFrame, fast: DataFrame, lags: DataFrame) -> DataFrame:
    """``fast``: observations with ``speed_kmh``. A runner stops beside the ball as the ball's speed changes."""
    rows = halo(fast.where(F.col("team").isin(0, 1)), "t", B.TIME_BLOCK_S, back=TACKLE_S, ahead=0.0)
    w = Window.partitionBy("match_id", "track_id", "_blk").orderBy("t", "frame")
    rows = rows.withColumns({"_ps": F.lag("speed_kmh").over(w), "_pt": F.lag("t").over(w)}).where("_own")
    stops = rows.where((F.col("speed_kmh") <= TACKLE_STOP) & (F.col("_ps") >= TACKLE_MOVE)
                       & (F.col("t") - F.col("_pt") <= TACKLE_S))
    last = facts.groupBy("match_id").agg(F.max("frame").alias("_last"))
    stops = stops.join(lags, "match_id").join(last, "match_id").select(
        "match_id", "track_id", "team", F.col("frame").alias("at"), F.col("t").alias("time_s"),
        F.col("x").alias("px"), F.col("y").alias("py"), "_ps",
        F.explode(F.array(
            F.struct(F.lit("here").alias("which"), F.col("frame").alias("f")),
            F.struct(F.lit("before").alias("which"), F.greatest(F.lit(0), F.col("frame") - F.col("lag")).alias("f")),
            F.struct(F.lit("after").alias("which"), F.least("_last", F.col("frame") + F.col("lag")).alias("f")),
        )).alias("_look"))
    seen = stops.withColumn("frame", F.col("_look.f")).join(
        facts.select("match_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"), "speed"),
        ["match_id", "frame"])

    def only(which, c):
        return F.max(F.when(F.col("_look.which") == which, c))

    wide = seen.groupBy("match_id", "track_id", "at").agg(
        F.first("team").alias("team"), F.first("time_s").alias("time_s"), F.first("_ps").alias("_ps"),
        only("here", F.hypot(F.col("bx") - F.col("px"), F.col("by") - F.col("py"))).alias("distance"),
        only("before", F.col("speed")).alias("v0"), only("after", F.col("speed")).alias("v1"))
    kept = wide.where((F.col("distance") <= TACKLE_M) & (F.abs(F.col("v1") - F.col("v0")) > TACKLE_CHANGE))
    note = F.concat(F.lit("player stopped from "), labels.whole(F.col("_ps")), F.lit(" km/h within "),
                    F.format_string("%.1f", F.col("distance")),
                    F.lit(" m of the ball as its speed changed - a challenge inferred from movement, not pose"))
    return kept.select("match_id", F.col("at").cast("long").alias("frame"), "time_s", F.lit("tackle").alias("type"),
                       F.col("team").cast("long").alias("team"), note.alias("note"), F.lit("ball").alias("source"),
                       F.lit(0.4).alias("confidence"), F.col("track_id").cast("long").alias("player_track"))


class _KeepBest(Fold):
    """Same-type events closer than the gap: the first one keeps its place, a more confident one replaces it."""

    def __init__(self, gap: float):
        self.gap, self.open = gap, []

    def step(self, row):
        done = [o for o in self.open if row.time_s - o.time_s >= self.gap]
        self.open = [o for o in self.open if row.time_s - o.time_s < self.gap]
        for i, other in enumerate(self.open):
            if abs(other.time_s - row.time_s) < self.gap:
                if row.confidence > other.confidence:
                    self.open[i] = row
                break
        else:
            self.open.append(row)
        return done

    def close(self):
        return self.open


def dedupe_events(events: DataFrame, gap: float = EVENT_GAP_S) -> DataFrame:
    """Keep the most confident event of each type within ``gap`` of another of that type."""
    pieces = gap_pieces(events, ["match_id", "type"], ["time_s", "frame"], gap, size=600.0)
    kept = fold_sorted(pieces, ["match_id", "type", "piece"], ["time_s", "frame"], lambda key: _KeepBest(gap),
                       pieces.schema)
    return kept.drop("piece")


def detect_events(facts: DataFrame, fast: DataFrame, sides: DataFrame, whistles: DataFrame, length: float,
                  width: float, marks: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """All six detectors, deduplicated, with shirt numbers. ``facts`` and ``fast`` are read by several of them.

    The detectors' candidates find their players together: the observations meet them in one join. ``marks``: one row a match, with
    ``sides`` by half. A track has one number, the least of those ``numbers`` gives it.
    """
    facts, fast = cut(facts), cut(fast)
    sides = sides if marks is None else cut(every_half(sides, marks))
    lags, spells = cut(lag_frames(facts)), cut(B.static_runs(facts))
    first = cut(goal_candidates(facts, lags, length, width).unionByName(penalty_candidates(spells, whistles, lags, length, width)))
    cands = first.unionByName(free_shots(facts, first, lags, length, width)) \
        .unionByName(corner_candidates(spells, lags, length, width)) \
        .unionByName(clearance_candidates(facts, lags), allowMissingColumns=True)
    near = cut(_nearest(cut(cands), fast))
    found = _attributed(near.where("type <> 'clearance'")) \
        .unionByName(_cleared(near.where("type = 'clearance'"), sides, length, marks)) \
        .unionByName(detect_tackles(facts, fast, lags))
    out = dedupe_events(cut(found))
    if numbers is not None:
        n = numbers.groupBy("match_id", F.col("track_id").alias("player_track")).agg(F.min("number").alias("player_number"))
        out = out.join(n, ["match_id", "player_track"], "left").select(*out.columns, "player_number")
    return out


def as_log_rows(found: DataFrame, video: str = "game") -> DataFrame:
    """Detected events as rows of the review log: an id that a repeated scan gives again, the recording, no verdict."""
    own = F.xxhash64("match_id", "type", "frame", F.coalesce("player_track", F.lit(-1).cast("long")))
    number = F.col("player_number") if "player_number" in found.columns else F.lit(None).cast("string")
    return found.select("match_id", own.alias("event_id"), "time_s", "type", "team", "note", "source", "confidence",
                        F.lit(video).alias("video"), F.lit("").alias("verdict"), "player_track",
                        number.cast("string").alias("player_number"))


class _Spaced(Fold):
    """Greedy self spacing in time order: a row closer than the gap to a kept one is dropped."""

    def __init__(self, gap: float):
        self.gap, self.kept = gap, None

    def step(self, row):
        if self.kept is not None and abs(row.time_s - self.kept) < self.gap:
            return ()
        self.kept = row.time_s
        return (row,)


def verdict() -> Column:
    """A row's verdict; one that is missing is not reviewed yet."""
    return F.coalesce(F.col("verdict"), F.lit(""))


def is_manual() -> Column:
    """Whether a row was entered by hand; logs from before the column had only such rows."""
    return F.coalesce(F.col("source"), F.lit("manual")) == "manual"


def add_detected(log: DataFrame, fresh: DataFrame, gap: float = DUPLICATE_S) -> DataFrame:
    """Fresh candidates that are not within ``gap`` of a recorded detection or of an earlier kept candidate."""
    recorded = log.where(~is_manual()).select("match_id", "time_s")
    free = within(fresh, recorded, ["match_id"], "time_s", gap, "_known").where(~F.col("_known")).drop("_known")
    pieces = gap_pieces(free, ["match_id"], ["time_s", "event_id"], gap, size=600.0)
    return fold_sorted(pieces, ["match_id", "piece"], ["time_s", "event_id"], lambda key: _Spaced(gap),
                       pieces.schema).drop("piece")


def reconcile(log: DataFrame, fresh: DataFrame, source: str | None = None,
              gap: float = DUPLICATE_S) -> tuple[DataFrame, DataFrame]:
    """The log after a fresh scan and the rows it dropped; every row is in one of the two. Manual and confirmed rows stay."""
    both = log.withColumn("_new", F.lit(False)).unionByName(
        add_detected(log, fresh, gap).withColumn("_new", F.lit(True)))
    safe = is_manual() | (verdict() == "true")
    if source is not None:
        safe = safe | (F.col("source") != source)
    seen = within(both, fresh.select("match_id", "time_s"), ["match_id"], "time_s", gap, "_fresh")
    keep = safe | F.coalesce(F.col("_fresh"), F.lit(False))
    return seen.where(keep).drop("_fresh", "_new"), seen.where(~keep).drop("_fresh", "_new")


def rescan(log: DataFrame, found: DataFrame, video: str = "game", source: str = "ball") -> tuple[DataFrame, DataFrame]:
    """The log after a scan that found ``found`` (rows of a detector), and the rows it dropped; see ``reconcile``."""
    from ..sources.reports import with_event_defaults
    fresh = as_log_rows(found, video)
    kinds = dict(fresh.dtypes)
    have = with_event_defaults(log)
    have = have.select(*[(F.col(c) if c in have.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in fresh.columns])
    return reconcile(cut(have), cut(fresh), source)


def review_counts(log: DataFrame) -> DataFrame:
    v = verdict()
    return log.groupBy("match_id").agg(
        F.count(F.when(v == "true", 1)).alias("confirmed"), F.count(F.when(v == "false", 1)).alias("rejected"),
        F.count(F.when(~v.isin("true", "false"), 1)).alias("unreviewed"))


def event_subset(log: DataFrame, which: str, t: float | None = None) -> DataFrame:
    """``manual``, ``detected``, ``without_detected``, ``without_false`` or ``before`` a time."""
    manual = is_manual()
    rules = {"manual": manual, "detected": ~manual, "without_detected": manual,
             "without_false": manual | (verdict() != "false"),
             "before": F.col("time_s") <= F.lit(t if t is not None else 0.0)}
    return log.where(rules[which])


def repeated_tags(log: DataFrame, tags: DataFrame, gap: float = 0.01) -> DataFrame:
    """Manual tags already in the log: same type, team and recording, closer than ``gap``."""
    keys = ["match_id", "type", "team", "video"]
    seen = within(tags, log.where(is_manual()).select(*keys, "time_s"), keys, "time_s", gap, "_dup",
                  block=60.0)
    return seen.where("_dup").drop("_dup")


def event_from_tag(tags: DataFrame, window_start: Column, duration: Column) -> DataFrame:
    """Manual tags on the window clock to log events; ``rejected`` marks an unknown type."""
    t = F.least(F.greatest(F.coalesce("time_s", F.lit(0.0)), F.lit(0.0)), F.greatest(duration, F.lit(0.0)))
    return tags.withColumns({
        "rejected": ~F.coalesce(F.col("type").isin(*labels.EVENT_TYPES), F.lit(False)),
        "time_s": window_start + t,
        "note": F.substring(F.trim(F.coalesce("note", F.lit(""))), 1, 200)})


def event_table(log: DataFrame, clips: DataFrame, marks: DataFrame, sides: DataFrame) -> DataFrame:
    """Events with play class, half, match clock and the goal an attacking event aims at."""
    on_clip = log.join(clips.select("match_id", F.col("path").alias("video"), F.col("start_s").alias("_clip")),
                       ["match_id", "video"], "left")
    game = F.when(F.col("video") == "game", F.col("time_s")).otherwise(F.col("time_s") + F.col("_clip"))
    rows = on_clip.join(marks.select("match_id", "start_s", "half_s", "end_s"), "match_id", "left")
    half = labels.half_of(game, F.col("start_s"), F.col("half_s"), F.col("end_s"))
    rows = rows.withColumns({"play": labels.event_play(F.col("type")), "game_s": game, "half": half.cast("long")})
    at = rows.join(sides.select("match_id", "half", "attack_0", "attack_1"), ["match_id", "half"], "left")
    way = F.when(F.col("team") == 0, F.col("attack_0")).when(F.col("team") == 1, F.col("attack_1"))
    clock = F.when(F.col("half") == 1, F.col("game_s") - F.col("start_s")).when(
        F.col("half") == 2, F.col("game_s") - F.col("half_s"))
    return at.select(*log.columns, "play", labels.half_label(F.col("half")).alias("half"), clock.alias("match_clock"),
                     F.when(F.col("play") == "attacking", labels.aiming_goal(way)).otherwise("").alias("aim"))
