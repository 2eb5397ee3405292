"""Reports, replays and event logs as files: partitioned parquet tables and JSON documents per match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK, block_of

MOMENTUM = "map<string,struct<team_0:double,team_1:double,action_x:double,contested_frames:bigint,uncontested_frames:bigint>>"
EVENT_DEFAULTS = {"type": "other", "team": -1, "note": "", "source": "manual", "confidence": 1.0, "video": "", "verdict": ""}


NOTE_NO_TEAMS = "no two kits could be told apart: this match has no team figures"
NOTE_WEAK = " track(s) wear a kit close to both teams': their team is a guess"
NOTE_EVENTS = "events found from ball and tracks are goals, shots, corners, penalties, clearances and tackles; saves and blocks are tagged by hand"
NOTE_VIEW = "the camera sees a part of the pitch at a time: there is no formation of whole teams"


def report_notes(labels: DataFrame) -> DataFrame:
    """``match_id, notes``: what a reader of the report has to know. ``labels``: ``match_id, track_id, team, quality``."""
    from ..operators.teams import is_weak
    counts = labels.groupBy("match_id").agg(F.count_if(F.col("team") >= 0).alias("known"), F.count_if(is_weak()).alias("weak"))
    notes = F.array(F.when(F.col("known") == 0, NOTE_NO_TEAMS), F.when(F.col("weak") > 0, F.concat(F.col("weak").cast("string"), F.lit(NOTE_WEAK))),
                    F.lit(NOTE_EVENTS), F.lit(NOTE_VIEW))
    return counts.select("match_id", F.array_compact(notes).alias("notes"))


def report_facts(labels: DataFrame, kept: DataFrame, frames: DataFrame, length: float, width: float) -> DataFrame:
    """One row for each match that has frames: notes, pitch, how many detections were used (``kept`` on the pitch) and how
    many frames analyzed."""
    used = kept.groupBy("match_id").agg(F.count(F.lit(1)).alias("detections_used"))
    seen = frames.groupBy("match_id").agg((F.max("frame") + 1).alias("frames_analyzed"))
    rows = seen.join(used, "match_id", "left").join(report_notes(labels), "match_id", "left")
    bare = F.array(F.lit(NOTE_NO_TEAMS), F.lit(NOTE_EVENTS), F.lit(NOTE_VIEW))
    return rows.select("match_id", F.coalesce("notes", bare).alias("notes"), F.array(F.lit(float(length)), F.lit(float(width))).alias("pitch"),
                       F.coalesce("detections_used", F.lit(0)).alias("detections_used"), "frames_analyzed")


def report_players(tracks: DataFrame) -> DataFrame:
    """``match_id, players``: track, team, observations, distance and top speed of each track of ``build_tracks``."""
    one = F.struct("track_id", F.col("team").cast("long").alias("team"), "observations", F.bround("distance_m", 1).alias("distance_m"),
                   F.bround("top_speed_kmh", 1).alias("top_speed_kmh"))
    return tracks.groupBy("match_id").agg(F.sort_array(F.collect_list(one)).alias("players"))


def report_paths(obs: DataFrame) -> DataFrame:
    """Places of each track in parts of ``BLOCK`` frames, to a tenth of a meter: a match's document stays small."""
    at = F.struct("frame", F.array(F.bround("x", 1), F.bround("y", 1)).alias("xy"))
    parts = obs.groupBy("match_id", "track_id", block_of("frame", BLOCK).alias("part")).agg(F.sort_array(F.collect_list(at)).alias("_at"))
    return parts.select("match_id", "track_id", "part", F.transform("_at", lambda a: a["xy"]).alias("xy"))


def report_documents(teams: DataFrame, momentum: DataFrame, players: DataFrame | None = None, facts: DataFrame | None = None,
                     *others: DataFrame) -> DataFrame:
    """One JSON report per match: team rows and the minute map, and the players, facts and ``others`` (a row a match) where given."""
    t = teams.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("team", *[c for c in teams.columns if c not in (
        "match_id", "team")]))).alias("teams"))
    pair = F.struct(F.col("minute").cast("string"), F.struct("team_0", "team_1", "action_x", "contested_frames", "uncontested_frames"))
    m = momentum.groupBy("match_id").agg(F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("momentum"))
    out, parts = t.join(m, "match_id", "full"), ["teams", "momentum"]
    for more in (players, facts, *others):
        if more is not None:  # a match without teams has facts
            out = out.join(more, "match_id", "full")
            parts += [c for c in more.columns if c != "match_id"]
    return out.select("match_id", F.to_json(F.struct(*parts)).alias("report"))


def write_report(teams: DataFrame, momentum: DataFrame, path: str, players: DataFrame | None = None, facts: DataFrame | None = None) -> None:
    report_documents(teams, momentum, players, facts).write.mode("overwrite").parquet(f"{path}/report")


def momentum_of_report(documents: DataFrame) -> DataFrame:
    """The minute table back from documents; keys that are no numbers are dropped."""
    rows = documents.select("match_id", F.explode(F.from_json("report", f"struct<momentum:{MOMENTUM}>")["momentum"]).alias("k", "v"))
    return rows.select("match_id", F.expr("try_cast(k AS BIGINT)").alias("minute"), "v.*").where(F.col("minute").isNotNull())


PLAYERS = "array<struct<track_id:bigint,team:bigint,observations:bigint,distance_m:double,top_speed_kmh:double>>"
FACTS = "notes:array<string>,pitch:array<double>,detections_used:bigint,frames_analyzed:bigint"


def players_of_report(documents: DataFrame) -> DataFrame:
    rows = documents.select("match_id", F.explode(F.from_json("report", f"struct<players:{PLAYERS}>")["players"]).alias("p"))
    return rows.select("match_id", "p.*")


def facts_of_report(documents: DataFrame) -> DataFrame:
    """The match's facts back from documents; what an older report lacks is null."""
    return documents.select("match_id", F.from_json("report", f"struct<{FACTS}>").alias("f")).select("match_id", "f.*")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return momentum_of_report(spark.read.parquet(f"{path}/report"))


def write_events(log: DataFrame, path: str) -> None:
    log.withColumns({"time_s": F.bround("time_s", 3), "confidence": F.bround("confidence", 3)}).write.mode("overwrite").partitionBy(
        "match_id").parquet(path)


def with_event_defaults(log: DataFrame) -> DataFrame:
    """Fill columns an older log lacks, and missing values."""
    out = log
    for name, default in EVENT_DEFAULTS.items():
        have = F.col(name) if name in log.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(have, F.lit(default)))
    return out


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return with_event_defaults(spark.read.option("mergeSchema", "true").parquet(path))


def upgrade_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old column names to new ones. Where a table has both, each row keeps its new value and else its old one."""
    out = df
    for old, new in names.items():
        if old not in out.columns:
            continue
        if new in out.columns:
            out = out.withColumn(new, F.coalesce(new, old)).drop(old)
        else:
            out = out.withColumnRenamed(old, new)
    return out


def replay_players(fast: DataFrame, stats: DataFrame, block: int = BLOCK) -> DataFrame:
    """Player series of the replay in parts of ``block`` frames, times in order inside a part.

    A part is a bounded array; concatenating parts in ``part`` order gives the whole series.
    """
    point = F.struct("frame", F.bround("x", 1).alias("x"), F.bround("y", 1).alias("y"), F.bround("speed_kmh", 1).alias("speed"))
    parts = fast.join(stats.select("match_id", "track_id"), ["match_id", "track_id"], "left_semi").groupBy(
        "match_id", "track_id", block_of("frame", block).alias("part")).agg(F.sort_array(F.collect_list(point)).alias("points"))
    return parts.select("match_id", "track_id", "part", F.transform("points", lambda p: p["frame"]).alias("frames"),
                        F.transform("points", lambda p: F.array(p["x"], p["y"])).alias("xy"),
                        F.transform("points", lambda p: p["speed"]).alias("speed"))


def replay_frames(aim: DataFrame, ball: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Aim points (and ball) of the replay in parts of ``block`` frames."""
    rows = aim if ball is None else aim.join(ball.select("match_id", "frame", "x", "y", "measured"), ["match_id", "frame"], "left")
    known = F.col("aim_x").isNotNull() & F.col("aim_y").isNotNull()
    cols = [F.col("frame"), F.when(known, F.array(F.bround("aim_x", 1), F.bround("aim_y", 1))).alias("aim")]
    if ball is not None:
        seen = F.col("x").isNotNull() & F.col("y").isNotNull()
        cols.append(F.when(seen, F.array(F.bround("x", 1), F.bround("y", 1), F.col("measured"))).alias("ball"))
    parts = rows.groupBy("match_id", block_of("frame", block).alias("part")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("f"))
    out = [F.transform("f", lambda p: p["aim"]).alias("aim")]
    if ball is not None:
        out.append(F.transform("f", lambda p: p["ball"]).alias("ball"))
    return parts.select("match_id", "part", *out)


def replay_documents(fast: DataFrame, stats: DataFrame, aim: DataFrame, bystanders: DataFrame, pitch: tuple[float, float],
                     fps: float, attack: DataFrame | None = None, ball: DataFrame | None = None) -> DataFrame:
    """The replay as JSON rows: ``kind`` "match", "player" or "frames", with ``part`` for the long series."""
    gone = bystanders.groupBy("match_id").agg(F.count(F.lit(1)).alias("bystanders_excluded"))
    head = aim.groupBy("match_id").agg((F.max("frame") + 1).alias("frame_count")).join(gone, "match_id", "left").na.fill(0)
    if attack is not None:
        head = head.join(attack, "match_id", "left")
    head = head.withColumns({"pitch": F.array(*[F.lit(float(v)) for v in pitch]), "fps": F.lit(float(fps)),
                             "duration_s": F.bround(F.col("frame_count") / fps, 1)})
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    out = head.select("match_id", F.lit("match").alias("kind"), none.alias("track_id"), zero.alias("part"),
                      F.to_json(F.struct(*[c for c in head.columns if c != "match_id"])).alias("document"))
    players = replay_players(fast, stats).join(
        stats.select("match_id", "track_id", "team", F.struct(*[c for c in stats.columns if c not in ("match_id", "track_id", "team")])
                     .alias("stats")), ["match_id", "track_id"])
    out = out.unionByName(players.select("match_id", F.lit("player").alias("kind"), "track_id", "part", F.to_json(F.struct(
        "team", "frames", "xy", "speed", F.when(F.col("part") == 0, F.col("stats")).alias("stats"))).alias("document")))
    frames = replay_frames(aim, ball)
    return out.unionByName(frames.select("match_id", F.lit("frames").alias("kind"), none.alias("track_id"), "part", F.to_json(
        F.struct(*[c for c in frames.columns if c not in ("match_id", "part")])).alias("document")))


def tracks_of_replay(players: DataFrame, starts: DataFrame, fps: float) -> DataFrame:
    """Observations back from replay player parts; ``starts``: ``match_id, start_s``. Sigma is half a meter."""
    rows = players.select("match_id", "track_id", "team", F.explode(F.arrays_zip("frames", "xy", "speed")).alias("p"))
    return rows.join(starts, "match_id").select(
        "match_id", "track_id", "team", F.col("p.frames").alias("frame"),
        (F.col("start_s") + F.col("p.frames") / max(fps, 1e-6)).alias("t"), F.col("p.xy")[0].alias("x"), F.col("p.xy")[1].alias("y"),
        F.lit(0.5).alias("sigma_m"), F.col("p.speed").alias("speed_kmh"))
