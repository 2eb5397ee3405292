"""The two composite jobs: a match report from detections, and detected events from the ball and the tracks.

Each stage that is read more than once is written to the checkpoint folder, so no stage is computed twice and losing an
executor costs one stage at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ball as B
from ..operators import events as E
from ..operators import metrics as M
from ..operators import projection as P
from ..operators import teams as TM
from ..operators import tracking as TK
from ..operators.blocks import rated
from ..session import cut, discard, stored
from ..sources import reports as R


@dataclass
class Report:
    """The tables of a report; all lazy except what later stages shared."""

    observations: DataFrame  # labeled observations with speed
    tracks: DataFrame
    labels: DataFrame
    colors: DataFrame
    momentum: DataFrame
    teams: DataFrame
    roles: DataFrame
    sides: DataFrame
    players: DataFrame
    facts: DataFrame

    def documents(self) -> DataFrame:
        """``match_id, report``: all of a match's tables but its observations in one JSON document."""
        roles = self.roles.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("track_id", "role", "side"))).alias("roles"))
        stats = F.struct(*[c for c in self.players.columns if c != "match_id"])
        field = self.players.groupBy("match_id").agg(F.sort_array(F.collect_list(stats)).alias("field_players"))
        sides = M.attack_summary(self.sides).withColumnRenamed("directions", "attack")
        return R.report_documents(self.teams, self.momentum, R.report_players(self.tracks), self.facts, roles, sides, field)


def _both_teams(teams: DataFrame, moments: DataFrame, colors: DataFrame, matches: DataFrame) -> DataFrame:
    """Both teams of every match with the color of their kit; a team that nobody was seen of has zeros and no color."""
    rows = matches.select("match_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("team"))
    share = moments.groupBy("match_id").agg(F.avg("team_0").alias("_share"))
    rgb = colors.select("match_id", "team", F.array("r", "g", "b").alias("kit_rgb"))
    rows = rows.join(teams, ["match_id", "team"], "left").join(rgb, ["match_id", "team"], "left").join(share, "match_id", "left")
    poss = F.bround(F.coalesce(F.when(F.col("team") == 0, F.col("_share")).otherwise(1.0 - F.col("_share")), F.lit(0.0)), 3)
    numbers = [c for c in teams.columns if c not in ("match_id", "team", "possession_share")]
    return rows.select("match_id", "team", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
                       F.coalesce("possession_share", poss).alias("possession_share"), "kit_rgb")


def report_from_ground(ground: DataFrame, aim: DataFrame, length: float, width: float, rate: float | DataFrame | None = None,
                       marks: DataFrame | None = None, frames: DataFrame | None = None) -> Report:
    """``rate``: one for all matches, ``match_id, rate``, or measured by match from the frames' times. ``ground``: ``match_id, frame, t, det_id, x, y, sigma_m, height_px, kit ARRAY(12), hint`` (unknown positions NULL). ``frames``: all that were analyzed, where also those without a detection are known."""
    ground = cut(ground)
    frames = ground if frames is None else frames
    rate = cut(M.sampling_rate(ground)) if rate is None else rate
    kept = M.on_pitch(ground, length, width).select("match_id", "frame", "t", "det_id", "x", "y", "sigma_m", "height_px",
                                                    "kit", "hint")
    tracked = stored(kept.join(TK.track_people(kept, rate), ["match_id", "frame", "det_id"]))
    colors5 = TM.kit_evidence(tracked).select("match_id", "track_id", F.slice("descriptor", 1, 5).alias("kit"))
    rows = cut(TK.stitch_tracks(tracked, cut(colors5), rate))
    discard(tracked)
    near = cut(TM.kit_evidence(rows))
    # smaller crops only tell of tracks that have no larger ones
    far = cut(TM.kit_evidence(rows.join(near.select("match_id", "track_id"), ["match_id", "track_id"], "left_anti"), TM.LABEL_HEIGHT))
    # the evidence floor counts every detection of the match, on the pitch or not
    floors = rated(ground.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")), rate).select(
        "match_id", TM.evidence_floor(F.col("n"), F.col("rate")).alias("floor"))
    voters, model = TM.assign_teams(near, floors)
    labels = cut(TM.propagate_labels(voters, model, near, far))
    labeled = rows.drop("kit").join(labels.select("match_id", "track_id", "team"), ["match_id", "track_id"], "left").na.fill(
        {"team": -1})
    fast = cut(M.speeds(labeled))
    tracks = cut(M.build_tracks(fast))
    long_enough = fast.join(tracks.select("match_id", "track_id"), ["match_id", "track_id"], "left_semi")
    moments = cut(M.momentum(fast, aim))
    # a keeper and a referee are seen far longer than MIN_OBS, so short tracks need no join to stay out
    roles = cut(M.classify_roles(fast, length, near))
    # a team wears the colors of all its tracks, also of those seen in smaller crops only
    colors = cut(TM.team_colors(labels, near.unionByName(far)))
    teams = _both_teams(M.team_metrics(tracks, moments, length), moments, colors, frames.select("match_id").distinct())
    return Report(fast, tracks, labels, colors, moments, teams, roles,
                  M.orientations(long_enough, marks), M.player_stats(fast, aim, rate, roles, tracks),
                  R.report_facts(labels, kept, frames, length, width))


def build_report(detections: DataFrame, frames: DataFrame, calibrations: DataFrame, length: float, width: float,
                 rate: float | DataFrame | None = None, anchors: DataFrame | None = None, marks: DataFrame | None = None) -> Report:
    """From image detections and camera poses (corrected for drift where anchors are given) to the report.

    A frame that is listed again is one frame, so its detections stay single.
    """
    pose = F.min(F.struct("t", "q", "focal", "ok"))
    poses = frames.where(F.col("match_id").isNotNull() & F.col("frame").isNotNull()).groupBy("match_id", "frame").agg(
        pose.alias("p")).select("match_id", "frame", "p.*")
    poses = cut(poses if anchors is None else P.apply_drift(poses, anchors))
    timed = detections.join(poses.select("match_id", "frame", "t"), ["match_id", "frame"])
    return report_from_ground(cut(P.project_detections(timed, poses, calibrations)), cut(P.frame_aim(poses, calibrations)), length,
                              width, rate, marks, poses)


def detect_match_events(ball: DataFrame, report: Report, whistles: DataFrame, length: float, width: float,
                        marks: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """Events of the ball ``(match_id, frame, t, x, y, measured)`` and the report's tracks."""
    facts = B.frame_facts(B.ball_motion(ball, length, width), length, width)
    return E.detect_events(facts, report.observations, report.sides, whistles, length, width, marks, numbers)


def review_match_events(log: DataFrame, ball: DataFrame, report: Report, whistles: DataFrame, length: float, width: float,
                        marks: DataFrame | None = None, numbers: DataFrame | None = None,
                        video: str = "game") -> tuple[DataFrame, DataFrame]:
    """Scan anew and bring the review log in line: the log afterwards and the rows that went."""
    return E.rescan(log, detect_match_events(ball, report, whistles, length, width, marks, numbers), video)
