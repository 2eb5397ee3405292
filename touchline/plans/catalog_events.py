"""Queries on ball motion, detected events and the review log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ball as B
from ..operators import events as E
from ..operators import identity as I
from ..operators import joins as J
from ..operators import metrics as M
from ..session import cut, shared_path
from ..sources.event_store import EventStore
from .catalog_identity import _sources
from .catalog_metrics import SPEED_CTE, one_mark
from .registry import query
from .views import PITCH

L, W = PITCH

MOTION_CTE = """
usual AS (SELECT match_id, 12e0 * greatest(quantile_cont(st, 0.5), 0.5e0) AS lim FROM (
    SELECT match_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS st
    FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame)) a GROUP BY 1),
cl AS (SELECT q.match_id, frame, t, measured, CASE WHEN n >= 3 AND sqrt((x - mx) ** 2 + (y - my) ** 2) > lim THEN NULL
    ELSE x END AS x, CASE WHEN n >= 3 AND sqrt((x - mx) ** 2 + (y - my) ** 2) > lim THEN NULL ELSE y END AS y
  FROM (SELECT *, count(x) OVER w AS n, quantile_cont(x, 0.5) OVER w AS mx, quantile_cont(y, 0.5) OVER w AS my
    FROM ball WINDOW w AS (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) q
  JOIN usual u ON u.match_id = q.match_id),
m1 AS (SELECT *, lag(x, 2) OVER w AS bx, lag(y, 2) OVER w AS by_, lag(x) OVER w AS ax, lag(y) OVER w AS ay,
    t - lag(t, 2) OVER w AS span FROM cl WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
m2 AS (SELECT *, CASE WHEN x IS NOT NULL AND ax IS NOT NULL AND bx IS NOT NULL
    AND sqrt((x - bx) ** 2 + (y - by_) ** 2) / span <= 45e0 THEN 1 END AS ok, sqrt((x - bx) ** 2 + (y - by_) ** 2) AS net,
    sqrt((x - ax) ** 2 + (y - ay) ** 2) + sqrt((ax - bx) ** 2 + (ay - by_) ** 2) AS path FROM m1),
mo AS (SELECT match_id, frame, t, measured, x, y, CASE WHEN ok = 1 THEN net / span END AS speed,
    CASE WHEN ok = 1 THEN (x - bx) / span END AS vx, CASE WHEN ok = 1 THEN (y - by_) / span END AS vy,
    CASE WHEN ok = 1 THEN CASE WHEN path > 1e-6 THEN net / path ELSE 0e0 END END AS straight FROM m2)"""

FACTS_CTE = MOTION_CTE + """,
f1 AS (SELECT *, coalesce(speed < 4e0, FALSE) AS still, coalesce(speed >= 12e0 AND straight >= 0.7e0, FALSE) AS kick,
    coalesce(measured > 0 AND sqrt((x - 50e0) ** 2 + (y - 32e0) ** 2) <= 12e0 AND speed < 4e0, FALSE) AS calm,
    max(frame) OVER (PARTITION BY match_id) AS lastf FROM mo),
f2 AS (SELECT *, min(CASE WHEN kick THEN frame END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING) AS k3,
    min(CASE WHEN kick THEN frame END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 26 FOLLOWING) AS k5,
    coalesce(max(CASE WHEN still THEN frame END) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
      greatest(frame - 8, 0)) AS org, least(frame + 15, lastf) AS lat,
    calm AND coalesce(min(CASE WHEN NOT calm THEN frame END) OVER (w ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING),
      least(frame + 15, lastf)) - frame >= 10 AS reset
  FROM f1 WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY match_id ORDER BY frame) AS g FROM (
    SELECT *, CASE WHEN lag(still) OVER (PARTITION BY match_id ORDER BY frame) THEN 0 ELSE 1 END AS brk FROM f2) a
  WHERE still),
runs AS (SELECT match_id, min(frame) AS start_frame, max(frame) + 1 AS end_frame, min(t) AS start_t,
    arg_min(x, frame) AS x, arg_min(y, frame) AS y, max_by(k3, frame) FILTER (k3 IS NOT NULL OR TRUE) AS k3x,
    g, max(frame) AS lf FROM isl GROUP BY match_id, g HAVING max(frame) - min(frame) >= 5),
sr AS (SELECT r.match_id, r.start_frame, r.end_frame, r.start_t, r.x, r.y, f.k3, f.k5 FROM runs r
  JOIN f2 f ON f.match_id = r.match_id AND f.frame = r.lf)"""


def near(points: str) -> str:
    """Oracle text: ``points`` (match_id, ef, af, px, py) with the nearest player."""
    return f"""SELECT match_id, ef, track_id AS player_track, team AS player_team FROM (
    SELECT p.match_id, p.ef, o.track_id, o.team, row_number() OVER (PARTITION BY p.match_id, p.ef ORDER BY
        sqrt((o.x - p.px) ** 2 + (o.y - p.py) ** 2), o.frame, o.track_id) AS k
    FROM {points} p JOIN obs o ON o.match_id = p.match_id AND o.frame BETWEEN greatest(0, p.af - 2) - 2
      AND greatest(0, p.af - 2) + 2
    WHERE sqrt((o.x - p.px) ** 2 + (o.y - p.py) ** 2) <= 9e0) z WHERE k = 1"""


GOALS = FACTS_CTE + f""",
gh AS (SELECT match_id, frame AS ef, frame AS af, t, x AS px, y AS py FROM f2 h WHERE abs(y - 32e0) <= 5.16e0 AND
    ((x <= 2.5e0 AND vx < -12e0) OR (x >= 97.5e0 AND vx > 12e0)) AND EXISTS (SELECT 1 FROM f2 r
      WHERE r.match_id = h.match_id AND r.reset AND r.frame >= h.frame AND r.t <= h.t + 60e0)),
gn AS ({near('gh')}),
goals AS (SELECT g.match_id, ef AS frame, t AS time_s, 'goal' AS type, coalesce(player_team, -1) AS team, player_track
  FROM gh g LEFT JOIN gn USING (match_id, ef))"""
PENS = GOALS + f""",
pc AS (SELECT s.match_id, s.k5 AS ef, s.k5 AS af, k.t, k.x AS px, k.y AS py FROM sr s
    JOIN f2 k ON k.match_id = s.match_id AND k.frame = s.k5
  WHERE least(sqrt((s.x - 11e0) ** 2 + (s.y - 32e0) ** 2), sqrt((s.x - 89e0) ** 2 + (s.y - 32e0) ** 2)) <= 3.5e0
    AND EXISTS (SELECT 1 FROM whistles w WHERE w.match_id = s.match_id AND w.time_s >= s.start_t - 20e0
      AND w.time_s <= s.start_t + 2e0)),
pn AS ({near('pc')}),
pens AS (SELECT p.match_id, ef AS frame, t AS time_s, 'penalty' AS type, coalesce(player_team, -1) AS team, player_track
  FROM pc p LEFT JOIN pn USING (match_id, ef))"""
SHOTS = PENS + f""",
sc AS (SELECT k.match_id, k.frame AS ef, o.frame AS af, k.t, o.x AS px, o.y AS py, k.vx, k.vy, l.x AS lx, l.y AS ly,
    CASE WHEN k.vx < 0 THEN 0e0 ELSE 100e0 END AS gx
  FROM f2 k JOIN f2 o ON o.match_id = k.match_id AND o.frame = k.org
    JOIN f2 l ON l.match_id = k.match_id AND l.frame = o.lat WHERE k.speed >= 18e0 AND k.straight >= 0.7e0),
sk AS (SELECT * FROM sc s WHERE abs(gx - px) <= 35e0 AND abs(vx) >= 1e-6 AND (gx - px) / vx > 0
    AND abs(py + vy * ((gx - px) / vx) - 32e0) <= 5.16e0 AND sqrt((lx - px) ** 2 + (ly - py) ** 2) >= 12e0
    AND abs(gx - lx) < abs(gx - px) AND NOT EXISTS (
      SELECT 1 FROM (SELECT match_id, time_s FROM goals UNION ALL SELECT match_id, time_s FROM pens) e
      WHERE e.match_id = s.match_id AND abs(s.t - round_even(e.time_s, 3)) < 3e0)),
sn AS ({near('sk')}),
shots AS (SELECT s.match_id, ef AS frame, t AS time_s, 'shot' AS type, coalesce(player_team, -1) AS team, player_track
  FROM sk s LEFT JOIN sn USING (match_id, ef))"""
CORNERS = FACTS_CTE + f""",
cc AS (SELECT s.match_id, s.k3 AS ef, s.k3 AS af, k.t, k.x AS px, k.y AS py FROM sr s
    JOIN f2 k ON k.match_id = s.match_id AND k.frame = s.k3
  WHERE least(sqrt(s.x ** 2 + s.y ** 2), sqrt(s.x ** 2 + (s.y - 64e0) ** 2), sqrt((s.x - 100e0) ** 2 + s.y ** 2),
    sqrt((s.x - 100e0) ** 2 + (s.y - 64e0) ** 2)) <= 7e0),
cn AS ({near('cc')}),
corners AS (SELECT c.match_id, ef AS frame, t AS time_s, 'corner' AS type, coalesce(player_team, -1) AS team,
    player_track FROM cc c LEFT JOIN cn USING (match_id, ef))"""
CLEARS = FACTS_CTE + f""",
kc AS (SELECT k.match_id, k.frame AS ef, o.frame AS af, k.t, o.x AS px, o.y AS py, k.vx FROM f2 k
    JOIN f2 o ON o.match_id = k.match_id AND o.frame = k.org JOIN f2 l ON l.match_id = k.match_id AND l.frame = k.lat
  WHERE k.speed >= 20e0 AND k.straight >= 0.7e0 AND o.x IS NOT NULL
    AND sqrt((l.x - k.x) ** 2 + (l.y - k.y) ** 2) >= 20e0),
kn AS ({near('kc')}),
ori AS (SELECT match_id, avg(CASE WHEN team = 0 THEN x END) <= avg(CASE WHEN team = 1 THEN x END) AS zero_left
  FROM obs WHERE team IN (0, 1) GROUP BY 1),
clears AS (SELECT c.match_id, c.ef AS frame, c.t AS time_s, 'clearance' AS type, player_team AS team, player_track
  FROM kc c JOIN kn ON kn.match_id = c.match_id AND kn.ef = c.ef JOIN ori ON ori.match_id = c.match_id
  WHERE player_team IN (0, 1) AND abs(px - CASE WHEN (player_team = 0) = zero_left THEN 0e0 ELSE 100e0 END) <= 35e0
    AND (px - CASE WHEN (player_team = 0) = zero_left THEN 0e0 ELSE 100e0 END) * vx > 0)"""
TACKLES = FACTS_CTE + "," + SPEED_CTE + """,
tackles AS (SELECT s.match_id, s.frame, s.t AS time_s, 'tackle' AS type, CAST(s.team AS BIGINT) AS team,
    s.track_id AS player_track
  FROM (SELECT *, lag(speed_kmh) OVER w AS prev_v, lag(t) OVER w AS prev_t FROM sp
      WINDOW w AS (PARTITION BY match_id, track_id ORDER BY t)) s
    JOIN f2 h ON h.match_id = s.match_id AND h.frame = s.frame
    JOIN f2 b ON b.match_id = s.match_id AND b.frame = greatest(0, s.frame - 2)
    JOIN f2 a ON a.match_id = s.match_id AND a.frame = least(h.lastf, s.frame + 2)
  WHERE s.team IN (0, 1) AND s.speed_kmh <= 2e0 AND prev_v >= 12e0 AND s.t - prev_t <= 1.5e0
    AND sqrt((h.x - s.x) ** 2 + (h.y - s.y) ** 2) <= 2e0 AND abs(a.speed - b.speed) > 10e0)"""
EVENT_OUT = "match_id, frame, time_s, type, CAST(team AS BIGINT) AS team, player_track"


def _motion(T):
    return B.ball_motion(T["ball"], L, W)


def _facts(T):
    return cut(B.frame_facts(_motion(T), L, W))


def _six(df, *cols):
    return df.withColumns({c: F.bround(c, 6) for c in cols})


def _event(df):
    return df.select("match_id", "frame", "time_s", "type", "team", "player_track")


@query("drop_off_pitch", """SELECT match_id, count(px) AS known, round_even(sum(px), 6) AS sum_x FROM (
  SELECT match_id, CASE WHEN x * 1.1e0 - 5e0 >= -3e0 AND x * 1.1e0 - 5e0 <= 103e0 AND y >= -3e0 AND y <= 67e0
    THEN x * 1.1e0 - 5e0 END AS px FROM ball) a GROUP BY 1""")
def q_off(T):
    out = B.drop_off_pitch(T["ball"].withColumn("x", F.col("x") * 1.1 - 5.0), L, W)
    return out.groupBy("match_id").agg(F.count("x").alias("known"), F.bround(F.sum("x"), 6).alias("sum_x"))


SPIKED = """(SELECT match_id, frame, t, measured, CASE WHEN frame % 101 = 50 THEN x / 2e0 + 10e0 ELSE x END AS x, y
  FROM ball)"""


@query("reject_spikes", "WITH " + MOTION_CTE.replace("FROM ball", f"FROM {SPIKED} bb") + """
SELECT match_id, frame, x, y FROM cl""")
def q_spikes(T):
    x = F.when(F.col("frame") % 101 == 50, F.col("x") / 2.0 + 10.0).otherwise(F.col("x"))
    return B.reject_spikes(T["ball"].withColumn("x", x)).select("match_id", "frame", "x", "y")


@query("ball_motion", f"""WITH {MOTION_CTE} SELECT match_id, frame, round_even(speed, 6) AS speed,
  round_even(vx, 6) AS vx, round_even(vy, 6) AS vy, round_even(straight, 6) AS straight FROM mo""")
def q_motion(T):
    return _six(_motion(T).select("match_id", "frame", "speed", "vx", "vy", "straight"), "speed", "vx", "vy", "straight")


@query("static_runs", f"WITH {FACTS_CTE} SELECT match_id, start_frame, end_frame, x, y FROM sr")
def q_static(T):
    rows = cut(_motion(T)).withColumn("still", F.coalesce(F.col("speed") < B.STATIC_MS, F.lit(False)))
    return B.static_runs(rows).select("match_id", "start_frame", "end_frame", "x", "y")


@query("first_kick_after", f"WITH {FACTS_CTE} SELECT match_id, start_frame, k3 AS kick_3, k5 AS kick_5 FROM sr")
def q_kick(T):
    return B.static_runs(_facts(T)).select("match_id", "start_frame", F.col("kick_after_3.frame").alias("kick_3"),
                                           F.col("kick_after_5.frame").alias("kick_5"))


@query("kick_origin", f"WITH {FACTS_CTE} SELECT match_id, frame, org AS origin FROM f2 WHERE kick")
def q_origin(T):
    return _facts(T).where(B.is_kick(B.KICK_MS)).select("match_id", "frame", F.col("origin.frame").alias("origin"))


@query("travel", f"""WITH {FACTS_CTE} SELECT a.match_id, a.frame, round_even(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2), 6)
  AS travel_m FROM f2 a JOIN f2 b ON b.match_id = a.match_id AND b.frame = a.lat""")
def q_travel(T):
    d = F.hypot(F.col("later.x") - F.col("x"), F.col("later.y") - F.col("y"))
    return _facts(T).select("match_id", "frame", F.bround(d, 6).alias("travel_m"))


@query("center_resets", f"WITH {FACTS_CTE} SELECT match_id, frame FROM f2 WHERE reset")
def q_reset(T):
    return _facts(T).where("reset").select("match_id", "frame")


@query("detect_goals", f"WITH {GOALS} SELECT {EVENT_OUT} FROM goals")
def q_goals(T):
    f = _facts(T)
    return _event(E.detect_goals(f, T["obs"], E.lag_frames(f), L, W))


@query("detect_penalties", f"WITH {PENS} SELECT {EVENT_OUT} FROM pens")
def q_pens(T):
    f = _facts(T)
    return _event(E.detect_penalties(B.static_runs(f), T["whistles"], T["obs"], E.lag_frames(f), L, W))


@query("detect_shots", f"WITH {SHOTS} SELECT {EVENT_OUT} FROM shots")
def q_shots(T):
    f = _facts(T)
    lags = cut(E.lag_frames(f))
    first = E.detect_goals(f, T["obs"], lags, L, W).unionByName(
        E.detect_penalties(B.static_runs(f), T["whistles"], T["obs"], lags, L, W))
    return _event(E.detect_shots(f, first, T["obs"], lags, L, W))


@query("detect_corners", f"WITH {CORNERS} SELECT {EVENT_OUT} FROM corners")
def q_corners(T):
    f = _facts(T)
    return _event(E.detect_corners(B.static_runs(f), T["obs"], E.lag_frames(f), L, W))


@query("detect_clearances", f"WITH {CLEARS} SELECT {EVENT_OUT} FROM clears")
def q_clears(T):
    f = _facts(T)
    return _event(E.detect_clearances(f, T["obs"], M.orientations(T["obs"]), E.lag_frames(f), L))


@query("detect_tackles", f"WITH {TACKLES} SELECT {EVENT_OUT} FROM tackles")
def q_tackles(T):
    f = _facts(T)
    return _event(E.detect_tackles(f, M.speeds(T["obs"]), E.lag_frames(f)))


@query("detect_events")
def q_events(T):
    # the observations are made of the line items once; sides and tracks are told from the same rows
    fast = cut(M.speeds(T["obs"]).select("match_id", "track_id", "team", "frame", "t", "x", "y", "speed_kmh"))
    marks = one_mark(T)
    tracks = fast.groupBy("match_id", "track_id").agg(F.min("team").alias("team"))
    numbers = I.merge_numbers(tracks, *_sources(T)[1:])
    return E.detect_events(B.frame_facts(_motion(T), L, W), fast, M.orientations(fast, marks), T["whistles"], L, W, marks, numbers)


@query("nearest_player", f"""WITH pts AS (SELECT match_id, frame AS ef, frame AS af, x AS px, y AS py FROM ball
  WHERE x IS NOT NULL), nn AS ({near('pts')})
SELECT match_id, ef AS frame, player_track, CAST(player_team AS BIGINT) AS player_team
FROM pts LEFT JOIN nn USING (match_id, ef)""")
def q_nearest(T):
    pts = T["ball"].where(F.col("x").isNotNull()).select(
        "match_id", F.col("frame").alias("ef"), "frame", F.col("x").alias("px"), F.col("y").alias("py"),
        F.lit(2).alias("lag"))
    out = J.nearest_player(pts, T["obs"], ["ef"], 9.0)
    return out.select("match_id", "frame", F.col("player_track"), F.col("player_team").cast("long").alias("player_team"))


@query("first_whistle_in_window", """SELECT b.match_id, b.frame, min(w.time_s) AS whistle_s FROM ball b LEFT JOIN whistles w
  ON w.match_id = b.match_id AND w.time_s >= b.t - 20e0 AND w.time_s <= b.t + 2e0 GROUP BY 1, 2""")
def q_first_whistle(T):
    return J.first_in_window(T["ball"], T["whistles"], ["match_id"], "t", 20.0, 2.0, "whistle_s",
                             right_t="time_s").select("match_id", "frame", "whistle_s")


@query("asof_telemetry", """WITH tl AS (SELECT match_id, time_s, yaw, ball_x, locked FROM telemetry WHERE clip = 0),
b AS (SELECT match_id, frame, t FROM ball WHERE match_id IN (SELECT match_id FROM tl)),
p AS (SELECT b.match_id, b.frame, b.t, l.time_s AS bt, l.yaw AS by_, l.ball_x AS bb, l.locked AS bl
  FROM b ASOF LEFT JOIN tl l ON l.match_id = b.match_id AND l.time_s < b.t),
n AS (SELECT b.match_id, b.frame, l.time_s AS nt, l.yaw AS ny, l.ball_x AS nb, l.locked AS nl
  FROM b ASOF LEFT JOIN tl l ON l.match_id = b.match_id AND l.time_s >= b.t)
SELECT p.match_id, p.frame, CASE WHEN e THEN by_ ELSE ny END AS yaw, CASE WHEN e THEN bb ELSE nb END AS ball_x,
  CASE WHEN e THEN bl ELSE nl END AS locked
FROM (SELECT p.*, n.ny, n.nb, n.nl, bt IS NOT NULL AND (nt IS NULL OR t - bt < nt - t) AS e
  FROM p JOIN n ON n.match_id = p.match_id AND n.frame = p.frame) p""")
def q_asof(T):
    tl = T["telemetry"].where("clip = 0")
    left = T["ball"].join(tl.select("match_id").distinct(), "match_id", "left_semi").select("match_id", "frame", "t")
    out = J.asof_nearest(left, tl, ["match_id"], "t", "time_s", ["yaw", "ball_x", "locked"])
    return out.select("match_id", "frame", "near.yaw", "near.ball_x", "near.locked")


@query("pan_rate", """SELECT match_id, clip, n AS frame, coalesce(abs(yaw - lag(yaw) OVER (PARTITION BY match_id, clip
  ORDER BY n)), 0e0) AS pan_rate FROM telemetry""")
def q_pan(T):
    rows = T["telemetry"].select(F.expr("match_id * 2 + clip").alias("match_id"), F.col("n").alias("frame"), "yaw")
    return B.pan_rate(rows).select(F.expr("cast(floor(match_id / 2) as bigint)").alias("match_id"),
                                   (F.col("match_id") % 2).alias("clip"), "frame", "pan_rate")


@query("in_play", """SELECT match_id, min(n) AS start_frame, count(*) AS frames, max(n) + 1 AS end_frame FROM (
  SELECT match_id, n, n - row_number() OVER (PARTITION BY match_id ORDER BY n) AS g FROM telemetry
  WHERE clip = 0 AND n % 17 < 12) a GROUP BY match_id, g HAVING count(*) >= 5""")
def q_in_play(T):
    lock = T["telemetry"].where("clip = 0").select("match_id", F.col("n").alias("frame"),
                                                   (F.col("n") % 17 < 12).alias("locked"))
    return B.in_play(lock).select("match_id", "start_frame", "frames", "end_frame")


@query("image_possession", """WITH near AS (SELECT d.match_id, d.frame, d.det_id % 2 AS team,
    sqrt(((x1 + x2) / 2e0 - b.ball_x / 2560e0) ** 2 + (y2 - (720e0 + b.ball_ym) / 2560e0) ** 2) AS d2,
    abs((x1 + x2) / 2e0 - b.ball_x / 2560e0) AS d1, b.ball_ym, d.det_id
  FROM dets d JOIN telemetry b ON b.match_id = d.match_id AND b.n = d.frame AND b.clip = 0 AND b.locked),
best AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY CASE WHEN ball_ym IS NULL THEN d1 ELSE d2 END,
    det_id) AS k FROM near),
g AS (SELECT match_id, count(CASE WHEN team = 0 THEN 1 END) AS touches_0, count(CASE WHEN team = 1 THEN 1 END) AS touches_1,
  count(*) AS contested_frames FROM best WHERE k = 1 AND CASE WHEN ball_ym IS NULL THEN d1 ELSE d2 END <= 0.08e0 GROUP BY 1)
SELECT *, round_even(coalesce(touches_0 / nullif(CAST(touches_0 + touches_1 AS DOUBLE), 0), 0e0), 6) AS share_0,
  round_even(coalesce(touches_1 / nullif(CAST(touches_0 + touches_1 AS DOUBLE), 0), 0e0), 6) AS share_1 FROM g""")
def q_image_possession(T):
    lock = T["telemetry"].where("clip = 0").select(
        "match_id", F.col("n").alias("frame"), "locked", (F.col("ball_x") / 2560.0).alias("u"),
        ((F.col("ball_ym") + 720.0) / 2560.0).alias("v"))
    dets = T["dets"].select("match_id", "frame", "det_id", "x1", "x2", "y2", (F.col("det_id") % 2).alias("team"))
    return _six(J.image_possession(lock, dets), "share_0", "share_1")


def _clips(T):
    """Telemetry of both clips, each under a match number of its own, as in ``pan_rate``."""
    return T["telemetry"].withColumn("match_id", F.expr("match_id * 2 + clip"))


def _of_clips(df, *cols):
    return df.select(F.expr("cast(floor(match_id / 2) as bigint)").alias("match_id"), (F.col("match_id") % 2).alias("clip"), *cols)


@query("asof_telemetry_clips", """WITH tl AS (SELECT match_id, clip, time_s, yaw, ball_x, locked FROM telemetry),
b AS (SELECT c.match_id, c.clip, b.frame, b.t FROM ball b JOIN (SELECT DISTINCT match_id, clip FROM tl) c ON c.match_id = b.match_id),
p AS (SELECT b.match_id, b.clip, b.frame, b.t, l.time_s AS bt, l.yaw AS by_, l.ball_x AS bb, l.locked AS bl
  FROM b ASOF LEFT JOIN tl l ON l.match_id = b.match_id AND l.clip = b.clip AND l.time_s < b.t),
n AS (SELECT b.match_id, b.clip, b.frame, l.time_s AS nt, l.yaw AS ny, l.ball_x AS nb, l.locked AS nl
  FROM b ASOF LEFT JOIN tl l ON l.match_id = b.match_id AND l.clip = b.clip AND l.time_s >= b.t)
SELECT match_id, clip, frame, CASE WHEN e THEN by_ ELSE ny END AS yaw, CASE WHEN e THEN bb ELSE nb END AS ball_x,
  CASE WHEN e THEN bl ELSE nl END AS locked
FROM (SELECT p.*, n.ny, n.nb, n.nl, bt IS NOT NULL AND (nt IS NULL OR t - bt < nt - t) AS e
  FROM p JOIN n ON n.match_id = p.match_id AND n.clip = p.clip AND n.frame = p.frame) p""")
def q_asof_clips(T):
    tl = _clips(T)
    own = tl.select(F.expr("cast(floor(match_id / 2) as bigint)").alias("_m"), F.col("match_id").alias("_clip")).distinct()
    left = T["ball"].join(own, F.col("match_id") == F.col("_m")).select(F.col("_clip").alias("match_id"), "frame", "t")
    out = J.asof_nearest(left, tl, ["match_id"], "t", "time_s", ["yaw", "ball_x", "locked"])
    return _of_clips(out, "frame", "near.yaw", "near.ball_x", "near.locked")


@query("in_play_clips", """SELECT match_id, clip, min(n) AS start_frame, count(*) AS frames, max(n) + 1 AS end_frame FROM (
  SELECT match_id, clip, n, n - row_number() OVER (PARTITION BY match_id, clip ORDER BY n) AS g FROM telemetry
  WHERE n % 17 < 12) a GROUP BY match_id, clip, g HAVING count(*) >= 5""")
def q_in_play_clips(T):
    lock = _clips(T).select("match_id", F.col("n").alias("frame"), (F.col("n") % 17 < 12).alias("locked"))
    return _of_clips(B.in_play(lock), "start_frame", "frames", "end_frame")


@query("image_possession_clips", """WITH near AS (SELECT d.match_id, b.clip, d.frame, d.det_id % 2 AS team,
    sqrt(((x1 + x2) / 2e0 - b.ball_x / 2560e0) ** 2 + (y2 - (720e0 + b.ball_ym) / 2560e0) ** 2) AS d2,
    abs((x1 + x2) / 2e0 - b.ball_x / 2560e0) AS d1, b.ball_ym, d.det_id
  FROM dets d JOIN telemetry b ON b.match_id = d.match_id AND b.n = d.frame AND b.locked),
best AS (SELECT *, row_number() OVER (PARTITION BY match_id, clip, frame ORDER BY CASE WHEN ball_ym IS NULL THEN d1 ELSE d2 END,
    det_id) AS k FROM near),
g AS (SELECT match_id, clip, count(CASE WHEN team = 0 THEN 1 END) AS touches_0, count(CASE WHEN team = 1 THEN 1 END) AS touches_1,
  count(*) AS contested_frames FROM best WHERE k = 1 AND CASE WHEN ball_ym IS NULL THEN d1 ELSE d2 END <= 0.08e0 GROUP BY 1, 2)
SELECT *, round_even(coalesce(touches_0 / nullif(CAST(touches_0 + touches_1 AS DOUBLE), 0), 0e0), 6) AS share_0,
  round_even(coalesce(touches_1 / nullif(CAST(touches_0 + touches_1 AS DOUBLE), 0), 0e0), 6) AS share_1 FROM g""")
def q_image_possession_clips(T):
    lock = _clips(T).select("match_id", F.col("n").alias("frame"), "locked", (F.col("ball_x") / 2560.0).alias("u"),
                            ((F.col("ball_ym") + 720.0) / 2560.0).alias("v"))
    # a detection meets the ball of each clip of its match
    dets = T["dets"].select(F.explode(F.expr("array(match_id * 2, match_id * 2 + 1)")).alias("match_id"), "frame", "det_id", "x1", "x2",
                            "y2", (F.col("det_id") % 2).alias("team"))
    out = _six(J.image_possession(lock, dets), "share_0", "share_1")
    return _of_clips(out, "touches_0", "touches_1", "contested_frames", "share_0", "share_1")


@query("review_counts", """SELECT match_id, count(CASE WHEN verdict = 'true' THEN 1 END) AS confirmed,
  count(CASE WHEN verdict = 'false' THEN 1 END) AS rejected,
  count(CASE WHEN verdict NOT IN ('true', 'false') THEN 1 END) AS unreviewed FROM event_log GROUP BY 1""")
def q_review(T):
    return E.review_counts(T["event_log"])


@query("ball_status_counts", "SELECT match_id, status, count(*) AS n FROM ball GROUP BY 1, 2")
def q_status(T):
    return B.status_counts(T["ball"])


@query("event_subsets", """SELECT 'manual' AS subset, event_id FROM event_log WHERE source = 'manual'
UNION ALL SELECT 'detected', event_id FROM event_log WHERE source <> 'manual'
UNION ALL SELECT 'without_false', event_id FROM event_log WHERE source = 'manual' OR verdict <> 'false'
UNION ALL SELECT 'before', event_id FROM event_log WHERE time_s <= 600e0""")
def q_subsets(T):
    log = T["event_log"]
    parts = [E.event_subset(log, w, 600.0).select(F.lit(w).alias("subset"), "event_id")
             for w in ("manual", "detected", "without_false", "before")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


KNOWN = """
known AS (SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM event_log l WHERE l.match_id = f.match_id
  AND l.source <> 'manual' AND abs(l.time_s - f.time_s) < 1e0))"""


@query("fresh_not_recorded", f"WITH {KNOWN} SELECT match_id, event_id, time_s FROM known")
def q_unrecorded(T):
    log = T["event_log"].where("source <> 'manual'").select("match_id", "time_s")
    return J.within(T["fresh"], log, ["match_id"], "time_s", 1.0, "k").where("NOT k").select(
        "match_id", "event_id", "time_s")


GREEDY = """ord AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY time_s, event_id) AS k FROM cand),
walk AS (SELECT match_id, k, event_id, time_s, time_s AS kept_t, TRUE AS keep FROM ord WHERE k = 1
  UNION ALL SELECT o.match_id, o.k, o.event_id, o.time_s,
    CASE WHEN o.time_s - w.kept_t < 1e0 THEN w.kept_t ELSE o.time_s END, NOT (o.time_s - w.kept_t < 1e0)
  FROM walk w JOIN ord o ON o.match_id = w.match_id AND o.k = w.k + 1)"""


SPARSE_LOG = """(SELECT * FROM event_log WHERE event_id % 4 = 0 OR source = 'manual' OR time_s < 100e0)"""


@query("add_detected", f"""WITH RECURSIVE slog AS {SPARSE_LOG},
cand AS (SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM slog l WHERE l.match_id = f.match_id
  AND l.source <> 'manual' AND abs(l.time_s - f.time_s) < 1e0)), {GREEDY}
SELECT match_id, event_id, time_s FROM walk WHERE keep""")
def q_add(T):
    log = T["event_log"].where("event_id % 4 = 0 OR source = 'manual' OR time_s < 100e0")
    return E.add_detected(log, T["fresh"]).select("match_id", "event_id", "time_s")


RECON = f"""slog AS {SPARSE_LOG},
cand AS (SELECT f.* FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM slog l WHERE l.match_id = f.match_id
  AND l.source <> 'manual' AND abs(l.time_s - f.time_s) < 1e0)), {GREEDY},
al AS (SELECT match_id, event_id, time_s, source, verdict FROM slog UNION ALL
  SELECT w.match_id, w.event_id, w.time_s, 'ball', '' FROM walk w WHERE keep),
ju AS (SELECT *, source = 'manual' OR verdict = 'true' OR source <> 'ball' OR EXISTS (SELECT 1 FROM fresh f
  WHERE f.match_id = al.match_id AND abs(f.time_s - al.time_s) < 1e0) AS stay FROM al)"""


@query("reconcile_kept", f"WITH RECURSIVE {RECON} SELECT match_id, event_id, time_s, source FROM ju WHERE stay")
def q_recon(T):
    log = T["event_log"].where("event_id % 4 = 0 OR source = 'manual' OR time_s < 100e0")
    return E.reconcile(log, T["fresh"], "ball")[0].select("match_id", "event_id", "time_s", "source")


@query("event_store", f"WITH RECURSIVE {RECON} SELECT match_id, CAST(sum(CASE WHEN stay THEN 1 ELSE 0 END) AS BIGINT) AS events, round_even(sum(CASE WHEN stay THEN time_s ELSE 0 END), 3) AS time_sum FROM ju GROUP BY match_id")
def q_event_store(T):
    """The log as a store, and a scan that comes in three batches, the last with its end."""
    log = T["event_log"].where("event_id % 4 = 0 OR source = 'manual' OR time_s < 100e0")
    store = EventStore.create(log, shared_path(T.spark, "store"))
    scan = cut(T["fresh"].withColumns({"event_id": F.col("event_id") + 10_000_000, "scan_id": F.lit(1), "last": F.lit(False)}))
    ends = cut(T["event_log"].select("match_id").distinct())
    for part in range(3):
        rows = scan.where(F.col("event_id") % 3 == part)
        if part == 2:
            rows = rows.unionByName(ends.withColumns({"scan_id": F.lit(1), "last": F.lit(True)}), allowMissingColumns=True)
        store.apply(rows, part, "ball")
    return store.log().groupBy("match_id").agg(F.count(F.lit(1)).alias("events"), F.bround(F.sum("time_s"), 3).alias("time_sum"))


@query("reconcile_dropped", f"WITH RECURSIVE {RECON} SELECT match_id, event_id, time_s, source FROM ju WHERE NOT stay")
def q_recon_dropped(T):
    log = T["event_log"].where("event_id % 4 = 0 OR source = 'manual' OR time_s < 100e0")
    return E.reconcile(log, T["fresh"], "ball")[1].select("match_id", "event_id", "time_s", "source")


@query("repeated_tags", """SELECT f.match_id, f.event_id FROM (SELECT match_id, event_id, type, team, video,
    time_s + (event_id % 3) * 0.006e0 AS time_s FROM event_log) f
  WHERE EXISTS (SELECT 1 FROM event_log l WHERE l.source = 'manual' AND l.match_id = f.match_id AND l.type = f.type
    AND l.team = f.team AND l.video = f.video AND abs(l.time_s - f.time_s) < 0.01e0)""")
def q_repeated(T):
    tags = T["event_log"].withColumn("time_s", F.col("time_s") + (F.col("event_id") % 3) * 0.006)
    return E.repeated_tags(T["event_log"], tags).select("match_id", "event_id")


@query("dedupe_events", """WITH RECURSIVE ev AS (SELECT match_id, type, event_id, time_s, confidence,
    row_number() OVER (PARTITION BY match_id, type ORDER BY time_s, event_id) AS rn FROM event_log),
wk AS (SELECT match_id, type, rn, event_id, time_s AS t, confidence AS c, FALSE AS anew FROM ev WHERE rn = 1
  UNION ALL SELECT e.match_id, e.type, e.rn, CASE WHEN far OR e.confidence > c THEN e.event_id ELSE kept END,
    CASE WHEN far OR e.confidence > c THEN e.time_s ELSE t END, CASE WHEN far OR e.confidence > c THEN e.confidence ELSE c END, far
  FROM (SELECT e.*, w.event_id AS kept, w.t, w.c, e.time_s - w.t >= 3e0 AS far FROM wk w JOIN ev e
    ON e.match_id = w.match_id AND e.type = w.type AND e.rn = w.rn + 1) e)
SELECT w.match_id, w.type, w.event_id, w.t AS time_s, w.c AS confidence FROM wk w LEFT JOIN wk n
  ON n.match_id = w.match_id AND n.type = w.type AND n.rn = w.rn + 1 WHERE coalesce(n.anew, TRUE)""")
def q_dedupe(T):
    out = E.dedupe_events(T["event_log"].withColumn("frame", F.col("event_id")))
    return out.select("match_id", "type", "event_id", "time_s", "confidence")


@query("event_from_tag", """SELECT event_id, type NOT IN ('goal', 'shot', 'save', 'block', 'corner', 'penalty',
    'clearance', 'tackle', 'foul', 'substitution', 'other') AS rejected,
  90e0 + least(greatest(coalesce(time_s, 0e0), 0e0), 1000e0) AS time_s, note
FROM (SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'wink' ELSE type END AS type, time_s - 20e0 AS time_s, note
  FROM event_log) a""")
def q_tag(T):
    tags = T["event_log"].withColumns({
        "type": F.when(F.col("event_id") % 8 == 0, "wink").otherwise(F.col("type")),
        "time_s": F.col("time_s") - 20.0})
    return E.event_from_tag(tags, F.lit(90.0), F.lit(1000.0)).select("event_id", "rejected", "time_s", "note")


@query("orientation_by_half", """WITH sides AS (SELECT match_id, half, CASE WHEN m0 <= m1 THEN 1 ELSE -1 END AS a0, CASE WHEN m0 <= m1 THEN -1 ELSE 1 END AS a1
  FROM (SELECT match_id, half, avg(CASE WHEN team = 0 THEN x END) AS m0, avg(CASE WHEN team = 1 THEN x END) AS m1 FROM (
    SELECT o.match_id, o.team, CASE WHEN t >= half_s THEN 100e0 - x ELSE x END AS x, CASE WHEN start_s IS NULL OR half_s IS NULL OR end_s IS NULL THEN 0
      WHEN t >= start_s AND t < half_s THEN 1 WHEN t >= half_s AND t < end_s THEN 2 END AS half
    FROM obs o LEFT JOIN marks m ON m.match_id = o.match_id WHERE team IN (0, 1)) a WHERE half IS NOT NULL GROUP BY 1, 2) b),
first AS (SELECT match_id, arg_min(a0, half) AS f0, arg_min(a1, half) AS f1 FROM sides GROUP BY 1),
po AS (SELECT e.match_id, event_id, CASE WHEN m.match_id IS NULL OR start_s IS NULL OR end_s IS NULL OR half_s IS NULL THEN 0 WHEN time_s < half_s THEN 1 ELSE 2 END AS half
  FROM event_log e LEFT JOIN marks m ON m.match_id = e.match_id)
SELECT po.match_id, event_id, CAST(coalesce(a0, f0) AS BIGINT) AS attack_0, CAST(coalesce(a1, f1) AS BIGINT) AS attack_1 FROM po
LEFT JOIN sides ON sides.match_id = po.match_id AND sides.half = po.half LEFT JOIN first ON first.match_id = po.match_id""")
def q_orientation_by_half(T):
    # teams change ends at half-time
    half = T["marks"].select("match_id", "half_s")
    turned = T["obs"].join(half, "match_id", "left").withColumn("x", F.when(F.col("t") >= F.col("half_s"), 100.0 - F.col("x")).otherwise(F.col("x"))).drop("half_s")
    out = E.orientation_at(T["event_log"], M.orientations(turned, T["marks"]), T["marks"], "time_s")
    return out.select("match_id", "event_id", F.col("attack_0").cast("long").alias("attack_0"), F.col("attack_1").cast("long").alias("attack_1"))
