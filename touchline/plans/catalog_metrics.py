"""Queries on speed, momentum, roles, sides and player tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .registry import query
from .views import PITCH

L, W = PITCH

SPEED_CTE = """
sp AS (SELECT *, CASE WHEN gap <= 1e0 AND step > greatest(0.35e0, noise)
    THEN least(greatest(step / greatest(gap, 1e-3) * 3.6e0, 0e0), 36e0) ELSE 0e0 END AS speed_kmh,
    CASE WHEN gap <= 1e0 THEN step END AS step_m
  FROM (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS step, t - pt AS gap,
      sqrt(sigma_m * sigma_m + ps * ps) AS noise
    FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(t) OVER w AS pt, lag(sigma_m) OVER w AS ps
      FROM obs WINDOW w AS (PARTITION BY match_id, track_id ORDER BY t)) a) b)"""
TRACK_CTE = SPEED_CTE + """,
tr AS (SELECT match_id, track_id, min(team) AS team, count(*) AS n, min(t) AS first_t, max(t) AS last_t,
    coalesce(sum(CASE WHEN speed_kmh > 0 THEN step_m END), 0e0) AS distance_m, max(speed_kmh) AS top,
    coalesce(sum(CASE WHEN speed_kmh > 0.5e0 THEN speed_kmh END), 0e0) AS ms,
    count(CASE WHEN speed_kmh > 0.5e0 THEN 1 END) AS mn, count(CASE WHEN speed_kmh > 1e0 THEN 1 END) AS walking,
    sum(x) AS sx, sum(y) AS sy, max(x) - min(x) AS ex, max(y) - min(y) AS ey
  FROM sp GROUP BY match_id, track_id HAVING count(*) >= 8)"""
MOMENTUM_CTE = """
fr AS (SELECT match_id, frame, t, aim_x, team, d FROM (
    SELECT o.match_id, o.frame, o.t, a.aim_x, o.team,
      sqrt((o.x - a.aim_x) * (o.x - a.aim_x) + (o.y - a.aim_y) * (o.y - a.aim_y)) AS d,
      row_number() OVER (PARTITION BY o.match_id, o.frame ORDER BY CASE WHEN team >= 0 THEN 0 ELSE 1 END,
        sqrt((o.x - a.aim_x) * (o.x - a.aim_x) + (o.y - a.aim_y) * (o.y - a.aim_y)), o.det_id) AS k
    FROM obs o JOIN aim a ON o.match_id = a.match_id AND o.frame = a.frame WHERE a.aim_x IS NOT NULL) q WHERE k = 1),
mo AS (SELECT match_id, minute, w0, w1, un, ax FROM (
    SELECT match_id, CAST(floor(t / 60e0) AS BIGINT) AS minute,
      count(CASE WHEN team = 0 AND d <= 12e0 THEN 1 END) AS w0, count(CASE WHEN team = 1 AND d <= 12e0 THEN 1 END) AS w1,
      count(CASE WHEN NOT (team >= 0 AND d <= 12e0) THEN 1 END) AS un, avg(aim_x) AS ax
    FROM fr GROUP BY 1, 2) z WHERE w0 + w1 > 0)"""


def one_mark(T):
    """The marks of a match, one row each: of several, the one with the latest kick-off."""
    latest = F.max(F.struct("start_s", "half_s", "end_s"))
    return T["marks"].groupBy("match_id").agg(latest.alias("m")).select("match_id", "m.*")


@query("momentum", f"""WITH {MOMENTUM_CTE}
SELECT match_id, minute, round_even(w0 / CAST(w0 + w1 AS DOUBLE), 3) AS team_0,
  round_even(1e0 - w0 / CAST(w0 + w1 AS DOUBLE), 3) AS team_1, round_even(ax, 1) AS action_x,
  w0 + w1 AS contested_frames, un AS uncontested_frames FROM mo""")
def q_momentum(T):
    return M.momentum(T["obs"], T["aim"])


@query("nearest_to_aim", f"""WITH {MOMENTUM_CTE}
SELECT match_id, frame, CASE WHEN team >= 0 THEN team END AS team,
  CASE WHEN team >= 0 THEN round_even(d, 6) END AS distance_m FROM fr""")
def q_nearest_to_aim(T):
    return M.nearest_to_aim(T["obs"], T["aim"]).select(
        "match_id", "frame", F.col("best.team").alias("team"), F.bround("best.d", 6).alias("distance_m"))


@query("momentum_on_window_clock", f"""WITH {MOMENTUM_CTE}
SELECT match_id, round_even(minute - 90e0 / 60e0, 4) AS minute, round_even(w0 / CAST(w0 + w1 AS DOUBLE), 3) AS team_0
FROM mo""")
def q_momentum_window(T):
    return M.momentum_on_window(M.momentum(T["obs"], T["aim"]), 90.0).select("match_id", "minute", "team_0")


@query("speeds", f"""WITH {SPEED_CTE}
SELECT match_id, track_id, frame, round_even(speed_kmh, 6) AS speed_kmh FROM sp""")
def q_speeds(T):
    return M.speeds(T["obs"]).select("match_id", "track_id", "frame", F.bround("speed_kmh", 6).alias("speed_kmh"))


@query("build_tracks", f"""WITH {TRACK_CTE}
SELECT match_id, track_id, team, n AS observations, round_even(distance_m, 6) AS distance_m,
  round_even(top, 6) AS top_speed_kmh FROM tr""")
def q_tracks(T):
    return M.build_tracks(M.speeds(T["obs"])).select(
        "match_id", "track_id", "team", "observations", F.bround("distance_m", 6).alias("distance_m"),
        F.bround("top_speed_kmh", 6).alias("top_speed_kmh"))


@query("team_metrics", f"""WITH {TRACK_CTE}, {MOMENTUM_CTE},
sh AS (SELECT match_id, avg(round_even(w0 / CAST(w0 + w1 AS DOUBLE), 3)) AS share FROM mo GROUP BY 1)
SELECT t.match_id, t.team, t.players AS players_observed, round_even(t.dist, 1) AS distance_m,
  round_even(CASE WHEN mn > 0 THEN top ELSE 0e0 END, 1) AS top_speed_kmh,
  round_even(coalesce(ms / nullif(mn, 0), 0e0), 1) AS mean_speed_kmh, round_even(mx, 3) AS mean_x_fraction,
  round_even(CASE WHEN team = 0 THEN coalesce(share, 0e0) ELSE coalesce(1e0 - share, 0e0) END, 3) AS possession_share
FROM (SELECT match_id, CAST(team AS BIGINT) AS team, count(*) AS players, sum(distance_m) AS dist, max(top) AS top,
    sum(ms) AS ms, CAST(sum(mn) AS DOUBLE) AS mn, sum(sx) / sum(n) / 100e0 AS mx
  FROM tr WHERE team IN (0, 1) GROUP BY 1, 2) t LEFT JOIN sh ON sh.match_id = t.match_id""")
def q_team_metrics(T):
    return M.team_metrics(M.build_tracks(M.speeds(T["obs"])), M.momentum(T["obs"], T["aim"]), L)


@query("detection_rate", """
SELECT match_id, round_even(CASE WHEN dt > 1e-6 THEN 1e0 / dt ELSE 5e0 END, 6) AS rate FROM (
  SELECT match_id, quantile_cont(t - pt, 0.5) AS dt FROM (
    SELECT match_id, t, lag(t) OVER (PARTITION BY match_id ORDER BY t) AS pt FROM (SELECT DISTINCT match_id, t FROM obs) a
  ) b GROUP BY 1) c""")
def q_rate(T):
    return M.sampling_rate(T["obs"]).select("match_id", F.bround("rate", 6).alias("rate"))


@query("bystanders", f"""WITH {TRACK_CTE}
SELECT match_id, track_id FROM tr WHERE n >= 2 AND last_t - first_t >= 10e0 AND
  (sqrt(ex * ex + ey * ey) < 8e0 OR (sqrt(ex * ex + ey * ey) < 15e0 AND walking / CAST(n AS DOUBLE) < 0.05e0))""")
def q_bystanders(T):
    return M.bystanders(M.build_tracks(M.speeds(T["obs"]))).select("match_id", "track_id")


PLAYER_SQL = f"""WITH {TRACK_CTE},
keep AS (SELECT * FROM tr WHERE NOT (last_t - first_t >= 10e0 AND
  (sqrt(ex * ex + ey * ey) < 8e0 OR (sqrt(ex * ex + ey * ey) < 15e0 AND walking / CAST(n AS DOUBLE) < 0.05e0)))),
tc AS (SELECT match_id, track_id, count(*) AS touches FROM (
    SELECT o.match_id, o.frame, o.track_id, row_number() OVER (PARTITION BY o.match_id, o.frame ORDER BY
      sqrt((o.x - round_even(aim_x, 1)) ** 2 + (o.y - round_even(aim_y, 1)) ** 2), o.track_id DESC) AS k
    FROM obs o JOIN aim a ON o.match_id = a.match_id AND o.frame = a.frame
      JOIN keep p ON p.match_id = o.match_id AND p.track_id = o.track_id
    WHERE aim_x IS NOT NULL
      AND sqrt((o.x - round_even(aim_x, 1)) ** 2 + (o.y - round_even(aim_y, 1)) ** 2) <= 12e0) z
  WHERE k = 1 GROUP BY 1, 2)
SELECT p.match_id, p.track_id, CAST(team AS BIGINT) AS team, n AS observations, round_even(n / 5e0, 1) AS time_s,
  round_even(first_t, 1) AS first_t, round_even(last_t, 1) AS last_t, round_even(distance_m, 1) AS distance_m,
  round_even(top, 1) AS top_speed_kmh, round_even(coalesce(ms / nullif(mn, 0), 0e0), 1) AS mean_speed_kmh,
  round_even(sx / n, 1) AS mean_x, round_even(sy / n, 1) AS mean_y, coalesce(touches, 0) AS touches
FROM keep p LEFT JOIN tc ON tc.match_id = p.match_id AND tc.track_id = p.track_id"""


@query("player_stats", PLAYER_SQL)
def q_player_stats(T):
    return M.player_stats(M.speeds(T["obs"]), T["aim"], 5.0)


@query("player_table", "WITH ps AS (" + PLAYER_SQL + """)
SELECT ps.match_id, ps.track_id, CASE WHEN ps.team < 0 THEN 'referee/other' WHEN ps.team = 0 THEN 'Reds' ELSE 'Team 2' END AS team,
  p.number, coalesce(p.name, '') AS name, CASE WHEN p.track_id IS NULL THEN 'unassigned' ELSE 'auto' END AS source, time_s, touches
FROM ps LEFT JOIN people p ON p.match_id = ps.match_id AND p.track_id = ps.track_id""")
def q_player_table(T):
    stats = M.player_stats(M.speeds(T["obs"]), T["aim"], 5.0)
    names = T["obs"].select("match_id").distinct().select("match_id", F.lit(0).cast("long").alias("team"), F.lit(" Reds ").alias("name"))
    out = M.player_table(stats, T["people"].withColumn("source", F.lit("auto")), names)
    return out.select("match_id", "track_id", "team", "number", "name", "source", "time_s", "touches")


@query("roles", """WITH st AS (
  SELECT match_id, track_id, min(team) AS team, count(*) AS n, avg(CASE WHEN x < 12e0 THEN 1e0 ELSE 0e0 END) AS lf,
    avg(CASE WHEN x > 88e0 THEN 1e0 ELSE 0e0 END) AS rt, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS span
  FROM obs GROUP BY 1, 2),
rf AS (SELECT match_id, track_id, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, track_id) AS k FROM st
  WHERE NOT (n >= 60 AND greatest(lf, rt) >= 0.9e0) AND n >= 150 AND team = -1 AND span >= 18e0)
SELECT match_id, track_id, 'goalkeeper' AS role, CASE WHEN lf >= rt THEN 'left' ELSE 'right' END AS side FROM st
WHERE n >= 60 AND greatest(lf, rt) >= 0.9e0
UNION ALL SELECT match_id, track_id, 'referee', NULL FROM rf WHERE k = 1""")
def q_roles(T):
    return M.classify_roles(T["obs"], L)


@query("orientations", """SELECT match_id, half, round_even(m0, 6) AS mean_x_0, round_even(m1, 6) AS mean_x_1,
  CAST(CASE WHEN m0 IS NULL OR m1 IS NULL THEN NULL WHEN m0 <= m1 THEN 1 ELSE -1 END AS BIGINT) AS attack_0,
  CAST(CASE WHEN m0 IS NULL OR m1 IS NULL THEN NULL WHEN m0 <= m1 THEN -1 ELSE 1 END AS BIGINT) AS attack_1
FROM (SELECT match_id, half, avg(CASE WHEN team = 0 THEN x END) AS m0, avg(CASE WHEN team = 1 THEN x END) AS m1 FROM (
    SELECT o.match_id, o.team, o.x, CAST(CASE WHEN start_s IS NULL OR half_s IS NULL OR end_s IS NULL THEN 0
      WHEN t >= start_s AND t < half_s THEN 1 WHEN t >= half_s AND t < end_s THEN 2 END AS BIGINT) AS half
    FROM obs o LEFT JOIN marks m ON m.match_id = o.match_id WHERE team IN (0, 1)) a
  WHERE half IS NOT NULL GROUP BY 1, 2) b""")
def q_orientations(T):
    out = M.orientations(T["obs"], T["marks"])
    return out.withColumns({c: F.bround(c, 6) for c in ("mean_x_0", "mean_x_1")})


@query("heat_map", """SELECT match_id, CAST(floor(x / 5e0) AS BIGINT) AS cell_x, CAST(floor(y / 5e0) AS BIGINT) AS cell_y,
  count(*) AS n FROM obs GROUP BY 1, 2, 3""")
def q_heat_map(T):
    return M.heat_map(T["obs"], 5.0)


@query("heat_map_by_player", """SELECT match_id, track_id, CAST(floor(x / 5e0) AS BIGINT) AS cell_x,
  CAST(floor(y / 5e0) AS BIGINT) AS cell_y, count(*) AS n FROM obs GROUP BY 1, 2, 3, 4""")
def q_heat_map_player(T):
    return M.heat_map(T["obs"], 5.0, "track_id")


@query("on_pitch", """SELECT match_id, count(*) AS n, round_even(sum(x), 6) AS sum_x FROM (
  SELECT *, 1.5e0 + least(sigma_m, 4e0) AS s, x * 1.2e0 - 8e0 AS px FROM obs) a
WHERE px >= -s AND px <= 100e0 + s AND y >= -s AND y <= 64e0 + s GROUP BY 1""")
def q_on_pitch(T):
    moved = T["obs"].withColumn("x0", F.col("x")).withColumn("x", F.col("x") * 1.2 - 8.0)
    return M.on_pitch(moved, L, W).groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.sum("x0"), 6).alias("sum_x"))
