"""Queries on clips, clocks, labels, telemetry text, reports and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as N
from ..operators import events as E
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import teams as TM
from ..session import shared_path
from ..sources import clips as C
from ..sources import reports as R
from ..sources import segments as S
from ..sources import telemetry as TL
from .catalog_metrics import MOMENTUM_CTE
from .registry import query
from .views import PITCH

L, W = PITCH

PLAN = """pc AS (SELECT *, sum(duration_s) OVER w - duration_s AS start_s, row_number() OVER w AS clip_no FROM clips
  WINDOW w AS (PARTITION BY match_id ORDER BY path ROWS UNBOUNDED PRECEDING))"""


def _planned(T):
    doubled = T["clips"].unionByName(T["clips"].where("duration_s > 63"))
    return C.plan_clips(doubled)


@query("plan_clips", f"WITH {PLAN} SELECT match_id, path, start_s, duration_s, clip_no FROM pc")
def q_plan(T):
    return _planned(T).select("match_id", "path", "start_s", "duration_s", "clip_no")


@query("check_clips", f"""WITH {PLAN}, j AS (SELECT p.match_id, p.clip_no, list_filter([
    CASE WHEN p.codec <> f.codec THEN 'codec ' || p.codec || ' vs ' || f.codec END,
    CASE WHEN p.width <> f.width OR p.height <> f.height THEN 'frame ' || p.width || 'x' || p.height || ' vs ' || f.width || 'x' || f.height END,
    CASE WHEN abs(p.fps - f.fps) > 0.01e0 THEN printf('%.2f', p.fps) || ' fps vs ' || printf('%.2f', f.fps) || ' fps' END,
    CASE WHEN p.has_audio <> f.has_audio THEN 'one has audio and the other does not' END], lambda z: z IS NOT NULL) AS why
  FROM pc p JOIN pc f ON f.match_id = p.match_id AND f.clip_no = 1 WHERE p.clip_no > 1)
SELECT match_id, 'clip ' || arg_min(clip_no, clip_no) || ' does not match clip 1 (' || arg_min(array_to_string(why, ', '), clip_no)
  || ')' AS problem FROM j WHERE len(why) > 0 GROUP BY 1""")
def q_check(T):
    return C.check_clips(_planned(T))


TIMED = """(SELECT match_id, event_id, time_s % 50 AS time_s, CASE WHEN event_id % 4 = 0 THEN 'game' WHEN event_id % 4 = 3
  THEN 'elsewhere' ELSE 'clip-' || CAST(100 + event_id % 10 AS VARCHAR) END AS video FROM event_log)"""


def _timed(T):
    video = F.when(F.col("event_id") % 4 == 0, "game").when(F.col("event_id") % 4 == 3, "elsewhere").otherwise(
        F.concat(F.lit("clip-"), (F.col("event_id") % 10 + 100).cast("string")))
    return T["event_log"].select("match_id", "event_id", (F.col("time_s") % 50).alias("time_s"), video.alias("video"))


GAME = f"""{PLAN}, ev AS {TIMED},
gm AS (SELECT e.match_id, e.event_id, CASE WHEN e.video = 'game' THEN e.time_s ELSE e.time_s + p.start_s END AS game_s, m.start_s,
    m.half_s, m.end_s FROM ev e LEFT JOIN pc p ON p.match_id = e.match_id AND p.path = e.video LEFT JOIN marks m ON m.match_id = e.match_id),
gh AS (SELECT match_id, event_id, game_s, CAST(CASE WHEN half_s IS NOT NULL AND game_s >= start_s AND game_s <= end_s THEN
    CASE WHEN game_s < half_s THEN 1 ELSE 2 END END AS BIGINT) AS half FROM gm)"""


@query("game_time", f"""WITH {GAME} SELECT match_id, event_id, round_even(game_s, 6) AS game_s, half, CASE half WHEN 1 THEN '1st half'
  WHEN 2 THEN '2nd half' ELSE '-' END AS half_label FROM gh""")
def q_game_time(T):
    out = C.game_time(_timed(T), _planned(T), T["marks"])
    return out.select("match_id", "event_id", F.bround("game_s", 6).alias("game_s"), "half", "half_label")


@query("half_window", """SELECT match_id, 'Whole game' AS "window", start_s AS from_s, end_s AS to_s FROM marks WHERE start_s IS NOT NULL
UNION ALL SELECT match_id, 'First half', start_s, half_s FROM marks WHERE start_s IS NOT NULL
UNION ALL SELECT match_id, 'Second half', half_s, end_s FROM marks WHERE start_s IS NOT NULL""")
def q_windows(T):
    return C.half_window(T["marks"])


@query("mark_problem", """SELECT match_id, CASE WHEN start_s IS NULL THEN 'not marked yet: kick-off' WHEN NOT (start_s < half_s AND half_s < end_s)
  THEN 'kick-off, half-time and full-time do not follow each other' WHEN end_s > duration_s + 1e0 THEN 'full-time is marked later than the video runs' END AS problem,
  greatest(0e0, least(end_s, duration_s)) AS end_s FROM marks""")
def q_marks(T):
    why = N.mark_problem(*[F.col(c) for c in ("start_s", "half_s", "end_s", "duration_s")])
    return T["marks"].select("match_id", why.alias("problem"), F.greatest(F.lit(0.0), F.least("end_s", "duration_s")).alias("end_s"))


@query("window_pieces", f"""WITH {PLAN}, w AS (SELECT match_id, event_id, (event_id % 700) * 1e0 - 10e0 AS ws, (event_id % 700) * 1e0 + (event_id % 90) AS we
  FROM event_log)
SELECT w.match_id, event_id, path, round_even(greatest(ws, 0e0, start_s) - start_s, 6) AS start_s,
  round_even(least(we, start_s + duration_s) - greatest(ws, 0e0, start_s), 6) AS duration_s
FROM w JOIN pc ON pc.match_id = w.match_id AND least(we, start_s + duration_s) > greatest(ws, 0e0, start_s)""")
def q_pieces(T):
    w = T["event_log"].select("match_id", "event_id", (F.col("event_id") % 700 - 10.0).alias("start_s"),
                              (F.col("event_id") % 700 + F.col("event_id") % 90).cast("double").alias("end_s"))
    out = J.window_pieces(w, _planned(T), ["event_id"])
    return out.withColumns({c: F.bround(c, 6) for c in ("start_s", "duration_s")})


@query("clip_at", f"""WITH {PLAN}, tt AS (SELECT match_id, sum(duration_s) AS total FROM clips GROUP BY 1),
p AS (SELECT e.match_id, e.event_id, greatest(0e0, least(time_s - 5e0, total)) AS a FROM event_log e JOIN tt ON tt.match_id = e.match_id)
SELECT match_id, event_id, path AS clip, round_even(a - start_s, 6) AS clip_t FROM (SELECT p.*, c.path, c.start_s, row_number() OVER
  (PARTITION BY p.match_id, event_id ORDER BY c.start_s DESC) AS k FROM p JOIN pc c ON c.match_id = p.match_id AND c.start_s <= p.a) z WHERE k = 1""")
def q_clip_at(T):
    pts = T["event_log"].select("match_id", "event_id", (F.col("time_s") - 5.0).alias("time_s"))
    out = J.clip_at(pts, _planned(T))
    return out.select("match_id", "event_id", "clip", F.bround("clip_t", 6).alias("clip_t"))


@query("nearest_frame", """SELECT e.match_id, event_id, CAST(greatest(0, least(1999, ceil(time_s * 5e0 - 0.5e0))) AS BIGINT) AS frame
FROM event_log e""")
def q_nearest_frame(T):
    return T["event_log"].select("match_id", "event_id", N.nearest_frame(F.col("time_s"), 0.0, 5.0, 2000).alias("frame"))


@query("event_play", """SELECT event_id, CASE WHEN type IN ('goal', 'shot', 'corner', 'penalty') THEN 'attacking'
  WHEN type IN ('clearance', 'tackle', 'save', 'block') THEN 'defensive' ELSE '' END AS play,
  CASE WHEN team < 0 THEN 'toward the left goal' WHEN team > 0 THEN 'toward the right goal' ELSE '' END AS aim FROM event_log""")
def q_play(T):
    return T["event_log"].select("event_id", N.event_play(F.col("type")).alias("play"), N.aiming_goal(F.col("team")).alias("aim"))


@query("team_name", """SELECT c_custkey, CASE WHEN team < 0 THEN 'referee/other' WHEN trim(nm) <> '' THEN trim(nm) ELSE 'Team ' || (team + 1) END
  AS label, lower(trim(nm)) IN ('', 'team a', 'team b', 'team 1', 'team 2') AS placeholder
FROM (SELECT c_custkey, c_custkey % 4 - 1 AS team, CASE c_custkey % 3 WHEN 0 THEN ' ' || c_mktsegment WHEN 1 THEN ' ' ELSE 'Team A ' END AS nm FROM customer) a""")
def q_team(T):
    nm = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).when(F.col("c_custkey") % 3 == 1, " ").otherwise("Team A ")
    rows = T["customer"].select("c_custkey", (F.col("c_custkey") % 4 - 1).alias("team"), nm.alias("nm"))
    return rows.select("c_custkey", N.team_name(F.col("team"), F.col("nm")).alias("label"), N.is_default_team_name(F.col("nm")).alias("placeholder"))


RGB = "p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 13 % 256 AS b"


@query("color_name", f"""WITH c AS (SELECT p_partkey, {RGB} FROM part), v AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM c),
h AS (SELECT *, CASE WHEN mx = 0 THEN 0e0 ELSE round_even((mx - mn) * 255e0 / mx, 0) END AS sat, CASE WHEN mx = mn THEN 0e0
    WHEN mx = r THEN (g - b) * 60e0 / (mx - mn) WHEN mx = g THEN (b - r) * 60e0 / (mx - mn) + 120e0
    ELSE (r - g) * 60e0 / (mx - mn) + 240e0 END AS deg FROM v),
u AS (SELECT *, CAST(round_even(CASE WHEN deg < 0 THEN deg + 360e0 ELSE deg END / 2e0, 0) AS BIGINT) % 180 AS hue FROM h),
n AS (SELECT *, CASE WHEN hue < 10 THEN 'red' WHEN hue < 22 THEN 'orange' WHEN hue < 33 THEN 'yellow' WHEN hue < 85 THEN 'green'
    WHEN hue < 100 THEN 'teal' WHEN hue < 126 THEN 'blue' WHEN hue < 151 THEN 'purple' WHEN hue < 170 THEN 'pink' ELSE 'red' END AS base FROM u),
w AS (SELECT *, CASE WHEN sat < 40 THEN CASE WHEN mx >= 215 THEN 'white' WHEN mx >= 160 THEN 'light gray' WHEN mx >= 90 THEN 'gray' ELSE 'black' END
    WHEN mx < 110 THEN 'dark ' || base WHEN mx > 215 AND sat < 120 THEN 'light ' || base ELSE base END AS name FROM n)
SELECT p_partkey, name, upper(name[1]) || name[2:] || 's' AS team, printf('#%02x%02x%02x', r, g, b) AS hex FROM w""")
def q_color(T):
    rows = T["part"].selectExpr("p_partkey", *RGB.split(", "))
    rgb = [F.col(c) for c in ("r", "g", "b")]
    rows = N.with_color_name(rows, *rgb, out="name").withColumn("hex", N.color_hex(*rgb))
    return rows.select("p_partkey", "name", N.suggest_team_name(F.col("name")).alias("team"), "hex")


@query("kit_rgb", """WITH q AS (SELECT match_id, frame, det_id, floor(least(greatest(kit_l * 255e0, 0e0), 255e0)) * (100e0 / 255e0) AS l,
    floor(least(greatest(kit_a * 255e0, 0e0), 255e0)) - 128e0 AS a, floor(least(greatest(kit_b * 255e0, 0e0), 255e0)) - 128e0 AS b FROM dets),
f AS (SELECT *, (l + 16e0) / 116e0 AS fy, (l + 16e0) / 116e0 + a / 500e0 AS fx, (l + 16e0) / 116e0 - b / 200e0 AS fz FROM q),
x AS (SELECT *, CASE WHEN fx > 6e0 / 29e0 THEN fx * fx * fx ELSE (fx - 16e0 / 116e0) / 7.787e0 END * 0.950456e0 AS xx,
    CASE WHEN l > 7.9996248e0 THEN fy * fy * fy ELSE l / 903.3e0 END AS yy,
    CASE WHEN fz > 6e0 / 29e0 THEN fz * fz * fz ELSE (fz - 16e0 / 116e0) / 7.787e0 END * 1.088754e0 AS zz FROM f),
c AS (SELECT match_id, frame, det_id, unnest([0, 1, 2]) AS k, unnest([xx * 3.240479e0 - yy * 1.53715e0 - zz * 0.498535e0,
    yy * 1.875991e0 - xx * 0.969256e0 + zz * 0.041556e0, xx * 0.055648e0 - yy * 0.204043e0 + zz * 1.057311e0]) AS v FROM x),
g AS (SELECT match_id, frame, det_id, k, CAST(round_even(least(greatest(CASE WHEN v <= 0.0031308e0 THEN v * 12.92e0
    ELSE pow(greatest(v, 0e0), 1e0 / 2.4e0) * 1.055e0 - 0.055e0 END, 0e0), 1e0) * 255e0, 0) AS BIGINT) AS w FROM c)
SELECT match_id, frame, det_id, max(CASE WHEN k = 0 THEN w END) AS r, max(CASE WHEN k = 1 THEN w END) AS g,
  max(CASE WHEN k = 2 THEN w END) AS b FROM g GROUP BY 1, 2, 3""")
def q_kit(T):
    return N.with_kit_rgb(T["dets"], F.col("kit_l"), F.col("kit_a"), F.col("kit_b")).select("match_id", "frame", "det_id", "r", "g", "b")


@query("upgrade_labels", """SELECT pid, CASE label WHEN 'centre circle near' THEN 'center circle near' ELSE label END AS label FROM clicks""")
def q_upgrade(T):
    old = R.upgrade_columns(T["clicks"].withColumnRenamed("label", "spot_label"), {"spot_label": "label"})
    return old.select("pid", N.upgrade_label(F.col("label")).alias("label"))


@query("event_table", f"""WITH {PLAN}, o AS (SELECT match_id, half, CASE WHEN m0 <= m1 THEN 1 ELSE -1 END AS a0 FROM (
    SELECT match_id, half, avg(CASE WHEN team = 0 THEN x END) AS m0, avg(CASE WHEN team = 1 THEN x END) AS m1 FROM (SELECT o.match_id, team, x,
      CASE WHEN start_s IS NULL THEN 0 WHEN t >= start_s AND t < half_s THEN 1 WHEN t >= half_s AND t < end_s THEN 2 END AS half
      FROM obs o LEFT JOIN marks m ON m.match_id = o.match_id WHERE team IN (0, 1)) q WHERE half IS NOT NULL GROUP BY 1, 2) z),
g AS (SELECT e.*, m.start_s, m.half_s, CAST(CASE WHEN half_s IS NOT NULL AND time_s >= start_s AND time_s <= end_s THEN CASE WHEN time_s < half_s THEN 1
    ELSE 2 END END AS BIGINT) AS half, CASE WHEN type IN ('goal', 'shot', 'corner', 'penalty') THEN 'attacking'
    WHEN type IN ('clearance', 'tackle', 'save', 'block') THEN 'defensive' ELSE '' END AS play
  FROM (SELECT * REPLACE (CASE WHEN video = 'game' THEN time_s END AS time_s), time_s AS raw_s FROM event_log) e
    LEFT JOIN marks m ON m.match_id = e.match_id)
SELECT g.event_id, play, CASE g.half WHEN 1 THEN '1st half' WHEN 2 THEN '2nd half' ELSE '-' END AS half,
  round_even(CASE g.half WHEN 1 THEN time_s - start_s WHEN 2 THEN time_s - half_s END, 6) AS match_clock,
  CASE WHEN play = 'attacking' AND team IN (0, 1) AND a0 IS NOT NULL THEN CASE WHEN (a0 > 0) = (team = 0) THEN 'toward the right goal'
    ELSE 'toward the left goal' END ELSE '' END AS aim FROM g LEFT JOIN o ON o.match_id = g.match_id AND o.half = g.half""")
def q_event_table(T):
    out = E.event_table(T["event_log"], _planned(T), T["marks"], M.orientations(T["obs"], T["marks"]))
    return out.select("event_id", "play", "half", F.bround("match_clock", 6).alias("match_clock"), "aim")


@query("leading_chunks", """SELECT match_id, segment_id, chunk, first_frame FROM (SELECT *, row_number() OVER w - 1 AS k,
    CAST(sum(n_frames) OVER (w ROWS UNBOUNDED PRECEDING) - n_frames AS BIGINT) AS first_frame FROM (
    SELECT CAST(floor(c_custkey / 100e0) AS BIGINT) AS match_id, CAST(floor(c_custkey / 50e0) AS BIGINT) % 2 AS segment_id, c_custkey % 50 AS chunk,
      250 + c_custkey % 50 AS n_frames FROM customer WHERE (c_custkey * 7919) % 41 <> 3) a WINDOW w AS (PARTITION BY match_id, segment_id ORDER BY chunk)) b
  WHERE k = chunk""")
def q_chunks(T):
    rows = T["customer"].where("(c_custkey * 7919) % 41 <> 3").selectExpr(
        "cast(floor(c_custkey / 100e0) as bigint) match_id", "cast(floor(c_custkey / 50e0) as bigint) % 2 segment_id", "c_custkey % 50 chunk",
        "250 + c_custkey % 50 n_frames")
    return S.leading_chunks(rows).select("match_id", "segment_id", "chunk", "first_frame")


def _log_lines(T):
    """The telemetry view written out as log text, a few lines per frame; some lines are split in two."""
    t = T["telemetry"].withColumn("path", F.concat_ws("/", "match_id", "clip"))
    stamp = F.date_format(F.timestamp_millis(F.lit(1_700_000_000_000) + (F.col("n") * 210).cast("long")), "yyyy-MM-dd HH:mm:ss.SSS")
    motion = F.when(F.col("yaw").isNotNull(), F.format_string("Frame%d fps30 SZ7 Yaw%.1f Pit-3.5", "n", "yaw"))
    fin = F.format_string("Frame%d FIN:x10 y20 V1 YawErr2 out3 Ctrl:X4 Y5 zoomSz%d In:1 Lock:%d/3", "n", F.col("n") % 9, F.col("locked").cast("int"))
    size = F.format_string("BallSz%d StaX1 Ballx%d OutX2", F.col("n") % 20, F.col("ball_x").cast("int"))
    track = F.when(F.col("ball_ym").isNotNull(), F.format_string("T1 RB2 xv3 yv-4 xm5 ym%d", F.col("ball_ym").cast("int")))
    cutting = F.col("n") % 10 == 7
    parts = F.array(stamp, motion, F.when(cutting, F.substring(fin, 1, 20)).otherwise(fin), F.when(cutting, F.substring(fin, 21, 200)),
                    size, track, F.when(F.col("n") % 50 == 9, F.lit("garbage line")))
    return t.select("path", "n", F.posexplode(parts).alias("i", "line")).where(F.col("line").isNotNull()).select(
        "path", (F.col("n") * 10 + F.col("i")).alias("pos"), "line")


PARSED = """SELECT match_id || '/' || clip AS path, n AS frame, round_even((n * 210 - f * 210) / 1000e0, 6) AS time_s,
  yaw AS yaw_deg, CASE WHEN yaw IS NOT NULL THEN 7 END AS zoom_sz, CAST(n % 9 AS INTEGER) AS fin_zoom_sz, CAST(n % 20 AS INTEGER) AS ball_sz,
  ball_x, ball_ym, locked FROM (SELECT *, min(n) OVER (PARTITION BY match_id, clip) AS f FROM telemetry) a"""


@query("parse_telemetry", PARSED)
def q_parse(T):
    return _frames(TL.parse_lines(_log_lines(T))[0])


def _frames(frames):
    return frames.select("path", "frame", F.bround("time_s", 6).alias("time_s"), "yaw_deg", "zoom_sz", "fin_zoom_sz", "ball_sz", "ball_x",
                         "ball_ym", "locked")


@query("telemetry_files", PARSED)
def q_telemetry_files(T):
    """The log text in files, one for each clip as its controller writes it, read back by byte range."""
    folder = shared_path(T.spark, "logs")
    names = F.split("path", "/")
    lines = _log_lines(T).select(names[0].alias("match"), names[1].alias("clip"), "pos", "line")
    lines.repartition("match", "clip").sortWithinPartitions("match", "clip", "pos").select("match", "clip", "line").write.partitionBy(
        "match", "clip").text(folder)
    frames, _ = TL.read_telemetry(T.spark, folder, 1 << 18, 8 << 20)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    return _frames(frames.withColumn("path", F.concat_ws("/", part("match"), part("clip"))))


@query("unknown_lines", """SELECT match_id || '/' || clip AS path, count(CASE WHEN n % 50 = 9 THEN 1 END) AS unknown_lines FROM telemetry GROUP BY 1""")
def q_unknown(T):
    return TL.parse_lines(_log_lines(T))[1]


@query("merge_telemetry", """SELECT match_id, n AS frame, clip AS file_no, yaw AS yaw_deg FROM (SELECT *, row_number() OVER (
    PARTITION BY match_id, n ORDER BY CASE WHEN yaw IS NULL THEN 0 ELSE 1 END + CASE WHEN ball_ym IS NULL THEN 0 ELSE 1 END DESC, clip) AS k
  FROM telemetry) a WHERE k = 1""")
def q_merge(T):
    none = F.lit(None).cast("double")
    rows = T["telemetry"].select("match_id", F.col("n").alias("frame"), F.col("clip").alias("file_no"), F.col("yaw").alias("yaw_deg"),
                                 F.col("ball_ym").alias("pitch_deg"), *[none.alias(c) for c in TL.KEY_FIELDS[2:]])
    return TL.merge_telemetry(rows, ["match_id"]).select("match_id", "frame", "file_no", "yaw_deg")


@query("pair_logs", """WITH c AS (SELECT match_id, path, printf('%02d:%02d:00', n // 6, n % 6 * 10) AS ck FROM (SELECT match_id, path,
    CAST(substr(path, 6) AS BIGINT) - 100 + match_id % 3 AS n FROM clips) a), l AS (SELECT DISTINCT match_id,
    'log_' || ck || '.json' AS log, ck FROM c WHERE match_id % 4 <> 1 OR substr(ck, 4, 1) <> '3'),
j AS (SELECT c.match_id, path, log, count(*) OVER (PARTITION BY c.match_id) = count(log) OVER (PARTITION BY c.match_id) AS ok
  FROM c LEFT JOIN l ON l.match_id = c.match_id AND l.ck = c.ck) SELECT match_id, path, log FROM j WHERE ok""")
def q_pair(T):
    n = F.substring("path", 6, 10).cast("long") - 100 + F.col("match_id") % 3
    clock = F.format_string("%02d:%02d:00", F.floor(n / 6), n % 6 * 10)
    rows = T["clips"].select("match_id", "path", clock.alias("ck"))
    logs = rows.where("match_id % 4 <> 1 OR substring(ck, 4, 1) <> '3'").select("match_id", F.concat(F.lit("log_"), "ck", F.lit(".json")).alias("log")).distinct()
    named = rows.select("match_id", F.concat_ws("|", "path", F.translate("ck", ":", "-")).alias("path"))
    return TL.pair_logs(named, logs).select("match_id", F.substring_index("path", "|", 1).alias("path"), "log")


@query("report_round_trip", f"""WITH {MOMENTUM_CTE} SELECT match_id, minute, round_even(w0 / CAST(w0 + w1 AS DOUBLE), 3) AS team_0,
  w0 + w1 AS contested_frames FROM mo""")
def q_report(T):
    m = M.momentum(T["obs"], T["aim"])
    docs = R.report_documents(M.team_metrics(M.build_tracks(M.speeds(T["obs"])), m, L), m)
    return R.momentum_of_report(docs).select("match_id", "minute", "team_0", "contested_frames")


LABELED = """lb AS (SELECT c_custkey % 50 AS track_id, CAST(floor(c_custkey / 50e0) AS BIGINT) AS match_id,
  CASE WHEN floor(c_custkey / 50e0) = 4 THEN -1 ELSE c_custkey % 3 - 1 END AS team, (c_custkey * 37 % 100) / 100e0 AS quality FROM customer
  WHERE floor(c_custkey / 50e0) <> 7 OR c_custkey * 37 % 100 >= 35)"""


def _team_labels(T):
    match = F.floor(F.col("c_custkey") / 50).cast("long")
    rows = T["customer"].select(match.alias("match_id"), (F.col("c_custkey") % 50).alias("track_id"),
                                F.when(match == 4, -1).otherwise(F.col("c_custkey") % 3 - 1).alias("team"), (F.col("c_custkey") * 37 % 100 / 100.0).alias("quality"))
    return rows.where("match_id <> 7 or quality >= 0.35")


@query("weak_team_labels", f"""WITH {LABELED} SELECT match_id, track_id, CAST(team AS BIGINT) AS team, quality FROM lb WHERE team >= 0 AND quality < 0.35e0""")
def q_weak_team_labels(T):
    return TM.weak_labels(_team_labels(T)).select("match_id", "track_id", F.col("team").cast("long").alias("team"), "quality")


@query("report_notes", f"""WITH {LABELED}, c AS (SELECT match_id, count(CASE WHEN team >= 0 THEN 1 END) AS known,
  count(CASE WHEN team >= 0 AND quality < 0.35e0 THEN 1 END) AS weak FROM lb GROUP BY 1)
SELECT match_id, CASE WHEN known = 0 THEN '{R.NOTE_NO_TEAMS}|' ELSE '' END || CASE WHEN weak > 0 THEN weak || '{R.NOTE_WEAK.replace("'", "''")}|' ELSE '' END
  || '{R.NOTE_EVENTS}|{R.NOTE_VIEW}' AS notes FROM c""")
def q_report_notes(T):
    return R.report_notes(_team_labels(T)).select("match_id", F.array_join("notes", "|").alias("notes"))


@query("report_facts", f"""WITH {LABELED}, seen AS (SELECT match_id, max(frame) + 1 AS frames_analyzed FROM ball GROUP BY 1),
used AS (SELECT match_id, count(*) AS n FROM obs GROUP BY 1),
c AS (SELECT match_id, count(CASE WHEN team >= 0 THEN 1 END) AS known, count(CASE WHEN team >= 0 AND quality < 0.35e0 THEN 1 END) AS weak FROM lb GROUP BY 1)
SELECT s.match_id, CAST(2 + CASE WHEN coalesce(known, 0) = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(weak, 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_notes,
  100e0 AS length, 64e0 AS width, coalesce(u.n, 0) AS detections_used, frames_analyzed
FROM seen s LEFT JOIN used u ON u.match_id = s.match_id LEFT JOIN c ON c.match_id = s.match_id""")
def q_report_facts(T):
    facts = R.report_facts(_team_labels(T), T["obs"], T["ball"], 100.0, 64.0)
    m = M.momentum(T["obs"], T["aim"])
    docs = R.report_documents(M.team_metrics(M.build_tracks(M.speeds(T["obs"])), m, L), m, None, facts)
    back = R.facts_of_report(docs)
    return back.select("match_id", F.size("notes").cast("long").alias("n_notes"), F.col("pitch")[0].alias("length"), F.col("pitch")[1].alias("width"),
                       "detections_used", "frames_analyzed")


@query("report_players", """WITH mv AS (SELECT match_id, track_id, team, count(*) AS observations FROM obs GROUP BY 1, 2, 3)
SELECT match_id, track_id, CAST(min(team) AS BIGINT) AS team, CAST(sum(observations) AS BIGINT) AS observations FROM mv GROUP BY 1, 2 HAVING sum(observations) >= 12""")
def q_report_players(T):
    tracks = M.build_tracks(M.speeds(T["obs"]))
    m = M.momentum(T["obs"], T["aim"])
    docs = R.report_documents(M.team_metrics(tracks, m, L), m, R.report_players(tracks))
    return R.players_of_report(docs).select("match_id", "track_id", "team", "observations")


@query("report_paths", """SELECT match_id, track_id, CAST(floor(frame / 4096e0) AS BIGINT) AS part, count(*) AS n,
  round_even(sum(round_even(x, 1)), 3) AS sum_x, round_even(sum(round_even(y, 1)), 3) AS sum_y FROM obs GROUP BY 1, 2, 3""")
def q_report_paths(T):
    total = lambda i: F.bround(F.aggregate("xy", F.lit(0.0), lambda s, p: s + p[i]), 3)
    return R.report_paths(T["obs"]).select("match_id", "track_id", "part", F.size("xy").cast("long").alias("n"), total(0).alias("sum_x"), total(1).alias("sum_y"))


@query("replay_documents")
def q_replay(T):
    fast = M.speeds(T["obs"])
    return R.replay_documents(fast, M.player_stats(fast, T["aim"], 5.0), T["aim"], M.bystanders(M.build_tracks(fast)), PITCH, 5.0,
                              M.attack_summary(M.orientations(T["obs"])), T["ball"])


@query("tracks_of_replay", """SELECT match_id, track_id, frame, 90e0 + frame / 5e0 AS t, round_even(x, 1) AS x, round_even(y, 1) AS y FROM obs""")
def q_tracks(T):
    fast = M.speeds(T["obs"])
    stats = fast.select("match_id", "track_id", "team").distinct()
    players = R.replay_players(fast, stats).join(stats, ["match_id", "track_id"])
    starts = stats.select("match_id").distinct().withColumn("start_s", F.lit(90.0))
    return R.tracks_of_replay(players, starts, 5.0).select("match_id", "track_id", "frame", "t", "x", "y")


@query("match_summaries", """SELECT s_suppkey AS match_id, coalesce(sg.n, 0) AS segments, s_suppkey % 3 <> 0 AS has_calibration,
  s_suppkey % 5 <> 0 AS has_report, coalesce(e.n, 0) AS n_events, coalesce(h.n, 0) AS n_highlights FROM supplier
  LEFT JOIN (SELECT match_id, count(*) AS n FROM clips GROUP BY 1) sg ON sg.match_id = s_suppkey
  LEFT JOIN (SELECT match_id, count(*) AS n FROM event_log GROUP BY 1) e ON e.match_id = s_suppkey
  LEFT JOIN (SELECT match_id, count(*) AS n FROM whistles GROUP BY 1) h ON h.match_id = s_suppkey""")
def q_summaries(T):
    m = T["marks"].select("match_id")
    return C.match_summaries(m, T["clips"], m.where("match_id % 3 <> 0"), m.where("match_id % 5 <> 0"), T["event_log"], T["whistles"])


@query("ready_matches", """SELECT m.match_id, r IS NULL AS streamable, r AS reason, CASE WHEN r IS NULL THEN a END AS start_s, CASE WHEN r IS NULL THEN b END AS end_s
FROM (SELECT s_suppkey AS match_id, a, b, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN 'no calibration or replay yet'
    WHEN a IS NULL THEN 'segment not found' END AS r FROM supplier LEFT JOIN (SELECT match_id, min(duration_s) AS a, max(duration_s) AS b FROM clips GROUP BY 1) c
  ON c.match_id = s_suppkey) m""")
def q_ready(T):
    m = T["marks"].select("match_id", (F.col("match_id") % 4).alias("listed_segments"))
    segs = T["clips"].select("match_id", F.col("duration_s").alias("start_s"), F.col("duration_s").alias("end_s"))
    return C.ready_matches(m, segs, m.where("match_id % 3 <> 0"), m.where("match_id % 5 <> 0"))


@query("listed_matches", """WITH w AS (SELECT match_id, min((duration_s, width, fps)) AS m, max(duration_s) AS b FROM clips GROUP BY 1),
r AS (SELECT s_suppkey AS match_id, m, b, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN 'no calibration or replay yet'
  WHEN m IS NULL THEN 'segment not found' END AS reason FROM supplier LEFT JOIN w ON w.match_id = s_suppkey)
SELECT match_id, reason IS NULL AS streamable, reason, CASE WHEN reason IS NULL THEN m[1] END AS start_s, CASE WHEN reason IS NULL THEN b END AS end_s,
  CASE WHEN reason IS NULL THEN 'home ' || match_id || '|away' END AS names,
  CASE WHEN reason IS NULL THEN CASE WHEN match_id % 2 = 1 THEN (match_id % 200) || ',7,9' ELSE '-' END || '|' || '1,2,' || (match_id % 100) END AS colors,
  CASE WHEN reason IS NULL THEN CAST(m[2] AS BIGINT) END AS frame_count, CASE WHEN reason IS NULL THEN m[3] END AS fps FROM r""")
def q_listed(T):
    m = T["marks"].select("match_id", (F.col("match_id") % 4).alias("listed_segments"),
                          F.array(F.concat(F.lit("home "), F.col("match_id").cast("string")), F.lit("away")).alias("team_names"))
    first = F.struct("duration_s", "width", "fps")
    one = T["clips"].groupBy("match_id").agg(F.min(first).alias("a"), F.max("duration_s").alias("b"))
    segs = one.select("match_id", F.col("a.duration_s").alias("start_s"), F.col("b").alias("end_s"), F.col("a.width").cast("long").alias("frame_count"), F.col("a.fps").alias("fps"))
    team = lambda k, r, g, b: m.select("match_id", F.lit(k).alias("team"), *(c.cast("int").alias(n) for n, c in zip(("kit_r", "kit_g", "kit_b"), (r, g, b))))
    teams = team(0, F.col("match_id") % 200, F.lit(7), F.lit(9)).where("match_id % 2 = 1").unionByName(
        team(1, F.lit(1), F.lit(2), F.col("match_id") % 100)).unionByName(team(-1, F.lit(0), F.lit(0), F.lit(0)))
    out = C.listed_matches(m, segs, m.where("match_id % 3 <> 0"), m.where("match_id % 5 <> 0"), teams)
    color = F.transform("team_colors", lambda c: F.coalesce(F.array_join(F.transform(c, lambda v: v.cast("string")), ","), F.lit("-")))
    return out.select("match_id", "streamable", "reason", "start_s", "end_s", F.when(F.col("streamable"), F.array_join("team_names", "|")).alias("names"),
                      F.when(F.col("streamable"), F.array_join(color, "|")).alias("colors"), "frame_count", "fps")


@query("event_log_files", """SELECT match_id, event_id, round_even(time_s, 3) AS time_s, type, CASE WHEN event_id % 11 = 0 THEN 'manual' ELSE source END AS source,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE verdict END AS verdict FROM event_log""")
def q_log_files(T):
    old = T["event_log"].withColumns({"source": F.when(F.col("event_id") % 11 != 0, F.col("source")),
                                      "verdict": F.when(F.col("event_id") % 13 != 0, F.col("verdict"))})
    path = shared_path(T.spark, "events")
    R.write_events(old, path)
    return R.read_events(T.spark, path).select(F.col("match_id").cast("long").alias("match_id"), "event_id", "time_s", "type", "source", "verdict")


@query("segment_files", """SELECT match_id, frame, t FROM ball WHERE match_id % 2 = 0 OR frame < 2500""")
def q_segment_files(T):
    # chunks of 500 frames on their own counts; every other match lost its chunk 5, so what follows is not read
    rows = T["ball"].select("match_id", F.lit(0).alias("segment_id"), F.floor(F.col("frame") / 500).cast("long").alias("chunk"),
                            (F.col("frame") % 500).alias("frame"), "t").where("match_id % 2 = 0 or chunk <> 5")
    path = shared_path(T.spark, "segment")
    rows.groupBy("match_id", "segment_id", "chunk").agg(F.count(F.lit(1)).alias("n_frames")).write.parquet(f"{path}/chunks")
    rows.write.parquet(f"{path}/frames")
    rows.withColumn("det_id", F.lit(0)).write.parquet(f"{path}/detections")
    return S.read_segment(T.spark, path)[0].select("match_id", "frame", "t")
