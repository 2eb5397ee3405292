"""Sports-shaped views over the benchmark tables.

One text per view, understood by Spark and DuckDB alike, so a query and its oracle read the same rows. An order is an
analysis frame and its line items are the detections in it; positions are integer arithmetic on the keys, so the views
need no sort and no global row numbers and their work grows with the tables. A match is 5,000 frames, so larger tables
hold more matches, not longer ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCH_FRAMES = 5000
PITCH = (100.0, 64.0)

# where the ball rests before play c: own third, penalty spot, center, corners, shooting range
PLAY_X = ("CASE WHEN c IN (0, 5, 8) THEN 20e0 WHEN c = 1 THEN 89e0 WHEN c = 2 THEN 50e0 WHEN c = 7 THEN 99e0 "
          "WHEN c IN (4, 9) THEN 78e0 ELSE 1e0 END")
PLAY_Y = ("CASE WHEN c IN (0, 5, 8) THEN 20e0 WHEN c IN (1, 2) THEN 32e0 WHEN c IN (4, 9) THEN 30e0 ELSE 1e0 END")

# name -> (tables or views read, SQL). {braces} mark the inputs.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # ball per frame: ten 12 s plays in turn, each resting, struck, then resting; lost and forecast frames
    "ball": (("orders",), f"""
SELECT match_id, frame, frame / 5e0 AS t,
  CASE WHEN frame % 97 = 0 THEN 'lost' WHEN frame % 23 = 0 THEN 'coasting' ELSE 'tracking' END AS status,
  CASE WHEN frame % 97 = 0 THEN 0e0 WHEN frame % 23 = 0 THEN 0e0 ELSE 1e0 END AS measured,
  CASE WHEN frame % 97 = 0 THEN NULL ELSE greatest(0e0, least(100e0, x0 + k * dx)) END AS x,
  CASE WHEN frame % 97 = 0 THEN NULL ELSE greatest(0e0, least(64e0, y0 + k * dy)) END AS y
FROM (
  SELECT match_id, frame, CAST(greatest(0, least(10, frame % 60 - 20)) AS DOUBLE) AS k,
    {PLAY_X} AS x0, {PLAY_Y} AS y0,
    CASE WHEN c IN (0, 5, 8) THEN 4.4e0 WHEN c IN (1, 4, 9) THEN 3.8e0 WHEN c = 2 THEN -3.2e0
      WHEN c = 7 THEN -2e0 ELSE 2e0 END AS dx,
    CASE WHEN c IN (0, 5, 8) THEN 0.4e0 WHEN c = 2 THEN 0.5e0 WHEN c IN (1, 4, 9) THEN 0e0 ELSE 2.5e0 END AS dy
  FROM (
    SELECT CAST(floor(o_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(o_orderkey % 5000 AS BIGINT) AS frame,
      CAST(floor((o_orderkey % 5000) / 60e0) AS BIGINT) % 10 AS c
    FROM {{orders}}) a) b"""),
    # one detection per (order, line number); a track lasts 500 frames. Line 1 keeps goal, 3 runs to the ball, 6 stands
    "obs": (("lineitem",), f"""
SELECT match_id, frame, frame / 5e0 AS t, track_id,
  CASE WHEN track_id % 5 = 0 THEN -1 ELSE track_id % 2 END AS team,
  CASE WHEN det_id = 1 THEN (frame % 20) * 0.5e0
    WHEN det_id = 3 THEN greatest(0e0, {PLAY_X} - greatest(0, 18 - frame % 60) * 1e0)
    WHEN det_id = 6 THEN 50e0 + (frame % 5) * 0.1e0
    ELSE abs((frame * (1 + track_id % 2) + track_id * 131) % 400 - 200) * 0.5e0 END AS x,
  CASE WHEN det_id = 1 THEN 32e0 WHEN det_id = 3 THEN {PLAY_Y} WHEN det_id = 6 THEN 2e0
    ELSE abs((frame + track_id * 37) % 256 - 128) * 0.5e0 END AS y,
  0.3e0 + (track_id % 4) * 0.1e0 AS sigma_m,
  60e0 + (partkey % 130) AS height_px,
  (partkey % 100) / 100e0 AS conf,
  det_id
FROM (
  SELECT match_id, frame, det_id, partkey, det_id + 7 * CAST(floor(frame / 500e0) AS BIGINT) AS track_id,
    CAST(floor(frame / 60e0) AS BIGINT) % 10 AS c
  FROM (
    SELECT CAST(floor(l_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(l_orderkey % 5000 AS BIGINT) AS frame,
      CAST(l_linenumber AS BIGINT) AS det_id, min(l_partkey) AS partkey
    FROM {{lineitem}} GROUP BY 1, 2, 3) a) b"""),
    "aim": (("orders",), """
SELECT match_id, frame,
  CASE WHEN frame % 11 = 0 THEN NULL ELSE abs((frame * 3 + match_id * 50) % 400 - 200) * 0.5e0 END AS aim_x,
  CASE WHEN frame % 11 = 0 THEN NULL ELSE 32e0 END AS aim_y
FROM (SELECT CAST(floor(o_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(o_orderkey % 5000 AS BIGINT) AS frame
  FROM {orders}) a"""),
    # camera pose per frame: a pan angle (radians), a focal length, whether the pose is known, logged yaw (degrees)
    "poses": (("orders",), """
SELECT match_id, frame, frame / 5e0 AS t, (frame % 61 - 30) / 60e0 AS pan, 0.8e0 + (frame % 10) * 0.001e0 AS focal,
  frame % 50 <> 0 AS ok, CASE WHEN frame % 13 = 0 THEN NULL ELSE (frame % 61 - 30) * 1.2e0 END AS yaw
FROM (SELECT CAST(floor(o_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(o_orderkey % 5000 AS BIGINT) AS frame
  FROM {orders}) a"""),
    # drift anchors every 400 frames: a turn about the vertical and a focal factor
    "anchors": (("poses",), """
SELECT match_id, frame, (frame * 37 % 11) * 0.01e0 AS turn, 1e0 + (frame % 7) * 0.01e0 AS scale
FROM {poses} WHERE frame % 400 = 100"""),
    # frame-to-frame homographies
    "steps": (("orders",), """
SELECT match_id, frame, 1e0 + (frame % 40) * 0.05e0 AS h0, 0.01e0 * (frame % 5) AS h1, 0.02e0 AS h2, 0.01e0 AS h3,
  1e0 - (frame % 30) * 0.03e0 AS h4, -0.01e0 AS h5, (frame % 25) * 0.03e0 AS h6, 0.1e0 AS h7,
  CASE WHEN frame % 77 = 0 THEN -0.15e0 ELSE 1e0 END AS h8
FROM (SELECT CAST(floor(o_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(o_orderkey % 5000 AS BIGINT) AS frame
  FROM {orders}) a"""),
    # landmark clicks, with repeats
    "clicks": (("events",), """
SELECT CAST(floor(event_id / 2000e0) AS BIGINT) AS match_id, event_id AS pid, CAST(event_id % 2000 % 90 AS BIGINT) AS frame,
  (event_id % 100) / 100e0 AS u, (event_id % 50) / 100e0 AS v,
  CASE event_id % 5 WHEN 0 THEN 'center spot' WHEN 1 THEN 'halfway far' WHEN 2 THEN 'corner far-left'
    WHEN 3 THEN 'centre circle near' ELSE 'unknown' END AS label
FROM {events}"""),
    "calibs": (("supplier",), """
SELECT s_suppkey AS match_id, 0.6e0 + (s_suppkey % 61) * 0.02e0 AS focal_scale, 0.8e0 + (s_suppkey % 57) * 0.2e0 AS height,
  s_suppkey % 19 = 3 AS ill, s_suppkey % 23 = 4 AS ambiguous, 0.5e0 + (s_suppkey % 5) * 0.7e0 AS r0,
  1e0 + (s_suppkey % 3) * 4e0 AS r1, 3e0 AS r2
FROM {supplier}"""),
    # detections as the segment reader yields them: boxes over frame width, kit descriptor
    "dets": (("lineitem",), """
SELECT match_id, frame, det_id, CAST(partkey % 9 AS BIGINT) AS hint, u - 0.01e0 AS x1, v - 0.05e0 AS y1,
  u + 0.01e0 AS x2, v AS y2,
  (partkey % 100) / 100e0 AS conf, 0.1e0 + (partkey % 9) / 10e0 AS kit_frac,
  (partkey % 50) / 50e0 AS kit_l, (det_id % 2) + (partkey % 10) / 50e0 AS kit_a, (partkey % 7) / 7e0 AS kit_b,
  (det_id % 3) / 3e0 + (partkey % 5) / 50e0 AS kit_sat, (partkey % 11) / 11e0 AS kit_val
FROM (
  SELECT match_id, frame, det_id, partkey, ((partkey * 37) % 1000) / 1000e0 AS u,
    0.02e0 + ((partkey * 53) % 520) / 1000e0 AS v
  FROM (
    SELECT CAST(floor(l_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(l_orderkey % 5000 AS BIGINT) AS frame,
      CAST(l_linenumber AS BIGINT) AS det_id, min(l_partkey) AS partkey
    FROM {lineitem} GROUP BY 1, 2, 3) a) b"""),
    # two detectors' boxes over the same frames
    "boxes_a": (("lineitem",), """
SELECT match_id, frame, det_id, x1, y1, x1 + 0.05e0 AS x2, y1 + 0.1e0 AS y2, conf, height_px, cls
FROM (
  SELECT CAST(floor(l_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(l_orderkey % 5000 AS BIGINT) AS frame,
    CAST(l_linenumber AS BIGINT) AS det_id, (min(l_partkey) % 90) / 100e0 AS x1, (min(l_suppkey) % 45) / 100e0 AS y1,
    (min(l_partkey) % 100) / 100e0 AS conf, 20e0 + min(l_partkey) % 180 AS height_px,
    CASE WHEN l_linenumber = 7 THEN 'ball' ELSE 'person' END AS cls
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) a"""),
    "boxes_b": (("boxes_a",), """
SELECT match_id, frame, det_id, x1 + det_id * 0.01e0 AS x1, y1, x2 + det_id * 0.01e0 AS x2, y2,
  (conf + 0.5e0) / 2e0 AS conf, height_px, cls FROM {boxes_a} WHERE (frame + det_id) % 9 <> 0"""),
    # review log
    "event_log": (("events",), """
SELECT match_id, event_id, n * 1.7e0 AS time_s,
  CASE event_type WHEN 'signup' THEN 'goal' WHEN 'error' THEN 'other' WHEN 'click' THEN 'shot'
    WHEN 'view' THEN 'corner' ELSE 'tackle' END AS type,
  CAST(event_id % 3 - 1 AS BIGINT) AS team,
  CASE WHEN event_id % 5 = 0 THEN 'manual' WHEN event_id % 5 = 1 THEN 'audio' ELSE 'ball' END AS source,
  (event_id % 100) / 100e0 AS confidence,
  CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS verdict,
  CASE WHEN event_id % 2 = 0 THEN 'game' ELSE 'cam' END AS video, 'n' AS note
FROM (SELECT CAST(floor(event_id / 2000e0) AS BIGINT) AS match_id, CAST(event_id % 2000 AS BIGINT) AS n,
  event_id, event_type FROM {events}) a"""),
    # a fresh scan of the same recording: some times moved a little, some missing, some new
    "fresh": (("event_log",), """
SELECT match_id, event_id, time_s + (event_id % 7) * 0.3e0 AS time_s, type, team, 'ball' AS source, confidence,
  '' AS verdict, video, 'fresh' AS note FROM {event_log} WHERE event_id % 3 <> 0"""),
    "whistles": (("events",), """
SELECT match_id, n * 1.7e0 AS time_s, (event_id % 40) * 10e0 AS prominence, 2500e0 + event_id % 1500 AS frequency_hz,
  0.2e0 + (event_id % 9) * 0.1e0 AS duration_s, (event_id % 10) / 10e0 AS voice_share, (event_id % 50) / 10e0 AS low_gain
FROM (SELECT CAST(floor(event_id / 600e0) AS BIGINT) AS match_id, CAST(event_id % 600 AS BIGINT) AS n, event_id,
  event_type FROM {events}) a WHERE event_type = 'error'"""),
    "readings": (("events",), """
SELECT CAST(floor(event_id / 2000e0) AS BIGINT) AS match_id, user_id AS track_id,
  CAST(event_id % 2000 AS BIGINT) AS frame, event_id AS det_id,
  CASE event_id % 11 WHEN 0 THEN '0' WHEN 1 THEN 'no ' ELSE '' END
    || CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 7 + 1 ELSE user_id % 30 END AS VARCHAR) AS digits,
  (event_id % 100) / 100e0 AS confidence
FROM {events}"""),
    "telemetry": (("events",), """
SELECT match_id, clip, n, n * 0.21e0 AS time_s,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE n % 120 - 60e0 END AS yaw,
  event_id % 6 < 4 AS locked, CAST(event_id * 17 % 2560 AS DOUBLE) AS ball_x,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id * 7 % 900 - 450e0 END AS ball_ym
FROM (SELECT CAST(floor(event_id / 4000e0) AS BIGINT) AS match_id, event_id % 2 AS clip,
  CAST(floor((event_id % 4000) / 2e0) AS BIGINT) AS n, event_id FROM {events}) a"""),
    # per audio window: band peak, median, level and energies; a strong tone every 600 windows, weaker ones between
    "windows": (("orders",), """
SELECT match_id, w, CASE WHEN burst THEN 400e0 + (w % 7) ELSE 3e0 + (w % 5) * 0.1e0 END AS peak, 1e0 AS local,
  CASE WHEN burst THEN 900e0 + (w % 11) ELSE 5e0 + (w % 9) * 0.1e0 END AS level, 2500e0 + (w % 13) * 10e0 AS freq,
  CASE WHEN c % 3 = 1 AND burst THEN 800e0 ELSE 2e0 + (w % 4) END AS voice,
  CASE WHEN c % 4 = 2 AND burst THEN 50e0 ELSE 2e0 + (w % 6) * 0.2e0 END AS low,
  CASE WHEN burst THEN 1000e0 ELSE 12e0 END AS total
FROM (SELECT *, w % 600 BETWEEN 100 AND 130 + c % 5 OR w % 600 BETWEEN 180 AND 210 OR w % 600 BETWEEN 420 AND 420 + c * 5 AS burst
  FROM (SELECT CAST(floor(o_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(o_orderkey % 5000 AS BIGINT) AS w,
    CAST(floor((o_orderkey % 5000) / 600e0) AS BIGINT) AS c FROM {orders}) a) b"""),
    # boxes of one track with pauses, and clips cut around it
    "track_boxes": (("orders",), """
SELECT match_id, track_id, f / 5e0 AS t, f AS frame, ((f * 3) % 700) / 1000e0 AS x1, 0.1e0 + (f % 40) / 200e0 AS y1,
  ((f * 3) % 700) / 1000e0 + 0.02e0 AS x2, 0.16e0 + (f % 40) / 200e0 + (f % 9) * 0.001e0 AS y2
FROM (SELECT CAST(floor(o_orderkey / 5000e0) AS BIGINT) AS match_id, CAST(floor((o_orderkey % 5000) / 500e0) AS BIGINT)
    AS track_id, CAST(o_orderkey % 500 AS BIGINT) AS f FROM {orders}) a WHERE f % 130 NOT BETWEEN 100 AND 115 AND f % 17 <> 3"""),
    "crops": (("supplier",), """
SELECT CAST(floor(s_suppkey / 10e0) AS BIGINT) % 3 AS match_id, s_suppkey % 10 AS track_id, s_suppkey AS clip_id,
  (s_suppkey * 7 % 90) * 1e0 + 0.3e0 AS start_s, 4e0 + s_suppkey % 9 AS duration_s FROM {supplier}"""),
    # clips of a recording; ten per match
    "clips": (("supplier",), """
SELECT CAST(floor(s_suppkey / 10e0) AS BIGINT) AS match_id, 'clip-' || CAST(100 + s_suppkey % 10 AS VARCHAR) AS path,
  60e0 + s_suppkey % 7 AS duration_s, CASE WHEN s_suppkey % 31 = 0 THEN 'hevc' ELSE 'h264' END AS codec,
  CASE WHEN s_suppkey % 17 = 3 THEN 1920 ELSE 3840 END AS width, 2160 AS height,
  CASE WHEN s_suppkey % 23 = 5 THEN 59.94e0 ELSE 60e0 END AS fps, s_suppkey % 29 <> 7 AS has_audio
FROM {supplier}"""),
    "marks": (("supplier",), """
SELECT s_suppkey AS match_id, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE 100e0 + s_suppkey % 10 END AS start_s,
  CASE WHEN s_suppkey % 11 = 4 THEN 90e0 ELSE 500e0 + s_suppkey % 20 END AS half_s,
  CASE WHEN s_suppkey % 7 = 2 THEN 2000e0 ELSE 950e0 END AS end_s, 1000e0 AS duration_s
FROM {supplier}"""),
    "people": (("customer",), """
SELECT CAST(floor(c_custkey / 50e0) AS BIGINT) AS match_id, c_custkey % 50 AS track_id,
  CAST(c_custkey % 3 - 1 AS BIGINT) AS team,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 23 END AS number,
  CASE WHEN c_custkey % 6 = 1 THEN c_mktsegment END AS name,
  (c_custkey % 50) * 3e0 AS first_t, (c_custkey % 50) * 3e0 + 20e0 + c_custkey % 9 AS last_t
FROM {customer}"""),
    "rosters": (("part",), """
SELECT CAST(floor(p_partkey / 60e0) AS BIGINT) AS match_id, CAST(floor(p_partkey / 30e0) AS BIGINT) % 2 AS team,
  'Roster ' || CAST(CAST(floor(p_partkey / 30e0) AS BIGINT) AS VARCHAR) AS roster,
  CASE WHEN p_partkey % 30 = 29 THEN 'x' ELSE CAST(p_partkey % 30 AS VARCHAR) END AS number,
  CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END AS name
FROM {part}"""),
}


class Tables:
    """The parquet tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.table(name)
        inputs, text = VIEWS[name]
        return self.spark.sql(text.replace("VARCHAR", "STRING"), **{i: self[i] for i in inputs})


def with_views(body: str) -> str:
    """An oracle statement: ``body`` may name any view as a table."""
    need: list[str] = []

    def visit(name: str) -> None:
        for i in VIEWS[name][0]:
            if i in VIEWS:
                visit(i)
        if name not in need:
            need.append(name)

    import re
    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    ctes = [f"{name} AS ({VIEWS[name][1].format(**{i: i for i in VIEWS[name][0]}).strip()})" for name in need]
    text = body.strip()
    if not ctes:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + text[len("WITH RECURSIVE"):]
    if text.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + text[4:]
    return "WITH " + ",\n".join(ctes) + "\n" + text
