"""Queries on tracks, teams, numbers, identities, highlights, crop paths, detectors and whistles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import labels as N
from ..operators import detectors as D
from ..operators import highlights as H
from ..operators import identity as I
from ..operators import metrics as M
from ..operators import paths as P
from ..operators import teams as TM
from ..operators import tracking as TK
from ..operators import whistle as WH
from ..session import cut, shared_path
from .catalog_geometry import _anchors, _calibrations, _frames
from .catalog_metrics import MOMENTUM_CTE, one_mark
from .registry import query
from .views import PITCH

SANITIZED = """rd AS (SELECT *, CASE WHEN length(d) BETWEEN 1 AND 2 THEN d ELSE '' END AS dg FROM (
  SELECT *, ltrim(regexp_replace(digits, '[^0-9]', '', 'g'), '0') AS d FROM readings) a)"""
VOTES = f"""{SANITIZED},
v AS (SELECT match_id, track_id, dg, count(*) AS n, sum(confidence) AS s, min(det_id) AS f FROM rd WHERE dg <> '' GROUP BY 1, 2, 3),
b AS (SELECT *, sum(n) OVER (PARTITION BY match_id, track_id) AS readings,
    row_number() OVER (PARTITION BY match_id, track_id ORDER BY n DESC, s DESC, f) AS k FROM v),
vn AS (SELECT match_id, track_id, CAST(dg AS BIGINT) AS number, n AS votes, CAST(readings AS BIGINT) AS readings,
    round_even(s / n, 2) AS confidence FROM b WHERE k = 1 AND ((n >= 3 AND n / readings >= 0.5e0 AND s / n >= 0.4e0)
    OR (n >= 3 AND n / readings >= 0.4e0 AND s / n >= 0.75e0) OR (n = 2 AND n = readings AND s / n >= 0.9e0)))"""
ROSTER = """rs AS (SELECT match_id, team, CAST(number AS BIGINT) AS number, max(trim(name)) AS rname FROM rosters
  WHERE TRY_CAST(number AS BIGINT) BETWEEN 1 AND 99 AND trim(name) <> '' GROUP BY 1, 2, 3)"""
MANUAL = "mn AS (SELECT match_id, track_id, number, name FROM people WHERE track_id % 3 = 0)"
AUTO = "au AS (SELECT match_id, track_id, number + 1 AS number, 0.5e0 AS confidence FROM people WHERE track_id % 2 = 0)"


@query("sanitize_digits", f"WITH {SANITIZED} SELECT det_id, dg AS digits FROM rd")
def q_digits(T):
    return T["readings"].select("det_id", N.sanitize_digits(F.col("digits")).alias("digits"))


@query("vote_numbers", f"WITH {VOTES} SELECT * FROM vn")
def q_votes(T):
    return I.vote_numbers(T["readings"])


@query("clean_roster", """SELECT match_id, team, CAST(number AS BIGINT) AS number, trim(name) AS name,
  'roster-' || substr(roster, 8) AS slug FROM rosters WHERE TRY_CAST(number AS BIGINT) BETWEEN 1 AND 99 AND trim(name) <> ''""")
def q_roster(T):
    return I.clean_roster(T["rosters"]).select("match_id", "team", "number", "name", N.roster_slug(F.col("roster")).alias("slug"))


def _sources(T):
    people = T["people"]
    manual = people.where("track_id % 3 = 0").select("match_id", "track_id", "number", "name")
    auto = people.where("track_id % 2 = 0").select("match_id", "track_id", (F.col("number") + 1).alias("number"),
                                                   F.lit(0.5).alias("confidence"))
    return people, auto, manual, I.clean_roster(T["rosters"])


MERGED = f"""{ROSTER}, {MANUAL}, {AUTO},
mg AS (SELECT p.match_id, p.track_id, p.team, CASE WHEN h THEN mnum ELSE anum END AS number, h, mname, aconf FROM (
    SELECT p.*, m.number AS mnum, trim(m.name) AS mname, a.number AS anum, a.confidence AS aconf,
      coalesce(m.number, 0) <> 0 OR coalesce(trim(m.name), '') <> '' AS h
    FROM (SELECT match_id, track_id, team FROM people) p LEFT JOIN mn m ON m.match_id = p.match_id AND m.track_id = p.track_id
      LEFT JOIN au a ON a.match_id = p.match_id AND a.track_id = p.track_id) p WHERE h OR coalesce(anum, 0) <> 0),
mf AS (SELECT g.match_id, g.track_id, g.number, coalesce(CASE WHEN h THEN nullif(mname, '') END, rname, '') AS name,
    CASE WHEN h THEN 'manual' ELSE 'auto' END AS source, CASE WHEN h THEN 1e0 ELSE aconf END AS confidence
  FROM mg g LEFT JOIN rs r ON r.match_id = g.match_id AND r.team = g.team AND r.number = g.number)"""


@query("merge_numbers", f"WITH {MERGED} SELECT * FROM mf")
def q_merge(T):
    return I.merge_numbers(*_sources(T))


@query("footage_numbers", f"""WITH {ROSTER}, {MANUAL}, {AUTO},
f AS (SELECT p.match_id, p.track_id, a.number, coalesce(nullif(trim(m.name), ''), rname, '') AS name
  FROM people p LEFT JOIN au a ON a.match_id = p.match_id AND a.track_id = p.track_id
    LEFT JOIN mn m ON m.match_id = p.match_id AND m.track_id = p.track_id
    LEFT JOIN rs r ON r.match_id = p.match_id AND r.team = p.team AND r.number = a.number)
SELECT *, CASE WHEN number IS NOT NULL THEN 'scan' ELSE 'roster' END AS source FROM f WHERE number IS NOT NULL OR name <> ''""")
def q_footage(T):
    return I.footage_numbers(*_sources(T))


@query("linked_rosters", """SELECT m.match_id, m.team, r.number, r.name FROM (
    SELECT match_id, 0 AS team, 'Roster ' || CAST(match_id AS VARCHAR) AS roster FROM marks
    UNION ALL SELECT match_id, 1, 'Roster ' || CAST(match_id + 3 AS VARCHAR) FROM marks) m
  JOIN rosters r ON r.roster = m.roster""")
def q_linked(T):
    def named(k):
        return F.concat(F.lit("Roster "), (F.col("match_id") + k).cast("string"))

    m = T["marks"].select("match_id", F.array(named(0), named(3), named(5)).alias("links"))
    return I.team_rosters(m, T["rosters"]).withColumn("team", F.col("team").cast("int"))


@query("identities", f"""WITH {MERGED},
k AS (SELECT p.match_id, p.track_id, p.team, p.first_t, p.last_t, n.number, coalesce(n.name, '') AS name,
    CASE WHEN coalesce(n.number, 0) <> 0 THEN 'n|' || p.team || '|' || n.number
      WHEN coalesce(n.name, '') <> '' THEN 'm|' || p.team || '|' || lower(n.name) ELSE 't|' || p.track_id END AS key
  FROM people p LEFT JOIN mf n ON n.match_id = p.match_id AND n.track_id = p.track_id),
g AS (SELECT match_id, key, min(track_id) AS track, arg_min(team, track_id) AS team, count(*) AS c, min(first_t) AS first_t,
    max(last_t) AS last_t, sum(greatest(last_t - first_t, 0e0)) AS seen FROM k GROUP BY 1, 2)
SELECT g.match_id, row_number() OVER (PARTITION BY g.match_id ORDER BY track) - 1 AS identity_id, g.team, c AS appearances,
  g.first_t, g.last_t, round_even(seen, 1) AS seen_s,
  CASE WHEN c > 1 THEN CASE WHEN coalesce(k.number, 0) <> 0 THEN 'number' ELSE 'name' END ELSE '' END AS grouped_by,
  CASE WHEN coalesce(k.number, 0) <> 0 THEN '#' || k.number || CASE WHEN k.name <> '' THEN ' ' || k.name ELSE '' END
    WHEN k.name <> '' THEN k.name ELSE 'track ' || track END AS label
FROM g JOIN k ON k.match_id = g.match_id AND k.track_id = g.track""")
def q_identities(T):
    numbers = I.merge_numbers(*_sources(T))
    return I.identities(T["people"].drop("number", "name"), numbers).drop("members")


@query("appearances", """SELECT match_id, track_id, min(team) AS team, min(frame) AS first_frame, max(frame) AS last_frame,
  min(frame) / 5e0 + 90e0 AS first_t, max(frame) / 5e0 + 90e0 AS last_t FROM obs GROUP BY 1, 2""")
def q_appear(T):
    return I.appearances(T["obs"], 90.0, 5.0)


@query("numbers_stale", """WITH miss AS (SELECT match_id, count(*) AS n FROM (SELECT DISTINCT match_id, track_id FROM people
  WHERE track_id % 7 = 0 EXCEPT SELECT match_id, track_id FROM people WHERE match_id % 2 = 0) a GROUP BY 1)
SELECT c.match_id, CASE WHEN n > 0 THEN n || ' of the kept shirt numbers name a track that the report lacks'
  WHEN abs(height - focal_scale * 5e0) > 1e0 THEN 'shirt numbers are older than the calibration' ELSE '' END AS note
FROM calibs c LEFT JOIN miss m ON m.match_id = c.match_id""")
def q_stale(T):
    p = T["people"]
    stamps = T["calibs"].select("match_id", F.col("height").alias("scan_s"), (F.col("focal_scale") * 5.0).alias("calibration_s"))
    return I.numbers_stale(p.where("track_id % 7 = 0"), p.where("match_id % 2 = 0"), stamps)


CROPS = """us AS (SELECT *, height_px * conf AS sc FROM obs WHERE height_px BETWEEN 88 AND 200 AND conf >= 0.55e0),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY sc DESC, det_id, frame) AS r,
  count(*) OVER (PARTITION BY match_id, track_id) AS n FROM us)"""


@query("crop_budget", """WITH us AS (SELECT *, height_px * conf AS sc, frame * 10 + det_id AS did FROM obs
  WHERE height_px BETWEEN 88 AND 200 AND conf >= 0.55e0),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY sc DESC, did) AS r,
  count(*) OVER (PARTITION BY match_id, track_id) AS n FROM us),
lt AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id, r <= 10 ORDER BY frame, did) - 1 AS i,
  greatest(1, CAST(floor((n - 10) / 10e0) AS BIGINT)) AS st FROM rk WHERE n >= 2),
kp AS (SELECT * FROM lt WHERE n <= 20 OR r <= 10 OR (i % st = 0 AND i / CAST(st AS DOUBLE) < 10)),
fr AS (SELECT match_id, frame, count(*) AS c FROM kp GROUP BY 1, 2),
ch AS (SELECT match_id, frame FROM (SELECT match_id, frame, row_number() OVER (PARTITION BY match_id ORDER BY frame) - 1 AS p,
  sum(c) OVER (PARTITION BY match_id) AS al FROM fr) z WHERE al <= 900 OR p % CAST(ceil(al / 900e0) AS BIGINT) = 0)
SELECT k.match_id, k.track_id, k.frame, k.did AS det_id FROM kp k JOIN ch ON ch.match_id = k.match_id AND ch.frame = k.frame""")
def q_crop_budget(T):
    dets = T["obs"].withColumn("det_id", F.col("frame") * 10 + F.col("det_id"))
    return I.crop_budget(dets, 20, 900).select("match_id", "track_id", "frame", "det_id")


@query("scan_candidates", "SELECT match_id, frame, det_id FROM obs WHERE height_px BETWEEN 88 AND 200 AND conf >= 0.55e0")
def q_scan(T):
    return I.scan_candidates(T["obs"]).select("match_id", "frame", "det_id")


@query("ball_size_gate", """SELECT match_id, frame, det_id FROM (SELECT match_id, frame, det_id, (x2 - x1) * det_id / 4e0 AS w,
  (y2 - y1) * det_id / 6e0 AS h FROM dets) a WHERE least(w, h) >= 0.003e0 AND greatest(w, h) <= 0.06e0""")
def q_gate(T):
    sized = T["dets"].select("match_id", "frame", "det_id", ((F.col("x2") - F.col("x1")) * F.col("det_id") / 4.0).alias("w"),
                             ((F.col("y2") - F.col("y1")) * F.col("det_id") / 6.0).alias("h"))
    return I.ball_size_gate(sized).select("match_id", "frame", "det_id")


@query("second_look", """WITH rr AS (SELECT match_id, track_id, frame, det_id, conf FROM obs WHERE (frame * 7 + det_id) % 97 = 0),
few AS (SELECT match_id, track_id FROM rr GROUP BY 1, 2 HAVING count(*) < 4),
w AS (SELECT r.match_id, r.track_id, r.frame + o.k AS frame, -r.conf AS c, r.det_id + r.frame * 10 AS r, abs(o.k) AS d, o.k AS o
  FROM rr r JOIN few USING (match_id, track_id), (SELECT unnest(range(-8, 9)) AS k) o WHERE o.k <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id, frame ORDER BY c, r, d, o) AS k FROM w),
f AS (SELECT b.match_id, b.track_id, b.frame, q.det_id, row_number() OVER (PARTITION BY b.match_id, b.track_id
    ORDER BY c, r, d, o) AS rk FROM b JOIN obs q ON q.match_id = b.match_id AND q.track_id = b.track_id AND q.frame = b.frame
  WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM rr z WHERE z.match_id = b.match_id AND z.track_id = b.track_id AND z.frame = b.frame))
SELECT match_id, track_id, frame, det_id FROM f WHERE rk <= 16""")
def q_second(T):
    o = T["obs"]
    r = o.where("(frame * 7 + det_id) % 97 = 0").select("match_id", "track_id", "frame",
                                                        (F.col("det_id") + F.col("frame") * 10).alias("det_id"),
                                                        F.col("conf").alias("confidence"))
    return I.second_look(r, o)


@query("thin_track", """WITH n AS (SELECT match_id, track_id, frame, row_number() OVER w - 1 AS i,
    count(*) OVER (PARTITION BY match_id, track_id) AS n FROM obs WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame))
SELECT match_id, track_id, frame FROM n WHERE n <= 60 OR i IN (SELECT CAST(round_even(k * ((n - 1) / 59e0), 0) AS BIGINT)
  FROM (SELECT unnest(range(0, 60)) AS k) z)""")
def q_thin(T):
    return I.thin_track(T["obs"].select("match_id", "track_id", "frame"), 60)


MOMENT_CTE = f"""{MOMENTUM_CTE},
mm AS (SELECT match_id, event_id AS i, 0 AS src, time_s, greatest(0e0, time_s - 4e0) AS start_s, time_s + 6e0 AS end_s,
    CASE WHEN source = 'manual' THEN 10e0 ELSE 1e0 END * CASE WHEN type = 'goal' THEN 3e0 WHEN type = 'shot' THEN 1.6e0
      WHEN type = 'corner' THEN 1.3e0 WHEN type = 'tackle' THEN 1.2e0 ELSE 1e0 END AS weight, type AS event_type
  FROM event_log WHERE verdict <> 'false'
  UNION ALL SELECT match_id, minute, 1, minute * 60e0 + 30e0, greatest(0e0, minute * 60e0 + 26e0), minute * 60e0 + 36e0,
    abs(round_even(w0 / CAST(w0 + w1 AS DOUBLE), 3) - 0.5e0) * 8e0, 'other' FROM mo
  WHERE abs(round_even(w0 / CAST(w0 + w1 AS DOUBLE), 3) - 0.5e0) >= 0.25e0)"""


def _moments(T):
    return H.build_moments(T["event_log"], M.momentum(T["obs"], T["aim"]))


@query("build_moments", f"""WITH {MOMENT_CTE} SELECT match_id, time_s, start_s, end_s, round_even(weight, 6) AS weight,
  event_type FROM mm WHERE start_s < 2000e0""")
def q_moments(T):
    log = T["event_log"]
    d = log.select("match_id").distinct().withColumn("duration_s", F.lit(2000.0))
    out = H.build_moments(log, M.momentum(T["obs"], T["aim"]), d)
    return out.select("match_id", "time_s", "start_s", "end_s", F.bround("weight", 6).alias("weight"), "event_type")


@query("clamp_moment", f"""WITH {MOMENT_CTE} SELECT match_id, i, greatest(0e0, start_s) AS start_s, least(700e0, end_s) AS end_s
  FROM mm WHERE src = 0 AND start_s < 700e0 AND end_s > 0 AND least(700e0, end_s) - greatest(0e0, start_s) >= 0.05e0""")
def q_clamp(T):
    out = H.clamp_moment(H.build_moments(T["event_log"]), F.lit(700.0))
    return out.select("match_id", F.col("ord.i").alias("i"), "start_s", "end_s")


@query("moment_on_source", """WITH c AS (SELECT match_id, min(path) AS path FROM clips GROUP BY 1)
SELECT e.match_id, e.event_id AS i, CASE WHEN e.video = 'cam' THEN greatest(0e0, greatest(0e0, time_s - 4e0) + 12.5e0) END
  AS clip_start_s, CASE WHEN e.video = 'cam' THEN time_s + 18.5e0 END AS clip_end_s FROM event_log e WHERE verdict <> 'false'""")
def q_on_source(T):
    log = T["event_log"]
    clips = log.select("match_id").distinct().select("match_id", F.lit("cam").alias("path"), F.lit(12.5).alias("start_s"))
    out = H.moment_on_source(H.build_moments(log), "game", clips)
    return out.select("match_id", F.col("ord.i").alias("i"), "clip_start_s", "clip_end_s")


REELS = f"""WITH RECURSIVE {MOMENT_CTE},
st AS (SELECT match_id, bool_or(event_type IN ('goal', 'penalty')) AS strong FROM mm GROUP BY 1),
pl AS (SELECT 'clip' AS tier, 24e0 AS budget, least(30e0, greatest(15e0, end_s - start_s)) AS ln, m.* FROM mm m
  UNION ALL SELECT 'goals', 90e0, greatest(15e0, end_s - start_s), m.* FROM mm m JOIN st ON st.match_id = m.match_id
    WHERE CASE WHEN strong THEN event_type IN ('goal', 'penalty') ELSE event_type IN ('shot', 'save', 'block') END
  UNION ALL SELECT 'match', 300e0, greatest(15e0, end_s - start_s), m.* FROM mm m),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, tier ORDER BY weight DESC, src, time_s, i) AS rn FROM pl),
wk AS (SELECT match_id, tier, rn, ln AS used, [time_s] AS times, TRUE AS took FROM rk WHERE rn = 1
  UNION ALL SELECT match_id, tier, rn, CASE WHEN ok THEN used + ln ELSE used END, CASE WHEN ok THEN list_append(times, time_s) ELSE times END, ok
  FROM (SELECT r.*, w.used, w.times, w.used < r.budget AND w.used + r.ln <= r.budget
      AND NOT list_bool_or([abs(r.time_s - q) < 20e0 FOR q IN w.times]) AS ok
    FROM wk w JOIN rk r ON r.match_id = w.match_id AND r.tier = w.tier AND r.rn = w.rn + 1) s)
SELECT match_id, tier, round_even(time_s, 2) AS time_s, round_even(start_s, 2) AS start_s, round_even(end_s, 2) AS end_s,
  round_even(weight, 2) AS weight, event_type FROM wk JOIN rk USING (match_id, tier, rn) WHERE took"""


@query("select_reels", REELS)
def q_reels(T):
    return H.reel_manifest(H.select_reels(_moments(T))).drop("reason", "team", "video")


@query("reel_files", REELS)
def q_reel_files(T):
    path = shared_path(T.spark, "reels")
    H.write_reels(H.select_reels(_moments(T)), path)
    return H.read_reels(T.spark, path).drop("reason", "team", "video")


@query("iou_pairs", """SELECT a.match_id, a.frame, a.det_id AS a_id, b.det_id AS b_id,
  round_even(i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i), 6) AS iou FROM (
  SELECT a.match_id, a.frame, a.det_id, b.det_id AS b_det, greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1))
    * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i FROM boxes_a a JOIN boxes_b b
    ON b.match_id = a.match_id AND b.frame = a.frame) p
  JOIN boxes_a a ON a.match_id = p.match_id AND a.frame = p.frame AND a.det_id = p.det_id
  JOIN boxes_b b ON b.match_id = p.match_id AND b.frame = p.frame AND b.det_id = p.b_det
WHERE i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i) >= 0.5e0""")
def q_iou(T):
    return D.box_overlaps(T["boxes_a"], T["boxes_b"]).withColumn("iou", F.bround("iou", 6))


@query("detector_agreement", """WITH RECURSIVE i AS (SELECT a.match_id, a.frame, a.det_id AS a_id, b.det_id AS b_id,
    greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS area
  FROM boxes_a a JOIN boxes_b b ON b.match_id = a.match_id AND b.frame = a.frame),
p AS (SELECT match_id, frame, a_id, b_id, row_number() OVER (PARTITION BY match_id, frame ORDER BY i / (area - i) DESC, a_id, b_id) AS rn
  FROM i WHERE i / (area - i) >= 0.5e0),
w AS (SELECT match_id, frame, rn, [a_id] AS las, [b_id] AS lbs FROM p WHERE rn = 1
  UNION ALL SELECT p.match_id, p.frame, p.rn,
    CASE WHEN list_contains(las, a_id) OR list_contains(lbs, b_id) THEN las ELSE list_append(las, a_id) END,
    CASE WHEN list_contains(las, a_id) OR list_contains(lbs, b_id) THEN lbs ELSE list_append(lbs, b_id) END
  FROM w JOIN p ON p.match_id = w.match_id AND p.frame = w.frame AND p.rn = w.rn + 1),
f AS (SELECT match_id, frame, max(len(las)) AS m FROM w GROUP BY 1, 2),
t AS (SELECT match_id, CAST(sum(m) AS BIGINT) AS m FROM f GROUP BY 1),
na AS (SELECT match_id, count(*) AS n FROM boxes_a GROUP BY 1), nb AS (SELECT match_id, count(*) AS n FROM boxes_b GROUP BY 1)
SELECT coalesce(na.match_id, nb.match_id) AS match_id, coalesce(m, 0) AS matched, coalesce(na.n, 0) - coalesce(m, 0) AS only_a,
  coalesce(nb.n, 0) - coalesce(m, 0) AS only_b
FROM na FULL JOIN nb ON nb.match_id = na.match_id LEFT JOIN t ON t.match_id = coalesce(na.match_id, nb.match_id)""")
def q_agree(T):
    return D.pair_totals(T["boxes_a"], T["boxes_b"])


@query("height_bands", """SELECT match_id, CASE WHEN height_px < 14 THEN 'h<14' WHEN height_px < 24 THEN '14-24'
  WHEN height_px < 40 THEN '24-40' WHEN height_px < 60 THEN '40-60' ELSE '>=60' END AS band, count(*) AS n FROM boxes_a GROUP BY 1, 2
UNION ALL SELECT match_id, 'all', count(*) FROM boxes_a GROUP BY 1""")
def q_bands(T):
    return D.height_bands(T["boxes_a"])


@query("detector_table", """WITH p AS (SELECT o.match_id, o.frame, count(CASE WHEN cls <> 'ball' THEN 1 END) AS people,
    count(CASE WHEN cls <> 'ball' AND height_px >= 60e0 THEN 1 END) AS tall, count(CASE WHEN cls = 'ball' THEN 1 END) AS balls
  FROM ball o LEFT JOIN boxes_a d ON d.match_id = o.match_id AND d.frame = o.frame GROUP BY 1, 2),
c AS (SELECT match_id, quantile_cont(conf, 0.5) AS median_conf FROM boxes_a WHERE cls <> 'ball' GROUP BY 1)
SELECT p.match_id, CAST(sum(people) AS BIGINT) AS detections, CAST(sum(tall) AS BIGINT) AS above_floor,
  CAST(sum(balls) AS BIGINT) AS balls, count(CASE WHEN balls > 0 THEN 1 END) AS frames_with_ball,
  CAST(quantile_cont(CAST(tall AS DOUBLE), 0.5) AS DOUBLE) AS median_per_frame, min(median_conf) AS median_conf
FROM p JOIN c ON c.match_id = p.match_id GROUP BY 1""")
def q_table(T):
    return D.detector_table(T["boxes_a"], T["ball"], 60.0)


@query("class_mix", "SELECT match_id, cls, count(*) AS n FROM boxes_a GROUP BY 1, 2")
def q_mix(T):
    return D.class_mix(T["boxes_a"])


@query("ball_recall", """WITH s AS (SELECT b.match_id, b.frame, bool_or(coalesce(sqrt(((x1 + x2) / 2e0 - u) ** 2
    + ((y1 + y2) / 2e0 - v) ** 2) <= 0.03e0, FALSE)) AS hit
  FROM (SELECT match_id, frame, (frame * 13 % 90) / 100e0 AS u, (frame * 7 % 45) / 100e0 AS v FROM ball WHERE status = 'tracking') b
  LEFT JOIN boxes_a d ON d.match_id = b.match_id AND d.frame = b.frame GROUP BY 1, 2)
SELECT match_id, count(CASE WHEN hit THEN 1 END) AS hits, count(*) AS frames FROM s GROUP BY 1""")
def q_recall(T):
    track = T["ball"].selectExpr("match_id", "frame", "status", "(frame * 13 % 90) / 100e0 AS u", "(frame * 7 % 45) / 100e0 AS v")
    return D.ball_recall(track, T["boxes_a"])


@query("disagreement_topk", """WITH c AS (SELECT match_id, frame, sum(a) AS n_a, sum(b) AS n_b FROM (
    SELECT match_id, frame, 1 AS a, 0 AS b FROM boxes_a UNION ALL SELECT match_id, frame, 0, 1 FROM boxes_b) z GROUP BY 1, 2)
SELECT match_id, frame, CAST(diff AS BIGINT) AS diff, rank FROM (SELECT *, row_number() OVER (PARTITION BY match_id
  ORDER BY diff DESC, frame) AS rank FROM (SELECT *, abs(n_a - n_b) AS diff FROM c) y) x WHERE rank <= 3""")
def q_disagree(T):
    return D.disagreement_topk(T["boxes_a"], T["boxes_b"]).select("match_id", "frame", "diff", F.col("rank").cast("long").alias("rank"))


FRAG = """fr AS (SELECT match_id, track_id, min(frame) AS f0, max(frame) AS f1, arg_min(x, frame) AS x0, arg_min(y, frame) AS y0,
    arg_max(x, frame) AS x1, arg_max(y, frame) AS y1 FROM obs GROUP BY 1, 2),
pr AS (SELECT b.match_id, b.track_id AS before, a.track_id AS after, a.f0 - b.f1 AS gap,
    sqrt((a.x0 - b.x1) ** 2 + (a.y0 - b.y1) ** 2) AS distance FROM fr b JOIN fr a ON a.match_id = b.match_id
    AND a.f0 - b.f1 BETWEEN 1 AND 150 AND a.track_id <> b.track_id)"""


def _frags(T):
    return TK.fragments(T["obs"]).withColumn("kit", F.lit(None).cast("array<double>"))


@query("stitch_candidates", f"""WITH {FRAG} SELECT match_id, before, after, round_even(distance / gap + 0.5e0, 6) AS cost FROM pr
WHERE gap <= 30 AND distance <= gap * (0.6e0 * (7e0 / 5e0)) + 2e0""")
def q_candidates(T):
    return TK.stitch_candidates(_frags(T), 5.0).withColumn("cost", F.bround("cost", 6))


KITTED = """kp AS (SELECT *, CASE WHEN before % 5 <> 0 AND after % 5 <> 0 THEN sqrt(2 * ((before % 3 - after % 3) * 0.2e0) ** 2) END AS kd FROM pr)"""


def _kit_frags(T):
    """Tracks in three kits; every fifth shows none."""
    part = (F.col("track_id") % 3) * 0.2
    return TK.fragments(T["obs"]).withColumn("kit", F.when(F.col("track_id") % 5 != 0, F.array(part, F.lit(0.4), part, F.lit(0.1), F.lit(0.2))))


@query("stitch_candidates_kit", f"""WITH {FRAG}, {KITTED}
SELECT match_id, before, after, round_even(distance / gap + CASE WHEN kd IS NULL THEN 0.5e0 ELSE 2e0 * kd END, 6) AS cost FROM kp WHERE gap <= 30
  AND CASE WHEN kd IS NULL THEN distance <= gap * (0.6e0 * (7e0 / 5e0)) + 2e0 ELSE kd <= 0.45e0 AND distance <= gap * (7e0 / 5e0) + 2e0 END""")
def q_candidates_kit(T):
    return TK.stitch_candidates(_kit_frags(T), 5.0).withColumn("cost", F.bround("cost", 6))


@query("stitch_report_kit", f"""WITH {FRAG}, {KITTED} SELECT match_id, reason, count(*) AS n, count(CASE WHEN reachable THEN 1 END) AS reachable
FROM (SELECT match_id, CASE WHEN gap > 30 THEN 'gap' WHEN kd > 0.45e0 THEN 'kit' WHEN kd IS NOT NULL AND distance > gap * (7e0 / 5e0) + 2e0 THEN 'distance'
    WHEN kd IS NULL AND distance > gap * (0.6e0 * (7e0 / 5e0)) + 2e0 THEN 'distance-no-kit' ELSE 'pass' END AS reason,
    distance <= gap * (7e0 / 5e0) + 2e0 AS reachable FROM kp WHERE distance <= 2e0 * (gap * (7e0 / 5e0) + 2e0)) a GROUP BY 1, 2""")
def q_report_kit(T):
    return TK.stitch_report(_kit_frags(T), 5.0).groupBy("match_id", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("reachable"), 1)).alias("reachable"))


@query("stitch_report", f"""WITH {FRAG} SELECT match_id, reason, spread, count(*) AS n, count(CASE WHEN reachable THEN 1 END) AS reachable
FROM (SELECT match_id, CASE WHEN gap > 30 THEN 'gap' WHEN distance > gap * (0.6e0 * (7e0 / 5e0)) + 2e0 THEN 'distance-no-kit'
    ELSE 'pass' END AS reason, CASE WHEN gap > 30 THEN CASE WHEN gap < 40 THEN '6-8' WHEN gap < 50 THEN '8-10'
    WHEN gap < 75 THEN '10-15' WHEN gap < 100 THEN '15-20' WHEN gap < 155 THEN '20-31' END END AS spread,
    distance <= gap * (7e0 / 5e0) + 2e0 AS reachable FROM pr WHERE distance <= 2e0 * (gap * (7e0 / 5e0) + 2e0)) a GROUP BY 1, 2, 3""")
def q_report(T):
    return TK.stitch_report(_frags(T), 5.0).groupBy("match_id", "reason", "spread").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("reachable"), 1)).alias("reachable"))


@query("stitch_samples", f"""WITH {FRAG}, rs AS (SELECT *, CASE WHEN gap > 30 THEN 'gap' ELSE 'distance-no-kit' END AS reason,
    distance / (gap * (0.6e0 * (7e0 / 5e0)) + 2e0) AS ratio FROM pr WHERE distance <= 2e0 * (gap * (7e0 / 5e0) + 2e0)
    AND CASE WHEN gap > 30 THEN distance <= gap * (7e0 / 5e0) + 2e0 ELSE distance > gap * (0.6e0 * (7e0 / 5e0)) + 2e0 END)
SELECT match_id, before, after, reason, round_even(ratio, 6) AS ratio, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY match_id, reason ORDER BY ratio, before, after) AS rank FROM rs) z WHERE rank <= 6""")
def q_samples(T):
    out = TK.stitch_samples(TK.stitch_report(_frags(T), 5.0))
    return out.select("match_id", "before", "after", "reason", F.bround("ratio", 6).alias("ratio"), F.col("rank").cast("long").alias("rank"))


@query("match_fragments")
def q_match(T):
    return TK.match_fragments(TK.stitch_candidates(_frags(T), 5.0))


@query("match_fragment_totals", f"""WITH RECURSIVE {FRAG}, ed AS (SELECT match_id, before, after,
    CAST(round_even((distance / gap + 1.5e0) * 1e6, 0) AS BIGINT) AS price FROM pr WHERE gap <= 30 AND distance <= gap * (0.6e0 * (7e0 / 5e0)) + 2e0),
near AS (SELECT a.match_id, a.before AS b1, a.after AS a1, b.before AS b2, b.after AS a2 FROM ed a JOIN ed b
  ON a.match_id = b.match_id AND (a.before = b.before OR a.after = b.after)),
reach AS (SELECT match_id, b1, a1, b1 AS b2, a1 AS a2 FROM near UNION
  SELECT r.match_id, r.b1, r.a1, n.b2, n.a2 FROM reach r JOIN near n ON n.match_id = r.match_id AND n.b1 = r.b2 AND n.a1 = r.a2),
groups AS (SELECT match_id, b1 AS before, a1 AS after, min((b2, a2)) AS g FROM reach GROUP BY ALL),
nth AS (SELECT ed.*, g, row_number() OVER (PARTITION BY match_id, g ORDER BY before, after) AS k, count(*) OVER (PARTITION BY match_id, g) AS size
  FROM ed JOIN groups USING (match_id, before, after)),
pick AS (SELECT DISTINCT match_id, g, size, 0 AS k, [0][:0] AS bs, [0][:0] AS afs, 0::BIGINT AS joins, 0::BIGINT AS total FROM nth UNION ALL
  SELECT p.match_id, p.g, p.size, p.k + 1, CASE WHEN t.y THEN list_append(bs, n.before) ELSE bs END,
    CASE WHEN t.y THEN list_append(afs, n.after) ELSE afs END, joins + CAST(t.y AS BIGINT), total + CASE WHEN t.y THEN price ELSE 0 END
  FROM pick p JOIN nth n ON n.match_id = p.match_id AND n.g = p.g AND n.k = p.k + 1 CROSS JOIN (VALUES (TRUE), (FALSE)) t(y)
  WHERE NOT t.y OR NOT (list_contains(bs, n.before) OR list_contains(afs, n.after))),
best AS (SELECT match_id, g, min((-joins, total)) AS b FROM pick WHERE k = size GROUP BY ALL)
SELECT match_id, CAST(-sum(b[1]) AS BIGINT) AS joins, CAST(sum(b[2]) AS BIGINT) AS price FROM best GROUP BY match_id""")
def q_match_totals(T):
    edges = cut(TK.stitch_candidates(_frags(T), 5.0))
    price = F.bround((F.col("cost") + 1.0) * 1e6).cast("long")
    return TK.match_fragments(edges).join(edges, ["match_id", "before", "after"]).groupBy("match_id").agg(
        F.count(F.lit(1)).alias("joins"), F.sum(price).alias("price"))


CHAIN = """(SELECT match_id, t AS before, t + 7 AS after FROM (SELECT DISTINCT match_id, track_id AS t FROM obs) z
  WHERE t % 7 <> 3 AND t + 7 <= 70)"""


@query("resolve_chains", f"""WITH RECURSIVE jn AS {CHAIN},
w AS (SELECT match_id, before AS head, after AS track_id FROM jn WHERE (match_id, before) NOT IN (SELECT (match_id, after) FROM jn)
  UNION ALL SELECT w.match_id, w.head, j.after FROM w JOIN jn j ON j.match_id = w.match_id AND j.before = w.track_id)
SELECT match_id, track_id, head FROM w""")
def q_chains(T):
    tracks = T["obs"].select("match_id", F.col("track_id").alias("before")).distinct()
    joins = tracks.where("before % 7 <> 3 AND before + 7 <= 70").withColumn("after", F.col("before") + 7)
    return TK.resolve_chains(joins).select("match_id", "track_id", "head")


def _tracked(T):
    o = T["obs"]
    kit = F.array(F.lit(0.9), F.lit(0.5), (F.col("track_id") % 2).cast("double"), *[F.lit(0.3)] * 3)
    return o.withColumns({"kit": kit, "hint": F.col("track_id")})


@query("track_people")
def q_track(T):
    return TK.track_people(_tracked(T), 5.0)


@query("stitch_tracks")
def q_stitch(T):
    o = T["obs"]
    kits = o.select("match_id", "track_id").distinct().withColumn(
        "kit", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.col("track_id") % 2 + i) / 10.0))
    out = TK.stitch_tracks(o, kits, 5.0)
    return out.groupBy("match_id", "track_id").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first_frame"),
                                                   F.max("frame").alias("last_frame"))


def _kitted(T):
    """Detections of the line items as tracks with a color by side."""
    d = T["obs"]
    side, noise = F.col("track_id") % 2, (F.col("frame") % 17) / 100.0
    kit = F.array(F.lit(0.8), F.lit(0.4) + noise, side * 0.4 + 0.3 + noise, F.lit(0.5) - noise, side * 0.2 + 0.5 + noise,
                  F.lit(0.6) + noise, *[F.lit(0.1) + noise * (i % 3) for i in range(6)])
    return d.withColumn("kit", kit)


@query("kit_rows", """WITH u AS (SELECT *, count(*) OVER w AS nu, count(CASE WHEN height_px BETWEEN 60 AND 200 THEN 1 END) OVER w
    AS nb FROM obs WINDOW w AS (PARTITION BY match_id, track_id)),
b AS (SELECT *, quantile_cont(CAST(height_px AS DOUBLE), 0.75) OVER (PARTITION BY match_id, track_id) AS q FROM u
  WHERE nu >= 6 AND nb >= 6 AND height_px BETWEEN 60 AND 200),
c AS (SELECT *, count(CASE WHEN height_px >= q THEN 1 END) OVER (PARTITION BY match_id, track_id) AS big FROM b)
SELECT match_id, track_id, frame FROM c WHERE big < 6 OR height_px >= q""")
def q_kit_rows(T):
    return TM.kit_rows(_kitted(T)).select("match_id", "track_id", "frame")


@query("kit_evidence", """WITH u AS (SELECT *, count(*) OVER w AS nu, count(CASE WHEN height_px BETWEEN 60 AND 200 THEN 1 END) OVER w
    AS nb FROM obs WINDOW w AS (PARTITION BY match_id, track_id)),
b AS (SELECT *, quantile_cont(CAST(height_px AS DOUBLE), 0.75) OVER (PARTITION BY match_id, track_id) AS q FROM u
  WHERE nu >= 6 AND nb >= 6 AND height_px BETWEEN 60 AND 200),
c AS (SELECT *, count(CASE WHEN height_px >= q THEN 1 END) OVER (PARTITION BY match_id, track_id) AS big FROM b)
SELECT match_id, track_id, round_even(quantile_cont(0.4e0 + (frame % 17) / 100e0, 0.5), 6) AS l,
  round_even(quantile_cont((track_id % 2) * 0.4e0 + 0.3e0 + (frame % 17) / 100e0, 0.5), 6) AS a,
  round_even(sqrt(count(*)), 6) AS weight FROM c WHERE big < 6 OR height_px >= q GROUP BY 1, 2""")
def q_kit_evidence(T):
    e = TM.kit_evidence(_kitted(T))
    return e.select("match_id", "track_id", F.bround(F.col("descriptor")[0], 6).alias("l"),
                    F.bround(F.col("descriptor")[1], 6).alias("a"), F.bround("weight", 6).alias("weight"))


def _labels(T):
    dets = cut(_kitted(T))
    near, far = cut(TM.kit_evidence(dets)), TM.kit_evidence(dets, TM.LABEL_HEIGHT)
    floors = dets.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).select(
        "match_id", TM.evidence_floor(F.col("n"), F.lit(5.0)).alias("floor"))
    voters, model = TM.assign_teams(near, floors)
    return TM.propagate_labels(voters, model, near, far), near


@query("assign_teams")
def q_teams(T):
    return _labels(T)[0]


@query("team_colors")
def q_colors(T):
    labeled, near = _labels(T)
    rgb = [F.col(c) for c in ("r", "g", "b")]
    out = N.with_color_name(TM.team_colors(labeled, near), *rgb, out="name")
    return out.select("match_id", "team", N.color_hex(*rgb).alias("hex"), "name")


@query("weak_labels")
def q_weak(T):
    return TM.weak_labels(_labels(T)[0])


@query("evidence_floor", """SELECT match_id, round_even(least(greatest(6e0 * sqrt(greatest(count(*) * 5e0 / 15e0, 1e0) / 21552e0),
  2.6e0), 6e0), 6) AS floor FROM dets GROUP BY 1""")
def q_floor(T):
    return T["dets"].groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).select(
        "match_id", F.bround(TM.evidence_floor(F.col("n"), F.lit(15.0)), 6).alias("floor"))


@query("histogram_teams")
def q_hist(T):
    h = T["embeddings"].select(F.col("label").cast("long").alias("match_id"), F.col("vec_id").alias("track_id"),
                               F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("hist"))
    return TM.histogram_teams(h, 64)


ISLANDS = """sm AS (SELECT *, sum(peak / (local + 1e-12)) OVER (PARTITION BY match_id ORDER BY w ROWS BETWEEN 2 PRECEDING AND
    2 FOLLOWING) / 5e0 AS s FROM windows),
bs AS (SELECT match_id, quantile_cont(s, 0.5) AS base, quantile_cont(level, 0.5) AS usual FROM sm GROUP BY 1),
md AS (SELECT sm.match_id, quantile_cont(abs(s - base), 0.5) AS mad FROM sm JOIN bs ON bs.match_id = sm.match_id GROUP BY 1),
ac AS (SELECT sm.*, usual, w - row_number() OVER (PARTITION BY sm.match_id ORDER BY w) AS g FROM sm
  JOIN bs ON bs.match_id = sm.match_id JOIN md ON md.match_id = sm.match_id WHERE s > base + 6e0 * (mad * 1.4826e0 + 1e-9)),
il AS (SELECT match_id, min(w) * 0.008e0 AS time_s, count(*) * 0.008e0 AS duration_s, max(s) AS score,
    quantile_cont(level, 0.5) / min(usual) AS prominence, min(w) AS a FROM ac GROUP BY match_id, g)"""


@query("tone_islands", f"""WITH {ISLANDS} SELECT match_id, round_even(time_s, 6) AS time_s, round_even(duration_s, 6) AS duration_s,
  round_even(score, 6) AS score, round_even(prominence, 6) AS prominence FROM il""")
def q_islands(T):
    out = WH.tone_islands(T["windows"], 16000)
    return out.select("match_id", *[F.bround(c, 6).alias(c) for c in ("time_s", "duration_s", "score", "prominence")])


@query("detect_whistles")
def q_whistles(T):
    return WH.detect_whistles(T["windows"], 16000)


@query("whistle_events", """SELECT match_id, time_s, 'whistle at ' || CAST(CAST(round_even(frequency_hz, 0) AS BIGINT) AS VARCHAR)
  || ' Hz (' || printf('%.2f', duration_s) || 's, ' || CAST(CAST(round_even(prominence, 0) AS BIGINT) AS VARCHAR)
  || 'x the match level) - stoppage candidate' AS note, least(greatest(prominence / 300e0, 0e0), 0.9e0) AS confidence FROM whistles""")
def q_whistle_events(T):
    return WH.whistle_events(T["whistles"]).select("match_id", "time_s", "note", "confidence")


LABELED = """lb AS (SELECT * FROM (SELECT e.event_id, e.verdict, e.time_s, w.time_s AS candidate_s, w.prominence, w.voice_share,
    w.low_gain, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(w.time_s - e.time_s), w.time_s) AS k
  FROM (SELECT match_id, event_id, verdict, time_s + (event_id % 3) * 0.12e0 AS time_s FROM event_log WHERE verdict <> '') e
    JOIN whistles w ON w.match_id = e.match_id AND abs(w.time_s - e.time_s) < 0.3e0) z WHERE k = 1)"""


def _labeled(T):
    e = T["event_log"].where("verdict <> ''").select("match_id", "event_id", "verdict",
                                                     (F.col("time_s") + (F.col("event_id") % 3) * 0.12).alias("time_s"))
    return WH.label_candidates(e, T["whistles"])


@query("label_candidates", f"WITH {LABELED} SELECT event_id, candidate_s, prominence FROM lb")
def q_label(T):
    return _labeled(T).select("event_id", "candidate_s", "prominence")


@query("gate_report", f"""WITH {LABELED}, lg AS (SELECT verdict, 'prominence' AS gate, prominence AS v, prominence < 50e0 AS r FROM lb
  UNION ALL SELECT verdict, 'voice_share', voice_share, voice_share >= 0.5e0 FROM lb
  UNION ALL SELECT verdict, 'low_gain', low_gain, low_gain >= 3e0 FROM lb)
SELECT gate, min(CASE WHEN verdict = 'true' THEN v END) AS true_min, max(CASE WHEN verdict = 'true' THEN v END) AS true_max,
  min(CASE WHEN verdict = 'false' THEN v END) AS false_min, max(CASE WHEN verdict = 'false' THEN v END) AS false_max,
  count(CASE WHEN verdict = 'true' AND r THEN 1 END) AS confirmed_lost,
  count(CASE WHEN verdict = 'false' AND r THEN 1 END) AS rejected_removed FROM lg GROUP BY 1""")
def q_gates(T):
    return WH.gate_report(_labeled(T))


CLIP_END = """tl AS (SELECT match_id, track_id, max(t) AS lt FROM track_boxes GROUP BY 1, 2),
gp AS (SELECT match_id, track_id, t FROM (SELECT match_id, track_id, t, lead(t) OVER (PARTITION BY match_id, track_id ORDER BY t)
  AS nt FROM track_boxes) a WHERE nt - t > 2e0),
ce AS (SELECT c.match_id, c.track_id, c.clip_id, c.start_s, CASE WHEN lt < start_s + duration_s - 1e0 THEN lt + 1e0
    ELSE start_s + duration_s END AS e, lt < start_s + duration_s - 1e0 AS early FROM crops c JOIN tl
    ON tl.match_id = c.match_id AND tl.track_id = c.track_id),
cg AS (SELECT ce.match_id, ce.track_id, ce.clip_id, ce.start_s, ce.e, ce.early, min(g.t) AS g FROM ce LEFT JOIN gp g
    ON g.match_id = ce.match_id AND g.track_id = ce.track_id AND g.t >= ce.start_s AND g.t < ce.e GROUP BY 1, 2, 3, 4, 5, 6),
en AS (SELECT match_id, track_id, clip_id, start_s, coalesce(g, e) AS end_s, CASE WHEN g IS NOT NULL THEN 'gap in the track'
    WHEN early THEN 'track ended' ELSE '' END AS truncated FROM cg WHERE coalesce(g, e) > start_s)"""


@query("clip_end", f"WITH {CLIP_END} SELECT match_id, track_id, clip_id, round_even(end_s, 6) AS end_s, truncated FROM en")
def q_clip_end(T):
    return P.clip_end(T["track_boxes"], T["crops"]).select("match_id", "track_id", "clip_id", F.bround("end_s", 6).alias("end_s"),
                                                          "truncated")


@query("crop_size", f"""WITH {CLIP_END},
h AS (SELECT e.match_id, e.track_id, e.clip_id, quantile_cont(abs(y2 - y1) * 3840e0, 0.5) AS h FROM en e LEFT JOIN track_boxes b
  ON b.match_id = e.match_id AND b.track_id = e.track_id AND b.t >= e.start_s AND b.t <= e.end_s GROUP BY 1, 2, 3),
s AS (SELECT *, greatest(2e0, round_even(least(greatest(CASE WHEN h > 0 THEN h / 0.25e0 ELSE 480e0 END, 480e0), 2160e0) / 2e0, 0) * 2e0)
  AS crop_h FROM h)
SELECT match_id, track_id, clip_id, greatest(2e0, round_even(least(crop_h * 3840 / 2160, 3840e0) / 2e0, 0) * 2e0) AS crop_w, crop_h FROM s""")
def q_crop_size(T):
    return P.crop_size(T["track_boxes"], P.clip_end(T["track_boxes"], T["crops"]), 3840, 2160)


@query("crop_path")
def q_crop_path(T):
    return P.crop_path(T["track_boxes"], T["crops"], 3840, 2160)


@query("resample_boxes", """WITH n AS (SELECT b.*, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx1, lead(y2) OVER w AS ny2
  FROM track_boxes b WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame)),
k AS (SELECT unnest(range(0, 1500)) AS k)
SELECT match_id, track_id, k.k, round_even(CASE WHEN nf = frame + 1 THEN x1 + (nx1 - x1) * (k.k * 5e0 / 12e0 - frame) ELSE x1 END, 6)
  AS x1, round_even(CASE WHEN nf = frame + 1 THEN y2 + (ny2 - y2) * (k.k * 5e0 / 12e0 - frame) ELSE y2 END, 6) AS y2
FROM n JOIN k ON k.k * 5 >= frame * 12 AND k.k * 5 < (frame + 1) * 12 AND (frame < 499 OR k.k * 5 = frame * 12)""")
def q_resample(T):
    b = T["track_boxes"]
    last = b.select("match_id").distinct().withColumn("last_frame", F.lit(499))
    out = P.resample_boxes(b, 5.0, 12.0, last)
    return out.select("match_id", "track_id", "k", F.bround("x1", 6).alias("x1"), F.bround("y2", 6).alias("y2"))


@query("resample_ball", """WITH n AS (SELECT b.*, lead(x) OVER w AS nx, lead(measured) OVER w AS nm, lead(frame) OVER w AS nf
  FROM ball b WINDOW w AS (PARTITION BY match_id ORDER BY frame)), k AS (SELECT unnest(range(0, 12000)) AS k)
SELECT match_id, k.k, round_even(CASE WHEN k.k * 5 = frame * 12 THEN x ELSE x + (nx - x) * (k.k * 5e0 / 12e0 - frame) END, 6) AS x,
  CASE WHEN k.k * 5e0 / 12e0 - frame < 0.5e0 THEN measured ELSE nm END AS measured
FROM n JOIN k ON k.k * 5 >= frame * 12 AND k.k * 5 < (frame + 1) * 12
WHERE x IS NOT NULL AND (k.k * 5 = frame * 12 OR nx IS NOT NULL)""")
def q_resample_ball(T):
    out = P.resample_ball(T["ball"], 5.0, 12.0)
    return out.select("match_id", "k", F.bround("x", 6).alias("x"), "measured")


#: blocks of audio in a task, some 20 MB of samples
AUDIO_BLOCKS = 1000


@query("audio_features")
def q_audio(T):
    @F.pandas_udf("array<float>")
    def wave(key: pd.Series, size: pd.Series) -> pd.Series:
        i = np.arange(4480)
        noise = np.sin(i * 1.7)
        return pd.Series([(np.sin((k * 4096 + i) * (s * 40.0 + 1500.0) * (6.283185307179586 / 16000.0)) * (k % 5) + noise).astype(np.float32)
                          for k, s in zip(key.tolist(), size.tolist())])

    # a row of a few bytes stands for a block of audio, so rows are dealt by their number: a file of them is one split
    part = T["part"].select("p_partkey", "p_size")
    part = part.repartition(max(1, -(-part.count() // AUDIO_BLOCKS)), "p_partkey")
    blocks = part.select(F.expr("cast(floor(p_partkey / 500) as bigint)").alias("match_id"),
                         (F.col("p_partkey") % 500 * 4096).alias("start"), F.lit(16000).alias("sr"), wave("p_partkey", "p_size").alias("samples"))
    return WH.window_features(blocks)


@query("build_report")
def q_build_report(T):
    """The whole report of each match, from the detections in the picture and the camera's poses, drift corrected."""
    from .report import build_report
    # the segment reader's kit without hue bins; one that lacks a part tells no color
    parts = F.array("kit_frac", "kit_l", "kit_a", "kit_b", "kit_sat", "kit_val", *[F.lit(0.0)] * 6)
    dets = T["dets"].select("match_id", "frame", "det_id", "x1", "y1", "x2", "y2", "conf", "hint",
                            F.when(~F.exists(parts, lambda v: v.isNull()), parts).alias("kit"))
    return build_report(dets, _frames(T), _calibrations(T), *PITCH, anchors=_anchors(T), marks=one_mark(T)).documents()


@query("track_ball")
def q_track_ball(T):
    from ..streaming.ball import track_ball
    det = T["dets"].select("match_id", "frame", F.struct(
        "conf", F.col("x1").alias("u"), F.col("y2").alias("v"), F.lit(0.01).alias("w"), F.lit(0.01).alias("h")).alias("d"))
    seen = det.groupBy("match_id", "frame").agg(F.sort_array(F.collect_list("d")).alias("dets"))
    rows = T["steps"].select("match_id", "frame", F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("step"),
                             (F.col("frame") % 3 == 0).alias("full_frame"))
    return track_ball(rows.join(seen, ["match_id", "frame"], "left"), 5.0, 0.5625)
