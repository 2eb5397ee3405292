"""Queries on projection, camera pose and calibration quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as N
from ..operators import projection as P
from .registry import query
from .views import PITCH

L, W = PITCH

# one camera for every match: 6 m up, tilted down, 10 m behind the near line
POSITION, SIN, COS, SCALE, ASPECT = (50.0, -10.0, 6.0), 0.28, 0.96, 1.05, 0.5625


def _frames(T):
    c, s = F.cos("pan"), F.sin("pan")
    q = F.array(c, F.lit(0.0), s, F.lit(0.0), F.lit(1.0), F.lit(0.0), -s, F.lit(0.0), c)
    return T["poses"].select("match_id", "frame", "t", q.alias("q"), "focal", "ok", "yaw", "pan")


def _calibrations(T):
    base = [1.0, 0.0, 0.0, 0.0, -SIN, COS, 0.0, -COS, -SIN]
    return T["poses"].select("match_id").distinct().select(
        "match_id", F.array(*[F.lit(v) for v in POSITION]).alias("position"),
        F.array(*[F.lit(v) for v in base]).alias("base"), F.lit(SCALE).alias("focal_scale"),
        F.lit(ASPECT).alias("aspect"))


def _anchors(T):
    return G.with_rotation(T["anchors"], (F.lit(0.0), F.lit(0.0), F.col("turn")), "rot").select(
        "match_id", "frame", "rot", "scale")


def ray(u: str, v: str, tag: str) -> str:
    """Oracle text: ground hit columns ``hx_tag, hy_tag`` from image position over ``pan, focal`` columns."""
    a, b = f"(({u}) - 0.5e0) / (focal * 1.05e0)", f"(({v}) - 0.28125e0) / (focal * 1.05e0)"
    x, z = f"(cos(pan) * {a} + sin(pan))", f"(cos(pan) - sin(pan) * {a})"
    wy, wz = f"(0.96e0 * {z} - 0.28e0 * {b})", f"(-0.96e0 * {b} - 0.28e0 * {z})"
    down = f"{wz} / sqrt({x} * {x} + {wy} * {wy} + {wz} * {wz}) < -1e-6"
    return (f"CASE WHEN {down} THEN 50e0 - 6e0 / {wz} * {x} END AS hx_{tag}, "
            f"CASE WHEN {down} THEN -10e0 - 6e0 / {wz} * {wy} END AS hy_{tag}")


def _six(df, *cols):
    return df.withColumns({c: F.bround(c, 6) for c in cols})


@query("project_detections", f"""WITH h AS (SELECT d.match_id, d.frame, d.det_id, d.y1, d.y2, p.ok,
    {ray('(x1 + x2) / 2e0', 'y2', 'a')}, {ray('(x1 + x2) / 2e0', 'y2 + 4e0 / 1920e0', 'b')}
  FROM dets d LEFT JOIN poses p ON p.match_id = d.match_id AND p.frame = d.frame),
g AS (SELECT *, coalesce(ok, FALSE) AND hx_a IS NOT NULL AND hx_b IS NOT NULL AS valid FROM h)
SELECT match_id, frame, det_id, valid, CASE WHEN valid THEN round_even(hx_a, 4) END AS x,
  CASE WHEN valid THEN round_even(hy_a, 4) END AS y,
  CASE WHEN valid THEN round_even(sqrt((hx_b - hx_a) ** 2 + (hy_b - hy_a) ** 2), 4) END AS sigma_m,
  round_even((y2 - y1) * 1920e0, 6) AS height_px FROM g""")
def q_project(T):
    out = P.project_detections(T["dets"], _frames(T), _calibrations(T))
    out = out.withColumns({c: F.bround(c, 4) for c in ("x", "y", "sigma_m")})
    return _six(out, "height_px").select("match_id", "frame", "det_id", "valid", "x", "y", "sigma_m", "height_px")


@query("frame_aim", f"""SELECT match_id, frame, round_even(hx_a, 4) AS aim_x, round_even(hy_a, 4) AS aim_y FROM (
  SELECT match_id, frame, {ray('0.5e0', '0.28125e0', 'a')} FROM poses) a""")
def q_aim(T):
    return P.frame_aim(_frames(T), _calibrations(T)).withColumns({c: F.bround(c, 4) for c in ("aim_x", "aim_y")})


BALL_UV = "(frame * 13 % 100) / 100e0 AS u, 0.05e0 + (frame * 7 % 50) / 100e0 AS v"


@query("project_ball", f"""SELECT match_id, frame, CASE WHEN seen THEN round_even(hx_a, 4) END AS x,
  CASE WHEN seen THEN round_even(hy_a, 4) END AS y,
  CASE WHEN seen AND hx_a IS NOT NULL AND status = 'tracking' THEN 1e0 ELSE 0e0 END AS measured
FROM (SELECT match_id, frame, status, status IN ('tracking', 'coasting') AS seen, {ray('u', 'v', 'a')} FROM (
  SELECT p.match_id, p.frame, p.pan, p.focal, b.status, b.u, b.v FROM poses p LEFT JOIN (
    SELECT match_id, frame, status, {BALL_UV} FROM ball) b ON b.match_id = p.match_id AND b.frame = p.frame) c) d""")
def q_ball(T):
    track = T["ball"].selectExpr("match_id", "frame", "status", *[e.strip() for e in (
        "(frame * 13 % 100) / 100e0 AS u", "0.05e0 + (frame * 7 % 50) / 100e0 AS v")])
    return P.project_ball(track, _frames(T), _calibrations(T)).withColumns({c: F.bround(c, 4) for c in ("x", "y")})


PIXEL_CTE = """
px AS (SELECT *, cos(pan) * (x - 50e0) - sin(pan) * cz0 AS cx, cos(pan) * cz0 + sin(pan) * (x - 50e0) AS cz, cy0 AS cy
  FROM (SELECT *, -0.28e0 * (y + 10e0) + 0.96e0 * 6e0 AS cy0, 0.96e0 * (y + 10e0) + 0.28e0 * 6e0 AS cz0 FROM pts) a)"""


@query("pitch_to_pixels", f"""WITH pts AS (SELECT b.match_id, b.frame, b.x, b.y, p.pan, p.focal FROM ball b
  JOIN poses p ON p.match_id = b.match_id AND p.frame = b.frame), {PIXEL_CTE}
SELECT match_id, frame, CASE WHEN cz > 1e-9 THEN round_even(focal * 1.05e0 * cx / cz + 0.5e0, 6) END AS u,
  CASE WHEN cz > 1e-9 THEN round_even(focal * 1.05e0 * cy / cz + 0.28125e0, 6) END AS v FROM px""")
def q_pixels(T):
    out = P.pitch_to_pixels(T["ball"].select("match_id", "frame", "x", "y"), _frames(T), _calibrations(T))
    return _six(out, "u", "v").select("match_id", "frame", "u", "v")


@query("landmarks", """SELECT match_id, label, round_even(x, 6) AS x, round_even(y, 6) AS y FROM (
  SELECT DISTINCT match_id, 90e0 + match_id % 20 AS l, 60e0 + match_id % 8 AS w FROM orders_match) m,
  LATERAL (VALUES ('corner near-left', 0e0, 0e0), ('corner near-right', l, 0e0), ('corner far-right', l, w),
    ('corner far-left', 0e0, w), ('goal post left-near', 0e0, w / 2e0 - 3.66e0),
    ('goal post left-far', 0e0, w / 2e0 + 3.66e0), ('goal post right-near', l, w / 2e0 - 3.66e0),
    ('goal post right-far', l, w / 2e0 + 3.66e0), ('halfway near', l / 2e0, 0e0), ('halfway far', l / 2e0, w),
    ('center spot', l / 2e0, w / 2e0), ('penalty spot left', 11e0, w / 2e0), ('penalty spot right', l - 11e0, w / 2e0),
    ('center circle near', l / 2e0, w / 2e0 - 9.15e0), ('center circle far', l / 2e0, w / 2e0 + 9.15e0),
    ('center circle left', l / 2e0 - 9.15e0, w / 2e0), ('center circle right', l / 2e0 + 9.15e0, w / 2e0)
  ) AS v(label, x, y)""".replace("orders_match", "marks"))
def q_landmarks(T):
    m = T["marks"].select("match_id", (F.col("match_id") % 20 + 90.0).alias("length"),
                          (F.col("match_id") % 8 + 60.0).alias("width"))
    return _six(P.landmarks(m), "x", "y")


@query("reprojection_rms", f"""WITH lm(label, x, y) AS (VALUES ('center spot', 50e0, 32e0), ('halfway far', 50e0, 64e0),
  ('corner far-left', 0e0, 64e0), ('center circle near', 50e0, 22.85e0)),
pts AS (SELECT c.match_id, c.u, c.v, l.x, l.y, p.pan, p.focal FROM (SELECT match_id, frame, u, v,
    CASE label WHEN 'centre circle near' THEN 'center circle near' ELSE label END AS label FROM clicks) c
  JOIN lm l ON l.label = c.label JOIN poses p ON p.match_id = c.match_id AND p.frame = c.frame), {PIXEL_CTE}
SELECT match_id, count(*) AS clicks, round_even(sqrt(avg((focal * 1.05e0 * cx / cz + 0.5e0 - u) ** 2
  + (focal * 1.05e0 * cy / cz + 0.28125e0 - v) ** 2)) * 1920e0, 4) AS rms_px FROM px WHERE cz > 1e-9 GROUP BY 1""")
def q_rms(T):
    m = T["poses"].select("match_id").distinct().select("match_id", F.lit(L).alias("length"), F.lit(W).alias("width"))
    out = P.reprojection_rms(T["clicks"], _frames(T), _calibrations(T), P.landmarks(m))
    return out.withColumn("rms_px", F.bround("rms_px", 4))


@query("projected_landmarks", f"""WITH lm(label, x, y) AS (VALUES ('center spot', 50e0, 32e0), ('halfway near', 50e0, 0e0)),
pts AS (SELECT p.match_id, p.frame, l.label, l.x, l.y, p.pan, p.focal FROM poses p, lm l WHERE p.frame % 40 = 0), {PIXEL_CTE}
SELECT match_id, frame, label, round_even(focal * 1.05e0 * cx / cz + 0.5e0, 6) AS u,
  round_even(focal * 1.05e0 * cy / cz + 0.28125e0, 6) AS v FROM px WHERE cz > 1e-9""")
def q_projected(T):
    m = T["poses"].select("match_id").distinct().select("match_id", F.lit(L).alias("length"), F.lit(W).alias("width"))
    marks = P.landmarks(m).where(F.col("label").isin("center spot", "halfway near"))
    return _six(P.projected_landmarks(marks, T["poses"].where("frame % 40 = 0"), _frames(T), _calibrations(T)), "u", "v")


@query("projected_landmarks_whole", f"""WITH lm(label, x, y) AS (VALUES ('corner near-left', 0e0, 0e0),
  ('corner near-right', 100e0, 0e0), ('corner far-right', 100e0, 64e0), ('corner far-left', 0e0, 64e0),
  ('goal post left-near', 0e0, 32e0 - 3.66e0), ('goal post left-far', 0e0, 32e0 + 3.66e0),
  ('goal post right-near', 100e0, 32e0 - 3.66e0), ('goal post right-far', 100e0, 32e0 + 3.66e0),
  ('halfway near', 50e0, 0e0), ('halfway far', 50e0, 64e0), ('center spot', 50e0, 32e0),
  ('penalty spot left', 11e0, 32e0), ('penalty spot right', 89e0, 32e0), ('center circle near', 50e0, 32e0 - 9.15e0),
  ('center circle far', 50e0, 32e0 + 9.15e0), ('center circle left', 50e0 - 9.15e0, 32e0),
  ('center circle right', 50e0 + 9.15e0, 32e0)),
pts AS (SELECT p.match_id, p.frame, l.label, l.x, l.y, p.pan, p.focal FROM poses p, lm l), {PIXEL_CTE}
SELECT match_id, frame, label, round_even(focal * 1.05e0 * cx / cz + 0.5e0, 6) AS u,
  round_even(focal * 1.05e0 * cy / cz + 0.28125e0, 6) AS v FROM px WHERE cz > 1e-9""")
def q_projected_whole(T):
    m = T["poses"].select("match_id").distinct().select("match_id", F.lit(L).alias("length"), F.lit(W).alias("width"))
    return _six(P.projected_landmarks(P.landmarks(m), T["poses"], _frames(T), _calibrations(T)), "u", "v")


@query("resample_pose", """WITH n AS (SELECT match_id, frame, pan, focal, lead(pan) OVER w AS np, lead(focal) OVER w AS nf FROM poses
  WINDOW w AS (PARTITION BY match_id ORDER BY frame)), k AS (SELECT unnest(range(0, 12000)) AS k)
SELECT match_id, k.k, round_even(cos(pan + coalesce(np - pan, 0e0) * (k.k * 5e0 / 12e0 - frame)), 6) AS q0,
  round_even(focal + coalesce(nf - focal, 0e0) * (k.k * 5e0 / 12e0 - frame), 6) AS focal
FROM n JOIN k ON k.k * 5 >= frame * 12 AND k.k * 5 < (frame + 1) * 12 AND (np IS NOT NULL OR k.k * 5 = frame * 12)""")
def q_resample_pose(T):
    from ..operators.paths import resample_pose
    out = resample_pose(_frames(T), 5.0, 12.0)
    return out.select("match_id", "k", F.bround(F.col("q")[0], 6).alias("q0"), F.bround("focal", 6).alias("focal"))


@query("dedupe_clicks", """SELECT match_id, frame, label, max(pid) AS pid, arg_max(u, pid) AS u FROM clicks
  GROUP BY 1, 2, 3""")
def q_clicks(T):
    return P.dedupe_clicks(T["clicks"])[0].select("match_id", "frame", "label", "pid", "u")


@query("repeated_labels", """SELECT DISTINCT match_id, label FROM (SELECT match_id, frame, label FROM clicks
  GROUP BY 1, 2, 3 HAVING count(*) > 1) a""")
def q_repeated(T):
    return P.dedupe_clicks(T["clicks"])[1]


def _h():
    return F.array(*[F.col(f"h{i}") for i in range(9)])


@query("step_ok", """SELECT match_id, frame FROM steps WHERE h0 * h4 - h1 * h3 > 0 AND h0 * h4 - h1 * h3
  BETWEEN 1e0 / (2.2e0 * 2.2e0) AND 2.2e0 * 2.2e0 AND abs(h6) < 0.5e0 AND abs(h7) < 0.5e0""")
def q_step(T):
    return T["steps"].where(G.step_ok(_h())).select("match_id", "frame")


@query("apply_homography", """SELECT match_id, frame, round_even((h0 * 0.5e0 + h1 * 0.3e0 + h2) / w, 6) AS u,
  round_even((h3 * 0.5e0 + h4 * 0.3e0 + h5) / w, 6) AS v FROM (SELECT *, CASE WHEN abs(h6 * 0.5e0 + h7 * 0.3e0 + h8) < 1e-12
    THEN 1e-12 ELSE h6 * 0.5e0 + h7 * 0.3e0 + h8 END AS w FROM steps) a""")
def q_homography(T):
    u, v = G.apply_homography(_h(), F.lit(0.5), F.lit(0.3))
    return T["steps"].select("match_id", "frame", F.bround(u, 6).alias("u"), F.bround(v, 6).alias("v"))


@query("log_orientation", """WITH h AS (SELECT match_id, frame, last_value(yaw IGNORE NULLS) OVER (PARTITION BY match_id
  ORDER BY frame ROWS UNBOUNDED PRECEDING) AS y FROM poses)
SELECT match_id, frame, CASE WHEN y IS NULL THEN 1e0 ELSE round_even(cos(radians(0.8e0 * (y + 10e0))), 6) END AS q0,
  CASE WHEN y IS NULL THEN 0e0 ELSE round_even(sin(radians(0.8e0 * (y + 10e0))), 6) END AS q2 FROM h""")
def q_orientation(T):
    model = T["poses"].select("match_id").distinct().select(
        "match_id", F.array(F.lit(0.0), F.lit(2.0), F.lit(0.0)).alias("axis"), F.lit(0.8).alias("scale"),
        F.lit(-10.0).alias("yaw0"))
    out = P.log_orientation(T["poses"], model)
    return out.select("match_id", "frame", F.bround(F.col("q")[0], 6).alias("q0"), F.bround(F.col("q")[2], 6).alias("q2"))


@query("apply_drift", """WITH p AS (SELECT f.match_id, f.frame, f.focal, a.frame AS af, a.turn AS at_, a.scale AS as_
  FROM poses f ASOF LEFT JOIN anchors a ON a.match_id = f.match_id AND a.frame <= f.frame),
b AS (SELECT p.*, n.frame AS nf, n.turn AS nt, n.scale AS ns
  FROM p ASOF LEFT JOIN anchors n ON n.match_id = p.match_id AND n.frame >= p.frame),
s AS (SELECT *, CASE WHEN nf > af THEN (frame - af) / CAST(nf - af AS DOUBLE) ELSE 0e0 END AS sh FROM b)
SELECT match_id, frame, round_even(cos(tt), 6) AS c, round_even(sin(tt), 6) AS s, round_even(focal * sc, 6) AS focal FROM (
  SELECT match_id, frame, focal, CASE WHEN at_ IS NOT NULL AND nt IS NOT NULL THEN at_ + sh * (nt - at_)
    ELSE coalesce(at_, nt, 0e0) END AS tt, CASE WHEN at_ IS NOT NULL AND nt IS NOT NULL THEN as_ + sh * (ns - as_)
    ELSE coalesce(as_, ns, 1e0) END AS sc FROM s) z""")
def q_drift(T):
    frames = T["poses"].select("match_id", "frame", G.identity().alias("q"), "focal")
    out = P.apply_drift(frames, _anchors(T))
    return out.select("match_id", "frame", F.bround(F.col("q")[0], 6).alias("c"), F.bround(F.col("q")[3], 6).alias("s"),
                      F.bround("focal", 6).alias("focal"))


@query("pan_scale", """WITH w(size) AS (VALUES (20), (10), (5)),
s AS (SELECT a.match_id, w.size, a.pan - b.pan AS signed, a.yaw - b.yaw AS dyaw FROM w, poses a
    JOIN poses b ON b.match_id = a.match_id WHERE b.frame = a.frame - w.size AND a.frame % w.size = 0 AND a.ok AND b.ok
    AND abs(a.yaw - b.yaw) >= 1e0 AND abs(a.pan - b.pan) >= 1e-9),
c AS (SELECT match_id, max(size) AS size FROM (SELECT match_id, size FROM s GROUP BY 1, 2 HAVING count(*) >= 30) z GROUP BY 1),
m AS (SELECT s.match_id, quantile_cont(signed / radians(dyaw), 0.5) AS scale, count(*) AS samples FROM s
  JOIN c ON c.match_id = s.match_id AND c.size = s.size GROUP BY 1)
SELECT m.match_id, round_even(scale, 6) AS scale, samples, (SELECT arg_min(yaw, frame) FROM poses p WHERE
  p.match_id = m.match_id AND yaw IS NOT NULL) AS yaw0 FROM m WHERE abs(scale) >= 0.2e0""")
def q_pan(T):
    out = P.pan_scale(_frames(T))
    return out.select("match_id", F.bround("scale", 6).alias("scale"), "samples", "yaw0")


@query("calibration_flags", """SELECT match_id, CASE WHEN ill THEN 'ill-conditioned' WHEN ambiguous THEN 'ambiguous'
  WHEN focal_scale >= 1.8e0 - 1e-3 THEN 'lens at the top of its range'
  WHEN focal_scale <= 0.6e0 + 1e-3 THEN 'lens at the bottom of its range'
  WHEN height <= 0.8e0 + 1e-3 OR height >= 12e0 - 1e-3 THEN 'height at the edge of its range' END AS flag,
  height >= 1e0 AND height <= 5e0 AS tripod FROM calibs""")
def q_flags(T):
    flag = N.calibration_flags(F.col("height"), F.col("focal_scale"), F.col("ill"), F.col("ambiguous"))
    return T["calibs"].select("match_id", flag.alias("flag"), F.col("height").between(1.0, 5.0).alias("tripod"))


@query("diagnose_fit", """SELECT match_id, round_even(tol, 6) AS tolerance_m,
  (CASE WHEN r0 <= tol THEN '0' ELSE '' END) || (CASE WHEN r1 <= tol THEN '1' ELSE '' END)
    || (CASE WHEN r2 <= tol THEN '2' ELSE '' END) AS agreeing
FROM (SELECT *, greatest(2e0, least(r0, r1, r2) * 3e0) AS tol FROM calibs) a""")
def q_diagnose(T):
    out = P.diagnose_fit(T["calibs"].select("match_id", F.array("r0", "r1", "r2").alias("residuals")))
    return out.select("match_id", F.bround("tolerance_m", 6).alias("tolerance_m"),
                      F.concat_ws("", F.transform("agreeing", lambda i: i.cast("string"))).alias("agreeing"))
