"""Camera geometry as column expressions: 3x3 algebra is unrolled so it stays inside generated code.

A matrix is an ``ARRAY<DOUBLE>`` of nine numbers in row order. Image positions are divided by the frame width.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]

# Fixed values of the projection rules
FULL_WIDTH = 1920.0
FOOT_PIXELS = 4.0
MAX_STEP_SCALE = 2.2
MAX_STEP_PERSPECTIVE = 0.5


def m(matrix: Column, row: int, col: int) -> Column:
    return matrix[3 * row + col]


def times(matrix: Column, v: Vec) -> Vec:
    return tuple(m(matrix, r, 0) * v[0] + m(matrix, r, 1) * v[1] + m(matrix, r, 2) * v[2] for r in range(3))


def transposed_times(matrix: Column, v: Vec) -> Vec:
    return tuple(m(matrix, 0, c) * v[0] + m(matrix, 1, c) * v[1] + m(matrix, 2, c) * v[2] for c in range(3))


def product(a: Column, b: Column, *, transpose_a: bool = False, transpose_b: bool = False) -> Column:
    def left(r, k):
        return m(a, k, r) if transpose_a else m(a, r, k)

    def right(k, c):
        return m(b, c, k) if transpose_b else m(b, k, c)

    return F.array(*[sum((left(r, k) * right(k, c) for k in range(1, 3)), left(r, 0) * right(0, c))
                     for r in range(3) for c in range(3)])


def ground_hit(u: Column, v: Column, q: Column, focal: Column, base: Column, position: Column,
               focal_scale: Column, aspect: Column) -> tuple[Column, Column]:
    """Where the ray through ``(u, v)`` meets the ground; NULL at or above the horizon."""
    k = focal * focal_scale
    cam = ((u - 0.5) / k, (v - aspect * 0.5) / k, F.lit(1.0))
    wx, wy, wz = times(base, times(q, cam))
    norm = F.sqrt(wx * wx + wy * wy + wz * wz)
    down = (wz / norm) < -1e-6
    reach = -position[2] / F.when(down, wz)
    return position[0] + reach * wx, position[1] + reach * wy


def to_pixels(x: Column, y: Column, q: Column, focal: Column, base: Column, position: Column,
              focal_scale: Column, aspect: Column) -> tuple[Column, Column]:
    """Image position of a ground point; NULL behind the camera."""
    k = focal * focal_scale
    world = (x - position[0], y - position[1], -position[2])
    cx, cy, cz = transposed_times(q, transposed_times(base, world))
    z = F.when(cz > 1e-9, cz)
    return k * cx / z + 0.5, k * cy / z + aspect * 0.5


def apply_homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    px, py, pw = times(h, (x, y, F.lit(1.0)))
    w = F.when(F.abs(pw) < 1e-12, F.lit(1e-12)).otherwise(pw)
    return px / w, py / w


def step_ok(h: Column) -> Column:
    """Whether a frame-to-frame camera step is plausible."""
    finite = F.forall(h, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(math.inf)))
    det = h[0] * h[4] - h[1] * h[3]
    top = MAX_STEP_SCALE ** 2
    ok = (det > 0) & det.between(1.0 / top, top)
    return finite & ok & (F.abs(h[6]) < MAX_STEP_PERSPECTIVE) & (F.abs(h[7]) < MAX_STEP_PERSPECTIVE)


def identity() -> Column:
    return F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])


def with_rotation_vector(df: DataFrame, matrix: str, out: tuple[str, str, str]) -> DataFrame:
    """Add axis times angle of the rotation matrix column ``matrix``.

    Staged in columns: as one expression the shared parts would be written out again for every use.
    """
    r = F.col(matrix)
    df = df.withColumns({
        "_rc": F.least(F.greatest((m(r, 0, 0) + m(r, 1, 1) + m(r, 2, 2) - 1.0) / 2.0, F.lit(-1.0)), F.lit(1.0)),
        "_rx": m(r, 2, 1) - m(r, 1, 2), "_ry": m(r, 0, 2) - m(r, 2, 0), "_rz": m(r, 1, 0) - m(r, 0, 1)})
    df = df.withColumn("_rs", F.sqrt(F.col("_rx") ** 2 + F.col("_ry") ** 2 + F.col("_rz") ** 2) / 2.0)
    angle = F.atan2(F.col("_rs"), F.col("_rc"))
    df = df.withColumn("_rk", F.when(F.col("_rs") > 1e-9, angle / F.nullif(F.col("_rs") * 2.0, F.lit(0.0)))
                       .otherwise(F.lit(0.5)))
    df = df.withColumns({name: F.col(c) * F.col("_rk") for name, c in zip(out, ("_rx", "_ry", "_rz"))})
    return df.drop("_rc", "_rx", "_ry", "_rz", "_rs", "_rk")


def with_rotation(df: DataFrame, vector: tuple[Column, Column, Column], out: str) -> DataFrame:
    """Add the rotation matrix of an axis-times-angle vector (NULL stays NULL)."""
    df = df.withColumns(dict(zip(("_vx", "_vy", "_vz"), vector)))
    df = df.withColumn("_va", F.sqrt(F.col("_vx") ** 2 + F.col("_vy") ** 2 + F.col("_vz") ** 2))
    safe = F.when(F.col("_va") < 1e-12, F.lit(1.0)).otherwise(F.col("_va"))
    df = df.withColumns({"_ux": F.col("_vx") / safe, "_uy": F.col("_vy") / safe, "_uz": F.col("_vz") / safe,
                         "_uc": F.cos("_va"), "_us": F.sin("_va")})
    ux, uy, uz, c, s = (F.col(n) for n in ("_ux", "_uy", "_uz", "_uc", "_us"))
    t = F.lit(1.0) - c
    turned = F.array(
        c + ux * ux * t, ux * uy * t - uz * s, ux * uz * t + uy * s,
        uy * ux * t + uz * s, c + uy * uy * t, uy * uz * t - ux * s,
        uz * ux * t - uy * s, uz * uy * t + ux * s, c + uz * uz * t)
    made = F.when(F.col("_va").isNull(), F.lit(None)).when(F.col("_va") < 1e-12, identity()).otherwise(turned)
    return df.withColumn(out, made).drop("_vx", "_vy", "_vz", "_va", "_ux", "_uy", "_uz", "_uc", "_us")


def with_between_rotations(df: DataFrame, first: str, second: str, share: Column, out: str) -> DataFrame:
    """Add the rotation ``share`` of the shortest arc from ``first`` to ``second``."""
    df = df.withColumn("_turn", product(F.col(first), F.col(second), transpose_a=True)).withColumn("_share", share)
    df = with_rotation_vector(df, "_turn", ("_tx", "_ty", "_tz"))
    df = with_rotation(df, tuple(F.col(c) * F.col("_share") for c in ("_tx", "_ty", "_tz")), "_part")
    return df.withColumn(out, product(F.col(first), F.col("_part"))).drop(
        "_turn", "_share", "_tx", "_ty", "_tz", "_part")
