"""Geometry as Column expressions: vectors and quaternions are tuples of columns, quaternions scalar-last."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def parts(array: Column, first: int, n: int) -> tuple[Column, ...]:
    """``n`` doubles of an array column from a 0-based index; absent ones are null."""
    return tuple(F.get(array, F.lit(first + i)).cast("double") for i in range(n))


def body_axes(p: Vec) -> Vec:
    """Headset axes to body axes, with the sensor's fixed offset."""
    x, y, z = p
    return (-z + 0.55, -x, y + 0.7)


def mid_point(a: Vec, b: Vec) -> Vec:
    return tuple(0.5 * (i + j) for i, j in zip(a, b))


def wrap_to_pi(a: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def held(x: Column, low: float, high: float) -> Column:
    """A value within bounds; null stays null, which least and greatest would not keep."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def norm(v: tuple[Column, ...]) -> Column:
    return F.sqrt(sum((c * c for c in v[1:]), v[0] * v[0]))


def unit(v: tuple[Column, ...], eps: float = 1e-12) -> tuple[Column, ...]:
    """A vector divided by its length, or by ``eps`` where that is smaller."""
    n = F.greatest(norm(v), F.lit(eps))
    return tuple(c / n for c in v)


def conjugate(q: Quat) -> Quat:
    return (-q[0], -q[1], -q[2], q[3])


def multiply(a: Quat, b: Quat) -> Quat:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def rotate(q: Quat, v: Vec) -> Vec:
    """A vector turned by a unit quaternion."""
    x, y, z, w = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return (v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx)


def relative_pose(base: tuple[Vec, Quat], pose: tuple[Vec, Quat]) -> tuple[Vec, Quat]:
    """The pose seen from the base: its inverse times the pose."""
    (pb, qb), (ph, qh) = base, pose
    back = conjugate(qb)
    return rotate(back, tuple(h - b for h, b in zip(ph, pb))), multiply(back, qh)


def compose_pose(a: tuple[Vec, Quat], b: tuple[Vec, Quat]) -> tuple[Vec, Quat]:
    moved = rotate(a[1], b[0])
    return tuple(i + j for i, j in zip(a[0], moved)), multiply(a[1], b[1])


def rpy(q: Quat) -> Vec:
    """Roll, pitch and yaw about the fixed axes, of a unit quaternion."""
    x, y, z, w = q
    sin_pitch = held(2 * (w * y - x * z), -1.0, 1.0)
    return (
        F.atan2(2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
        F.asin(sin_pitch),
        F.atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z)),
    )


def from_rpy(r: Vec) -> Quat:
    """The quaternion of roll, pitch and yaw about the fixed axes."""
    (cr, cp, cy), (sr, sp, sy) = (tuple(F.cos(a / 2) for a in r), tuple(F.sin(a / 2) for a in r))
    return (sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy)


#: Quaternions of the fixed re-framing turns: world = Rz(-90) Rx(90); hands = X180, and Z180 for the left one.
_H = math.sqrt(0.5)
WORLD_TURN = (0.5, -0.5, -0.5, 0.5)
X180, Z180 = (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)


def literal(values: tuple[float, ...]) -> tuple[Column, ...]:
    return tuple(F.lit(float(v)) for v in values)


def world_frame(p: Vec, q: Quat) -> tuple[Vec, Quat]:
    """Headset world to robot world: position (-z, -x, y), rotation turned from the left."""
    return (-p[2], -p[0], p[1]), multiply(literal(WORLD_TURN), q)


def hand_frame(q: Quat, left: bool) -> Quat:
    """Local axes of a hand: X180 from the right, and Z180 for the left hand."""
    q = multiply(q, literal(X180))
    return multiply(q, literal(Z180)) if left else q


def scalar_last(q: Column) -> Column:
    """[w, x, y, z] to [x, y, z, w]."""
    return F.array(*[F.get(q, F.lit(i)) for i in (1, 2, 3, 0)])


def scalar_first(q: Column) -> Column:
    """[x, y, z, w] to [w, x, y, z]."""
    return F.array(*[F.get(q, F.lit(i)) for i in (3, 0, 1, 2)])


def blend_pose(a: tuple[Vec, Quat], b: tuple[Vec, Quat], t: Column) -> tuple[Vec, Quat]:
    """Linear in position; rotation linear on the shorter arc, then of unit length (unless shorter than 1e-6)."""
    dot = sum((i * j for i, j in zip(a[1][1:], b[1][1:])), a[1][0] * b[1][0])
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    q = tuple(i * (1 - t) + j * sign * t for i, j in zip(a[1], b[1]))
    n = norm(q)
    return tuple(i * (1 - t) + j * t for i, j in zip(a[0], b[0])), tuple(F.when(n > 1e-6, c / n).otherwise(c) for c in q)


def chain_link(angle: Column, alpha: float, a: float, d: float) -> list[list[Column]]:
    """The 4x4 matrix of one modified Denavit-Hartenberg link."""
    c, s = F.cos(angle), F.sin(angle)
    ca, sa = math.cos(alpha), math.sin(alpha)
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[c, -s, zero, F.lit(a)], [s * ca, c * ca, F.lit(-sa), F.lit(-sa * d)], [s * sa, c * sa, F.lit(ca), F.lit(ca * d)], [zero, zero, zero, one]]


def forward_kinematics(angles: list[Column], links: list[tuple[float, float, float, float]]) -> list[list[Column]]:
    """Row-by-row product of the links (alpha, a, d, angle offset): the hand's rotation and position, 3x4."""
    m = None
    for angle, (alpha, a, d, offset) in zip(angles, links):
        n = chain_link(angle + offset, alpha, a, d)
        m = n if m is None else [[sum((m[i][k] * n[k][j] for k in range(1, 4)), m[i][0] * n[0][j]) for j in range(4)] for i in range(3)] + [n[3]]
    return m[:3]


def project(p: Vec, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    """Camera-space point to pixel and depth."""
    return F.try_divide(p[0] * fx, p[2]) + cx, F.try_divide(p[1] * fy, p[2]) + cy, p[2]


def unproject(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Vec:
    """Pixel and depth to a camera-space point."""
    return ((u - cx) / fx * depth, (v - cy) / fy * depth, depth)


def clean_depth(d: Column, far: float = 1e4) -> Column:
    """Unknown depth is far; depths are held in [0, far]."""
    return F.least(F.greatest(F.when(d.isNull() | F.isnan(d), far).otherwise(d), F.lit(0.0)), F.lit(far))


def fit_box(w: Column, h: Column, to_w: int, to_h: int) -> dict[str, Column]:
    """Resize-with-pad geometry: scaled size, and padding before and after."""
    ratio = F.greatest(w / F.lit(float(to_w)), h / F.lit(float(to_h)))
    new_w, new_h = F.floor(w / ratio), F.floor(h / ratio)
    left, top = F.floor((to_w - new_w) / 2), F.floor((to_h - new_h) / 2)
    return {"new_w": new_w, "new_h": new_h, "pad_left": left, "pad_right": to_w - new_w - left, "pad_top": top, "pad_bottom": to_h - new_h - top}


def dolly_offset(step: Column, steps: int, distance: float, center_depth: Column) -> Column:
    """How far the camera has moved at a step of a straight trajectory; the last step falls short of the whole distance."""
    return step * distance * center_depth / steps


def orbit_offset(step: Column, steps: int, radius: Vec, center_depth: Column, *, clockwise: bool = True, from_zero: bool = True, circles: float = 1) -> Vec:
    """Where the camera stands at a step of a circling trajectory of at least two steps; it begins at its rest place, or a radius beside it."""
    if steps < 2:
        raise ValueError("a circling trajectory has two steps at least")
    angle = step * (2 * math.pi * circles / (steps - 1))
    side = (F.cos(angle) - 1) * (1 if clockwise else -1) if from_zero else F.cos(angle)
    return (radius[0] * side * center_depth, radius[1] * F.sin(angle) * center_depth, radius[2] * F.sin(angle) * center_depth)


#: Straight trajectories by name: the axis (x to the right, y down, z forward) and the direction along it.
MOVES = {"left": (0, -1), "right": (0, 1), "up": (1, -1), "down": (1, 1), "zoom_in": (2, 1), "zoom_out": (2, -1)}


def camera_step(kind: str, step: Column, steps: int, distance: float, center_depth: Column, turn: str = "center_facing") -> list[list[Column]]:
    """The 3x4 view of a camera at a step of a named trajectory, one of MOVES, or a circle clockwise or counterclockwise."""
    if kind in MOVES:
        axis, sign = MOVES[kind]
        way = dolly_offset(step, steps, distance, center_depth) * sign
        offset = tuple(way if i == axis else F.lit(0.0) for i in range(3))
    elif kind in ("clockwise", "counterclockwise"):
        offset = orbit_offset(step, steps, literal((distance, distance, 0.0)), center_depth, clockwise=kind == "clockwise")
    else:
        raise ValueError(f"{kind} is no trajectory")
    return look_at(offset, dolly_target(offset, center_depth, turn))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def look_at(camera: Vec, target: Vec) -> list[list[Column]]:
    """Rows right, up and forward of a camera that faces a target, y being up; the last column is where the world's origin was moved from."""
    forward = unit(tuple(t - c for t, c in zip(target, camera)))
    right = unit(cross(literal((0.0, 1.0, 0.0)), forward))
    up = cross(forward, right)
    return [[*row, -c] for row, c in zip((right, up, forward), camera)]


def transformed(m: list[list[Column]], p: Vec) -> Vec:
    """A point through a 3x4 matrix."""
    return tuple(r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + r[3] for r in m)


def pixel_ray(u: Column, v: Column, fx: float, fy: float, cx: float, cy: float) -> Vec:
    """The unit direction in which a pixel looks."""
    return unit(((u - cx) / fx, (v - cy) / fy, F.lit(1.0)))


def dolly_target(offset: Vec, depth: Column, turn: str) -> Vec:
    """What the camera faces on a straight trajectory: the centre, the centre moved along, or moved twice as far."""
    times = {"center_facing": 0, "no_rotation": 1, "trajectory_aligned": 2}[turn]
    return (offset[0] * times, offset[1] * times, depth + offset[2] * times)
