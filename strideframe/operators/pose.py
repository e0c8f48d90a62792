"""Poses along an episode: differences, replay and smoothing of rotations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import geometry as G
from strideframe.operators.frames import KEY, ORDER, in_order
from strideframe.operators.sequence import continuous_sign, savgol_coefficients, savgol_shape

POSE = ("px", "py", "pz", "qx", "qy", "qz", "qw")


def pose_columns(array, first: int = 0) -> dict:
    """The seven columns of a pose in an array; the rotation is brought to unit length."""
    p, q = G.parts(array, first, 3), G.unit(G.parts(array, first + 3, 4))
    return dict(zip(POSE, (*p, *q)))


def pose_delta(df: DataFrame) -> DataFrame:
    """dx, dy, dz, roll, pitch, yaw from the frame before to this one, seen from the frame before; 0 at the first."""
    w = in_order()
    now = tuple(F.col(c) for c in POSE)
    old = tuple(F.lag(c).over(w) for c in POSE)
    moved, turned = G.relative_pose((old[:3], old[3:]), (now[:3], now[3:]))
    out = dict(zip(("dx", "dy", "dz", "roll", "pitch", "yaw"), (*moved, *G.rpy(turned))))
    return df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()})


def continuous_rotation(df: DataFrame) -> DataFrame:
    """Quaternions with the signs that keep neighbours close."""
    signed = continuous_sign(df, list(POSE[3:]), "sign__")
    return signed.withColumns({c: F.col(c) * F.col("sign__") for c in POSE[3:]}).drop("sign__")


def replay(deltas: DataFrame, start: tuple[float, ...] = (0, 0, 0, 0, 0, 0, 1)) -> DataFrame:
    """Poses from differences (dx, dy, dz, roll, pitch, yaw), one upon the other, from a start pose.

    Products of poses do not commute but can be grouped freely, so an episode is one group in numpy, in which all running
    products are found by doubling steps: n log n work on whole arrays.
    """
    q = G.from_rpy(tuple(F.col(c) for c in ("roll", "pitch", "yaw")))
    moves = deltas.select(KEY, ORDER, *[F.col(c).cast("double").alias(n) for c, n in zip(("dx", "dy", "dz"), POSE)], *[c.alias(n) for c, n in zip(q, POSE[3:])])

    def run(frames):
        frames = frames.sort_values(ORDER)
        p, r = (tuple(frames[c].to_numpy(copy=True) for c in part) for part in (POSE[:3], POSE[3:]))
        head = G.rotate(start[3:], tuple(c[:1] for c in p)), G.multiply(start[3:], tuple(c[:1] for c in r))
        for c, v, at in zip(p, head[0], start[:3]):
            c[:1] = v + at
        for c, v in zip(r, head[1]):
            c[:1] = v
        step = 1
        while step < len(frames):
            before = tuple(c[:-step].copy() for c in r)
            moved = G.rotate(before, tuple(c[step:] for c in p))
            turned = G.multiply(before, tuple(c[step:] for c in r))
            moved = [c[:-step] + m for c, m in zip(p, moved)]
            for c, v in zip((*p, *r), (*moved, *turned)):
                c[step:] = v
            step *= 2
        return frames.assign(**dict(zip(POSE, (*p, *r))))

    kinds = {f.name: f.dataType.simpleString() for f in moves.schema.fields}
    return moves.groupBy(KEY).applyInPandas(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def smooth_rotation(df: DataFrame, window: int, order: int, passes: int = 1) -> DataFrame:
    """Rotations smoothed in the tangent space of the middle frame: logarithm, Savitzky-Golay for each axis, exponential.

    The tangent space depends on the whole episode, so each episode goes to numpy as one group.
    """

    def multiply(a, b):
        x, y, z, w = a.T
        bx, by, bz, bw = b.T
        return np.stack([w * bx + x * bw + y * bz - z * by, w * by - x * bz + y * bw + z * bx, w * bz + x * by - y * bx + z * bw, w * bw - x * bx - y * by - z * bz], 1)

    def each(pdf):
        pdf = pdf.sort_values(ORDER)
        q = pdf[list(POSE[3:])].to_numpy(float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        for _ in range(passes if len(q) >= 3 else 0):
            mid = q[len(q) // 2]
            rel = multiply(np.broadcast_to(mid * [-1, -1, -1, 1], q.shape), q)
            rel *= np.where(rel[:, 3:] < 0, -1, 1)
            n = np.linalg.norm(rel[:, :3], axis=1, keepdims=True)
            log = rel[:, :3] * np.where(n > 1e-12, 2 * np.arctan2(n, rel[:, 3:]) / np.maximum(n, 1e-12), 2.0)
            wl, po = savgol_shape(len(q), window, order)
            h = savgol_coefficients(wl, po)[::-1]
            log = np.stack([np.convolve(np.pad(log[:, k], wl // 2, mode="edge"), h, mode="valid") for k in range(3)], 1)
            angle = np.linalg.norm(log, axis=1, keepdims=True)
            back = np.concatenate([log * np.where(angle > 1e-12, np.sin(angle / 2) / np.maximum(angle, 1e-12), 0.5), np.cos(angle / 2)], 1)
            q = multiply(np.broadcast_to(mid, back.shape), back)
        return pdf.assign(**dict(zip(POSE[3:], q.T)))

    return df.groupBy(KEY).applyInPandas(each, df.schema)
