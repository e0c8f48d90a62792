"""Whole pipelines: a recording to training frames, training batches, the statistics job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import arrays, control
from strideframe.functions import geometry as G
from strideframe.operators import asof, resample, sequence, stats
from strideframe.operators.frames import KEY, ORDER
from strideframe.operators.transforms import Group, compose
from strideframe.schema import LEFT_HIP, MODEL_DIM, RIGHT_HIP, SEVERE_MS, WARN_MS

REGISTRY: dict[str, Callable[..., Group]] = {}


def register(name: str):
    """Named groups of transforms, looked up by configuration."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        REGISTRY[name] = fn
        return fn

    return add


def named(name: str, **options) -> Group:
    if name not in REGISTRY:
        raise KeyError(f"{name} is none of {sorted(REGISTRY)}")
    return REGISTRY[name](**options)


def run_group(group: Group, df: DataFrame) -> DataFrame:
    return compose(*group.inputs)(df)


def hip_path(frames: DataFrame) -> DataFrame:
    """x, y, z: the middle of the hips in body axes, from body_pose."""
    def joint(i: int):
        return G.parts(F.get("body_pose", F.lit(i)), 0, 3)

    p = G.body_axes(G.mid_point(joint(LEFT_HIP), joint(RIGHT_HIP)))
    return frames.withColumns(dict(zip("xyz", p)))


def navigation(frames: DataFrame, dt: float, seconds: float = 15.0, lag: int = 5) -> DataFrame:
    """Path to commands: smoothed path and baseline, direction, continuous heading, velocities. All windows share one exchange by episode."""
    wide = sequence.window_frames(seconds, dt)
    path = sequence.smooth(sequence.smooth(frames, "x", "sx", 11, 3), "y", "sy", 11, 3)
    path = sequence.smooth_wide(sequence.smooth_wide(path, "sx", "bx", wide, 3), "sy", "by", wide, 3)
    turned = sequence.with_tangent(path, "bx", "by", lag)
    signed = sequence.continuous_sign(turned, ["dir_x", "dir_y"])
    signed = signed.withColumn("hx", F.col("dir_x") * F.col("sign")).withColumn("hy", F.col("dir_y") * F.col("sign"))
    return sequence.navigation_command(signed, "sx", "sy", "hx", "hy", dt).drop("bx", "by", "dir_x", "dir_y", "sign", "hx", "hy")


def downsample(frames: DataFrame, ratio: int = 5) -> DataFrame:
    """Mean commands, levels, height differences and first times of blocks."""
    blocks = resample.blocks(frames, ratio, *[resample.block_mean(c) for c in ("vx", "vy", "yaw_rate", "z")], resample.block_first("ts_ns"))
    levels = control.discretise(F.col("vx"), F.col("vy"), F.col("yaw_rate"))
    return blocks.withColumns(dict(zip(("cmd_vx", "cmd_vy", "cmd_yaw"), levels))).withColumn("delta_height", sequence.delta("z"))


def with_camera(frames: DataFrame, camera: DataFrame, columns: list[str]) -> DataFrame:
    """The nearest camera frame of each frame, its distance and its level."""
    matched = asof.nearest(frames, camera, KEY, "ts_ns", columns)
    diff = F.abs(F.col("match_ts") - F.col("ts_ns")) / 1e6
    return matched.withColumn("timestamp_diff_ms", diff).withColumn("sync", asof.match_level(diff, WARN_MS, SEVERE_MS))


def human_episode(frames: DataFrame, camera: DataFrame, dt: float = 0.01, ratio: int = 5, seconds: float = 15.0) -> DataFrame:
    """A human recording to down-sampled training frames: one lazy plan, no files in between."""
    return with_camera(downsample(navigation(hip_path(frames), dt, seconds), ratio), camera, ["image_left"])


@register("delta_chunks")
def delta_chunks(mask: list[bool] | None = None, dim: int = MODEL_DIM) -> Group:
    """State and chunk to the model's width; actions become differences where the mask holds."""

    def delta(df: DataFrame) -> DataFrame:
        return df.withColumn("actions", arrays.delta_actions(F.col("actions"), F.col("state"), mask))

    def pad(df: DataFrame) -> DataFrame:
        return df.withColumn("state", arrays.pad_to(F.coalesce("state", F.array().cast("array<double>")), dim)).withColumn("actions", F.transform("actions", lambda r: arrays.pad_to(r, dim)))

    def back(df: DataFrame) -> DataFrame:
        return df.withColumn("actions", F.transform("actions", lambda r: F.slice(r, 1, 18)))

    def absolute(df: DataFrame) -> DataFrame:
        return df.withColumn("actions", arrays.absolute_actions(F.col("actions"), F.col("state"), mask))

    return Group(inputs=(delta, pad), outputs=(absolute, back))


def training_chunks(frames: DataFrame, actions: str, horizon: int) -> DataFrame:
    """Each frame with the actions of its next ``horizon`` frames."""
    return frames.select(KEY, ORDER, sequence.look_ahead(actions, horizon).alias("actions"), sequence.look_ahead_pad(horizon).alias("is_pad"))


def norm_statistics(frames: DataFrame, parts: list[str], dim: int = MODEL_DIM) -> DataFrame:
    """Statistics of concatenated actions at the model's width, with histogram quantiles."""
    joined = frames.select(arrays.fit_to(F.concat(*[F.col(p).cast("array<double>") for p in parts]), dim).alias("a"))
    long = stats.by_dimension(joined, "a")
    hist = stats.histogram(long)
    low, high = (stats.histogram_quantile(hist, q).withColumnRenamed("value", n) for q, n in ((0.01, "q01"), (0.99, "q99")))
    return stats.running_stats(long).join(low, "dim").join(high, "dim")
