"""Adapters between recorded samples and a model's inputs and outputs, by robot."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions import arrays, control, images
from strideframe.operators.transforms import Encode, Group, default_prompt, extract_actions, tokenise_actions, tokenise_prompt
from strideframe.plans.pipelines import register
from strideframe.schema import ACTION_DIM, MODEL_DIM

BASE, LEFT, RIGHT = "base_0_rgb", "left_wrist_0_rgb", "right_wrist_0_rgb"
#: Fixed values of a two-armed robot: signs of its joints, and where its grippers stand.
FLIP = [1, -1, -1, 1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1]
GRIPPERS = (6, 13)


def image_slots(df: DataFrame, slots: dict[str, str | None], always: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """image and image_mask by slot from the cameras of ``images``; a slot without a camera is black and masked.

    ``always``: black slots that are not masked. A camera that is neither there nor optional is an error.
    """
    have = set(df.schema["images"].dataType.names)
    for camera in slots.values():
        if camera and camera not in have and camera not in optional:
            raise ValueError(f"camera {camera} is missing")
    base = F.col(f"images.{slots[BASE]}")
    seen = {s: c in have for s, c in slots.items()}
    image = F.struct(*[(F.col(f"images.{c}") if seen[s] else images.black_like(base)).alias(s) for s, c in slots.items()])
    mask = F.struct(*[F.lit(seen[s] or s in always).alias(s) for s in slots])
    return df.withColumn("image", image).withColumn("image_mask", mask).drop("images")


def chunk(fn) -> Column:
    return F.transform("actions", fn)


def cut_outputs(width: int):
    """Actions cut to the robot's dimensions."""
    return lambda df: df.withColumn("actions", chunk(lambda r: F.slice(r, 1, width)))


def _grippers(row: Column, fn) -> Column:
    return F.transform(row, lambda v, i: F.when(i.isin(*GRIPPERS), fn(v)).otherwise(v))


def padded(df: DataFrame, dim: int) -> DataFrame:
    """State and actions at the model's width; the action mask holds in the recorded dimensions only."""
    state = arrays.pad_to(F.coalesce("state", F.array().cast("array<double>")), dim) if "state" in df.columns else F.array_repeat(F.lit(0.0), dim)
    df = df.withColumn("state", state)
    if "actions" not in df.columns:
        return df
    known = F.col("action_mask") if "action_mask" in df.columns else chunk(lambda r: F.transform(r, lambda _: F.lit(True)))
    mask = F.transform(known, lambda m: F.concat(m, F.array_repeat(F.lit(False), F.greatest(dim - F.size(m), F.lit(0)))))
    return df.withColumn("action_mask", mask).withColumn("actions", chunk(lambda r: arrays.pad_to(r, dim)))


@register("humanoid")
def humanoid(dim: int = MODEL_DIM, hide_state: bool = False) -> Group:
    """One head camera; the wrists are black and masked. ``hide_state`` puts zeros for the state."""

    def state(df: DataFrame) -> DataFrame:
        return df.withColumn("state", F.transform("state", lambda _: F.lit(0.0))) if hide_state else df

    return Group(inputs=(lambda df: image_slots(df, {BASE: "head_left", LEFT: None, RIGHT: None}), lambda df: padded(df, dim), state), outputs=(cut_outputs(ACTION_DIM),))


@register("two_arm")
def two_arm(adapt: bool = True) -> Group:
    """Fourteen joints, grippers among them, between the robot's and the model's spaces."""
    cameras = {BASE: "cam_high", LEFT: "cam_left_wrist", RIGHT: "cam_right_wrist"}

    def state(df: DataFrame) -> DataFrame:
        return df.withColumn("state", _grippers(control.flip_joints(F.col("state"), FLIP), control.gripper_to_angular)) if adapt else df

    def actions(df: DataFrame) -> DataFrame:
        return df.withColumn("actions", chunk(lambda r: _grippers(control.flip_joints(r, FLIP), control.gripper_from_angular_back))) if adapt and "actions" in df.columns else df

    def back(df: DataFrame) -> DataFrame:
        return df.withColumn("actions", chunk(lambda r: _grippers(control.flip_joints(r, FLIP), control.gripper_from_angular))) if adapt else df

    return Group(inputs=(lambda df: image_slots(df, cameras, optional=("cam_left_wrist", "cam_right_wrist")), state, actions), outputs=(cut_outputs(14), back))


@register("single_arm")
def single_arm(fast: bool = False) -> Group:
    """Seven joints and a gripper as the state; image slots depend on the kind of model."""
    slots = {BASE: "exterior", "base_1_rgb": None, "wrist_0_rgb": "wrist"} if fast else {BASE: "exterior", LEFT: "wrist", RIGHT: None}

    def state(df: DataFrame) -> DataFrame:
        grip = F.col("gripper_position")
        grip = grip if dict(df.dtypes)["gripper_position"].startswith("array") else F.array(grip)
        return df.withColumn("state", F.concat(F.col("joint_position").cast("array<double>"), grip.cast("array<double>"))).drop("joint_position", "gripper_position")

    return Group(inputs=(state, lambda df: image_slots(df, slots, always=("base_1_rgb",) if fast else ())), outputs=(cut_outputs(8),))


@register("table_arm")
def table_arm(fast: bool = False) -> Group:
    """State of eight, two cameras; seven action dimensions come back."""
    return Group(inputs=(lambda df: image_slots(df, {BASE: "image", LEFT: "wrist_image", RIGHT: None}, always=(RIGHT,) if fast else ()),), outputs=(cut_outputs(7),))


@register("two_hand")
def two_hand(dim: int = MODEL_DIM, hide_state: bool = False) -> Group:
    """Three cameras; values beyond half a turn are faults and become 0."""

    def zeroed(df: DataFrame) -> DataFrame:
        state = F.transform("state", lambda _: F.lit(0.0)) if hide_state else arrays.zero_out_of_range(F.col("state"), math.pi)
        df = df.withColumn("state", state)
        return df.withColumn("actions", chunk(lambda r: arrays.zero_out_of_range(r, math.pi))) if "actions" in df.columns else df

    return Group(inputs=(lambda df: image_slots(df, {BASE: "top_head", LEFT: "hand_left", RIGHT: "hand_right"}), lambda df: padded(df, dim), zeroed), outputs=(cut_outputs(14),))


def resized(height: int, width: int):
    """Every image of a sample at one size."""

    def run(df: DataFrame) -> DataFrame:
        names = df.schema["image"].dataType.names
        return df.withColumn("image", F.struct(*[images.each_image(F.col(f"image.{n}"), lambda x: images.resize_with_pad(x, height, width)).alias(n) for n in names]))

    return run


#: Height and width of what a model sees.
SEEN = (224, 224)


@register("flow_model")
def flow_model(encode: Encode, length: int, dim: int = MODEL_DIM, prompt: str | None = None, with_state: bool = False) -> Group:
    """What a model of continuous actions takes: images of one size, prompt tokens (with the state's digits if asked for), and vectors of its width."""
    return Group(inputs=(default_prompt(prompt), resized(*SEEN), tokenise_prompt(encode, length, with_state), lambda df: padded(df, dim)))


@register("token_model")
def token_model(encode: Encode, encode_actions: Callable[[Column], Column], decode_actions: Callable[[Column], Column], end: list[int], length: int, horizon: int, dim: int, prompt: str | None = None) -> Group:
    """What a model that writes actions as tokens takes, and its actions from the tokens that it gives."""
    return Group(inputs=(default_prompt(prompt), resized(*SEEN), tokenise_actions(encode, encode_actions, end, length)), outputs=(extract_actions(decode_actions, horizon, dim),))


def observation(df: DataFrame) -> DataFrame:
    """Images as [-1, 1], and prompt tokens only together with their mask."""
    if ("tokenized_prompt" in df.columns) != ("tokenized_prompt_mask" in df.columns):
        raise ValueError("prompt tokens and their mask come together")
    names = df.schema["image"].dataType.names
    return df.withColumn("image", F.struct(*[images.each_image(F.col(f"image.{n}"), images.unit_range).alias(n) for n in names]))
