"""Table schemas of episodes, and layout constants of the recorded arrays."""

from __future__ import annotations

from pyspark.sql import types as T

_VEC = T.ArrayType(T.DoubleType())

#: One row for each frame of a human recording.
HUMAN_FRAMES = T.StructType(
    [
        T.StructField("episode_id", T.LongType(), False),
        T.StructField("frame_index", T.IntegerType(), False),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("body_pose", T.ArrayType(_VEC)),
        T.StructField("left_controller_pose", _VEC),
        T.StructField("right_controller_pose", _VEC),
        T.StructField("left_hand_pose", T.ArrayType(_VEC)),
        T.StructField("right_hand_pose", T.ArrayType(_VEC)),
        T.StructField("left_hand_active", T.IntegerType()),
        T.StructField("right_hand_active", T.IntegerType()),
    ]
)

#: One row for each frame of a robot recording; poses are two times [x, y, z, qw, qx, qy, qz].
ROBOT_FRAMES = T.StructType(
    [
        T.StructField("episode_id", T.LongType(), False),
        T.StructField("frame_index", T.IntegerType(), False),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("observation_state", _VEC),
        T.StructField("action", _VEC),
        T.StructField("observation_eef_state", _VEC),
        T.StructField("action_eef", _VEC),
        T.StructField("teleop_navigate_command", _VEC),
        T.StructField("teleop_base_height_command", T.DoubleType()),
        T.StructField("hand_status", T.ArrayType(T.IntegerType())),
    ]
)

#: Frames of a stereo camera, in their order.
CAMERA_FRAMES = T.StructType(
    [
        T.StructField("episode_id", T.LongType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("image_left", T.BinaryType()),
        T.StructField("image_right", T.BinaryType()),
    ]
)

#: What training reads.
TRAINING_FRAMES = T.StructType(
    [
        T.StructField("episode_id", T.LongType(), False),
        T.StructField("frame_index", T.IntegerType(), False),
        T.StructField("image_left", T.BinaryType()),
        T.StructField("action_eef", T.ArrayType(T.FloatType())),
        T.StructField("action_delta_eef", T.ArrayType(T.FloatType())),
        T.StructField("teleop_navigate", T.ArrayType(T.FloatType())),
        T.StructField("delta_height", T.ArrayType(T.FloatType())),
        T.StructField("hand_status", T.ArrayType(T.FloatType())),
        T.StructField("task", T.StringType()),
    ]
)

# Fixed values of the recorded layout.
PELVIS, LEFT_HIP, RIGHT_HIP, EEF_BASE, LEFT_HAND, RIGHT_HAND = 0, 1, 2, 3, 22, 23
FINGER_TIPS = (5, 10, 15, 20, 25)
WARN_MS, SEVERE_MS = 20.0, 50.0
ACTION_PARTS = {"delta_eef": 12, "delta_height": 1, "navigate": 3, "hand_status": 2}
ACTION_DIM, MODEL_DIM, HORIZON = 18, 32, 50
HISTOGRAM_BINS = 5000
SHUFFLE_BUFFER = 250_000


def feature_schema(config: dict[str, dict[str, int]]) -> T.StructType:
    """Features of a dataset: images.* and states get the prefix ``observation.``, actions keep their names."""
    fields = []
    for name in config.get("images", {}):
        fields.append(T.StructField(f"observation.images.{name}", T.BinaryType()))
    for name in config.get("states", {}):
        fields.append(T.StructField(f"observation.{name}", T.ArrayType(T.FloatType())))
    for name in config.get("actions", {}):
        fields.append(T.StructField(name, T.ArrayType(T.FloatType())))
    return T.StructType(fields)
