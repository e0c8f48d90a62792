"""Images, adapters, the wire format, whole pipelines and the plans that Spark makes of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import images
from strideframe.operators import sequence
from strideframe.plans import adapters, pipelines
from strideframe.plans.registry import frames
from strideframe.schema import TRAINING_FRAMES, feature_schema
from strideframe.sources import wire
from tests.compare import SF


@pytest.mark.parametrize(("shape", "to"), [((10, 10, 3), (20, 20)), ((30, 30, 3), (15, 15)), ((50, 50, 3), (50, 50)), ((256, 320, 3), (60, 80))])
def test_resize_shapes(shape, to):
    rng = np.random.default_rng(0)
    for x in (rng.integers(0, 256, shape).astype(np.uint8), rng.uniform(-1, 1, shape).astype(np.float32)):
        out = images.resize_with_pad(x, *to)
        assert out.shape == (*to, 3) and out.dtype == x.dtype
    wide = images.resize_with_pad(np.full((4, 8, 3), 200, np.uint8), 8, 8)
    assert (wide[:2] == 0).all() and (wide[-2:] == 0).all() and (wide[2:6] == 200).all()


def test_image_columns(spark):
    x = np.arange(24, dtype=np.float32).reshape(3, 2, 4) / 24
    df = spark.createDataFrame([(1, images.from_array(x)), (2, None)], f"id int, image {images.IMAGE}")
    got = {r["id"]: r["image"] for r in df.withColumn("image", images.each_image(F.col("image"), images.parse)).collect()}
    assert (images.to_array(got[1].asDict()) == (255 * x).astype(np.uint8).transpose(1, 2, 0)).all() and (got[2] is None or got[2]["data"] is None)
    assert images.unit_range(np.array([[[0, 255]]], np.uint8)).ravel().tolist() == [-1.0, 1.0]
    with pytest.raises(ValueError):
        images.decoded(b"x")


def sample(spark, cameras, **extra):
    img = images.from_array(np.full((2, 2, 3), 7, np.uint8))
    kind = ", ".join(f"{c}: {images.IMAGE}" for c in cameras)
    df = spark.createDataFrame([({c: img for c in cameras},)], f"images struct<{kind}>")
    return df.withColumns(extra)


def test_humanoid(spark):
    actions = F.array(*[F.array(*[F.lit(float(i)) for i in range(18)])] * 2)
    df = sample(spark, ["head_left"], actions=actions)
    group = pipelines.named("humanoid", dim=20)
    r = pipelines.run_group(group, df).first()
    assert r["state"] == [0.0] * 20 and len(r["actions"][0]) == 20 and r["action_mask"][0] == [True] * 18 + [False] * 2
    assert r["image_mask"].asDict() == {"base_0_rgb": True, "left_wrist_0_rgb": False, "right_wrist_0_rgb": False}
    assert set(r["image"]["left_wrist_0_rgb"]["data"]) == {0} and r["image"]["base_0_rgb"]["data"] == bytes([7] * 12)
    out = group.outputs[0](pipelines.run_group(group, df)).first()
    assert [len(a) for a in out["actions"]] == [18, 18]
    with pytest.raises(ValueError):
        pipelines.run_group(group, sample(spark, ["other"]))


def test_arms(spark):
    state = F.array(*[F.lit(0.5)] * 14)
    df = sample(spark, ["cam_high", "cam_left_wrist"], state=state, actions=F.array(state))
    group = pipelines.named("two_arm")
    r = pipelines.run_group(group, df).first()
    assert r["state"][1] == -0.5 and r["image_mask"]["right_wrist_0_rgb"] is False and r["image_mask"]["left_wrist_0_rgb"] is True
    back = df.select("actions")
    for step in (*group.inputs[2:], *group.outputs):
        back = step(back)
    assert np.allclose(back.first()["actions"], [[0.5] * 14])
    arm = sample(spark, ["exterior", "wrist"], joint_position=F.array(*[F.lit(1.0)] * 7), gripper_position=F.lit(0.2))
    r = pipelines.run_group(pipelines.named("single_arm", fast=True), arm).first()
    assert len(r["state"]) == 8 and all(r["image_mask"])
    hands = sample(spark, ["top_head", "hand_left", "hand_right"], state=F.array(F.lit(4.0), F.lit(1.0)))
    assert pipelines.run_group(pipelines.named("two_hand", dim=3), hands).first()["state"] == [0.0, 1.0, 0.0]
    table = sample(spark, ["image", "wrist_image"], state=state)
    small = pipelines.run_group(pipelines.named("table_arm"), table).transform(adapters.resized(4, 4)).first()
    assert small["image"]["base_0_rgb"]["height"] == 4
    with pytest.raises(KeyError):
        pipelines.named("nothing")


@pytest.mark.parametrize(
    "x",
    [1, 1.5, "text", True, None, [1, "a", None], np.array([1.0, 2.0]), np.array([[1, 2], [3, 4]], np.int64), np.array([True, False]), np.array(["abc", "d"]), np.array([np.nan, np.inf]),
     np.float32(2.5), np.int16(3), np.zeros((0, 3), np.uint8), {"a": {"b": np.arange(3)}}, [np.ones(2), {"c": np.zeros(1)}], np.array(b"xy"), {}, np.arange(6).reshape(2, 3).T, {1: np.ones(1)}],
)
def test_wire_round_trip(x):
    def same(a, b):
        if isinstance(a, (np.ndarray, np.generic)):
            return a.dtype == b.dtype and np.array_equal(a, b, equal_nan=a.dtype.kind == "f") and type(a) is type(b)
        if isinstance(a, dict):
            return list(a) == list(b) and all(same(a[k], b[k]) for k in a)
        return len(a) == len(b) and all(map(same, a, b)) if isinstance(a, list) else a == b

    assert same({"x": x}, wire.unpack(wire.pack({"x": x})))


def test_wire_refuses():
    for bad in (np.array([1j]), np.array([object()]), np.zeros(2, [("a", int)])):
        with pytest.raises(ValueError):
            wire.pack({"x": bad})


def test_human_episode(spark):
    rng = np.random.default_rng(0)
    rows, camera = [], []
    for episode in (1, 2):
        path = np.cumsum(rng.normal(0.01, 0.002, (200, 3)), 0)
        for i, p in enumerate(path):
            rows.append((episode, i, i * 10_000_000, [[float(v) for v in p] + [0.0, 0.0, 0.0, 1.0]] * 3))
        camera += [(episode, k * 50_000_000 + 3_000_000, b"jpg") for k in range(41)]
    df = spark.createDataFrame(rows, "episode_id long, frame_index long, ts_ns long, body_pose array<array<double>>")
    cam = spark.createDataFrame(camera, "episode_id long, ts_ns long, image_left binary")
    got = pipelines.human_episode(df, cam, seconds=0.5).orderBy("episode_id", "frame_index").collect()
    assert len(got) == 80 and {r["sync"] for r in got} == {"ok"} and got[0]["delta_height"] == 0.0
    assert all(r["cmd_vx"] in (0.2, -0.1, 0.0) for r in got)


def test_norm_statistics(spark):
    df = spark.createDataFrame([([float(i)], [2.0 * i]) for i in range(100)], "a array<double>, b array<double>")
    got = {r["dim"]: r for r in pipelines.norm_statistics(df, ["a", "b"], 3).collect()}
    assert got[0]["mean"] == 49.5 and got[1]["hi"] == 198.0 and got[2]["std"] == 0.0 and got[1]["q99"] == pytest.approx(196, abs=0.1)


def test_schemas():
    assert TRAINING_FRAMES["action_eef"].dataType.elementType.simpleString() == "float"
    names = feature_schema({"images": {"left": 1}, "states": {"joints": 43}, "actions": {"action": 43}}).names
    assert names == ["observation.images.left", "observation.joints", "action"]


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_one_exchange_serves_all_windows(spark):
    """Windows over the order of an episode, one upon the other, share the shuffle that numbered the frames."""
    f = frames(spark, SF).repartition("episode_id")
    turned = sequence.with_tangent(f.withColumn("x", F.col("value")).withColumn("y", F.col("frame_index") * 0.1), "x", "y", 2)
    nav = sequence.navigation_command(turned, "x", "y", "dir_x", "dir_y", 0.1)
    assert exchanges(nav.select("episode_id", "frame_index", "vx")) <= 2


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 49").groupBy("l_returnflag").agg(F.sum("l_tax"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_cameras(spark):
    from strideframe.functions import geometry as G
    from strideframe.operators import view

    at, to = G.literal((0.0, 0.0, 0.0)), G.literal((0.0, 0.0, 2.0))
    m = G.look_at(at, to)
    r = spark.range(1).select(*[c.alias(f"m{i}{j}") for i, row in enumerate(m) for j, c in enumerate(row)], *[c.alias(f"d{i}") for i, c in enumerate(G.dolly_target(G.literal((1.0, 0.0, 0.0)), F.lit(2.0), "trajectory_aligned"))], *[c.alias(f"r{i}") for i, c in enumerate(G.pixel_ray(F.lit(4.0), F.lit(3.0), 2.0, 2.0, 4.0, 3.0))]).first()
    assert [[r[f"m{i}{j}"] for j in range(3)] for i in range(3)] == [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    assert [r[f"d{i}"] for i in range(3)] == [2.0, 0.0, 2.0] and [r[f"r{i}"] for i in range(3)] == [0.0, 0.0, 1.0]
    grid = spark.createDataFrame([(1, x, y, 2.0, float(x + 10 * y)) for x in range(8) for y in range(6)], "img long, x long, y long, depth double, c double")
    camera = (4.0, 4.0, 4.0, 3.0)
    moved = view.warped(grid, "img", "depth", ["c"], 8, 6, lambda p: (p[0] + 0.5, p[1], p[2]), camera)
    got = {(q["x"], q["y"]): q["c"] for q in moved.collect()}
    assert got == pytest.approx({(x + 1, y): float(x + 10 * y) for x in range(7) for y in range(6)})
    back = {(q["x"], q["y"]): q["c"] for q in view.round_trip(grid, "img", "depth", ["c"], 8, 6, lambda p: (p[0] + 0.5, p[1], p[2]), camera).collect()}
    assert back == pytest.approx({(x, y): float(x + 10 * y) for x in range(7) for y in range(6)})


def test_prompts_and_keys(spark):
    from strideframe.functions import tokens
    from strideframe.operators import filters, transforms

    assert transforms.action_keys(["a", "hand_status"], [True, False]) == [["a"], ["a", "hand_status"]]
    df = spark.createDataFrame([("ab",), (None,)], "t string").select(tokens.tokenise(F.col("t"), lambda texts: [[ord(c) for c in t] for t in texts]).alias("p"))
    r = df.where("size(p) > 0").select(*[c.alias(k) for k, c in tokens.causal_inputs(F.col("p"), F.array(F.lit(7), F.lit(8)), 5).items()]).first()
    assert r["tokens"] == [97, 98, 7, 8, 0] and r["token_mask"] == [True] * 4 + [False] and r["ar_mask"] == [0, 0, 1, 1, 0] and r["loss_mask"] == [False, False, True, True, False]
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,), (1,)], "k long")
    assert filters.require_partners(left.where("k = 1"), right, "k").count() == 1
    with pytest.raises(Exception, match="no partner for 2"):
        filters.require_partners(left, right, "k").collect()


def test_files_and_recorder(spark, tmp_path):
    from strideframe.operators import filters
    from strideframe.sources import datasets
    from strideframe.streaming import blend

    spark.range(2).selectExpr("id AS a", "id AS b").coalesce(1).write.parquet(str(tmp_path / "set/one"))
    spark.range(2).selectExpr("id AS a").coalesce(1).write.parquet(str(tmp_path / "set/two"))
    good, bad = filters.require_columns(datasets.file_columns(spark, str(tmp_path / "set")), "names", ["a", "b"])
    assert good.count() == bad.count() == 1 and "/two/" in bad.first()["path"]
    assert datasets.latest_step(["10", "9", "last"]) == 10 and datasets.latest_step([]) is None
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "set/one"))
    q = stream.selectExpr("named_struct('x', a) AS inputs", "b AS other").writeStream.foreachBatch(blend.recorder(str(tmp_path / "log"), ["inputs"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(log.columns) == ["inputs/x", "step"] and log.count() == 2
    steps = spark.createDataFrame([(1, i, i == 3) for i in range(6)], "episode_id long, frame_index long, done boolean")
    assert blend.serve(steps, 100, "done").count() == 4 and blend.serve(steps, 2).count() == 2


def test_observation(spark):
    df = sample(spark, ["image", "wrist_image"]).transform(lambda d: adapters.image_slots(d, {"base_0_rgb": "image", "left_wrist_0_rgb": "wrist_image"}))
    r = adapters.observation(df).first()
    assert r["image"]["base_0_rgb"]["kind"] == "float32"
    with pytest.raises(ValueError):
        adapters.observation(df.withColumn("tokenized_prompt", F.array(F.lit(1))))


def test_nearest_and_replay_of_one_long_key(spark):
    """One key of many frames: the work must not grow with its square."""
    import time

    from pyspark.sql import functions as F

    from strideframe.operators import asof, pose

    left = spark.range(300_000).select(F.lit(1).alias("k"), (F.col("id") * 10 + 3).alias("t"))
    right = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") * 3000).alias("t"), F.col("id").alias("r"))
    begin = time.time()
    got = asof.nearest(left, right, "k", "t", ["r"]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("t") - F.col("match_ts"))).alias("off"), F.count_if(F.col("match_r") * 3000 != F.col("match_ts")).alias("wrong")).first()
    assert got["n"] == 300_000 and got["wrong"] == 0 and got["off"] == 299_999 * 10 + 3 - 999 * 3000
    steps = spark.range(100_000).select(F.lit(1).cast("long").alias("episode_id"), F.col("id").alias("frame_index"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"), F.lit(0.0).alias("roll"), F.lit(0.0).alias("pitch"), F.lit(0.0).alias("yaw"))
    last = pose.replay(steps, (5, 0, 0, 0, 0, 0, 1)).orderBy(F.desc("frame_index")).first()
    assert last["px"] == 100_005
    assert time.time() - begin < 90


def test_isolated_episodes(spark):
    from strideframe.operators import filters

    frames = spark.createDataFrame([(e, i, float(i)) for e in range(5) for i in range(e)], "episode_id long, frame_index long, value double")

    def work(episode):
        if len(episode) == 3:
            return episode["no such column"]
        return episode.groupby("episode_id", as_index=False)["value"].sum()

    done, failed = filters.isolate(frames, work, "episode_id long, value double")
    assert {r["episode_id"]: r["value"] for r in done.collect()} == {1: 0.0, 2: 1.0, 4: 6.0}
    (bad,) = failed.collect()
    assert bad["episode_id"] == 3 and bad["error"].startswith("KeyError")


def test_prompt_transforms(spark):
    from strideframe.operators import transforms

    def encode(texts):
        return [[ord(c) for c in t] for t in texts]

    df = spark.createDataFrame([("Pick_it", [0.0, -1.0], [5, 6], 1), ("go", [0.5, 1.0], None, 2)], "prompt string, state array<double>, actions array<int>, id int")
    out = df.transform(transforms.tokenise_prompt(encode, 10)).orderBy("id").collect()
    assert "prompt" not in out[0] and out[0]["tokenized_prompt"] == [*map(ord, "Pick it\n"), 0, 0] and out[1]["tokenized_prompt_mask"] == [True] * 3 + [False] * 7
    text = "Task: pick it, State: 128 0;\nAction: "
    with_state = df.transform(transforms.tokenise_prompt(encode, 60, with_state=True)).where("id = 1").first()
    assert with_state["tokenized_prompt"][: len(text)] == [*map(ord, text)] and sum(with_state["tokenized_prompt_mask"]) == len(text)
    rows = df.transform(transforms.tokenise_actions(encode, lambda a: F.transform(a, lambda t: t + 1000), [1], 60)).orderBy("id").collect()
    n = len(text)
    assert rows[0]["tokenized_prompt"][n : n + 4] == [1005, 1006, 1, 0]
    assert rows[0]["token_ar_mask"] == [0] * n + [1] * 3 + [0] * (57 - n) and rows[0]["token_loss_mask"] == [False] * n + [True] * 3 + [False] * (57 - n)
    assert not any(rows[1]["token_loss_mask"]) and rows[1]["actions"] is None
    back = df.transform(transforms.extract_actions(lambda t: F.transform(t, lambda x: x / 2), 2, 2)).orderBy("id").collect()
    assert back[0]["actions"] == [[2.5, 3.0], [0.0, 0.0]] and back[1]["actions"] is None
    assert transforms.extract_actions(lambda t: t, 1, 1)(df.drop("actions")).columns == ["prompt", "state", "id"]
    with pytest.raises(ValueError):
        transforms.tokenise_prompt(encode, 4)(df.drop("prompt"))
    with pytest.raises(Exception, match="a prompt is required"):
        df.withColumn("prompt", F.lit(None).cast("string")).transform(transforms.tokenise_prompt(encode, 4)).collect()


def test_model_groups(spark):
    def encode(texts):
        return [[ord(c) for c in t] for t in texts]

    state = F.array(F.lit(0.5), F.lit(-0.5))
    df = sample(spark, ["top_head", "hand_left", "hand_right"], state=state, actions=F.array(state)).transform(lambda d: adapters.image_slots(d, {adapters.BASE: "top_head", adapters.LEFT: "hand_left", adapters.RIGHT: "hand_right"}))
    r = pipelines.run_group(pipelines.named("flow_model", encode=encode, length=6, dim=4, prompt="go on"), df).first()
    assert r["tokenized_prompt"] == [*map(ord, "go on\n")] and all(r["tokenized_prompt_mask"]) and r["state"] == [0.5, -0.5, 0.0, 0.0]
    assert (r["image"][adapters.LEFT]["height"], r["image"][adapters.LEFT]["width"]) == adapters.SEEN and r["action_mask"] == [[True, True, False, False]]
    group = pipelines.named("token_model", encode=encode, encode_actions=lambda a: F.array(F.lit(7), F.lit(8)), decode_actions=lambda t: F.transform(t, lambda x: x / 2), end=[1], length=50, horizon=1, dim=2, prompt="go")
    r = pipelines.run_group(group, df).first()
    n = len("Task: go, State: 192 64;\nAction: ")
    assert r["tokenized_prompt"][n : n + 3] == [7, 8, 1] and r["token_loss_mask"].index(True) == n and sum(r["token_ar_mask"]) == 3
    given = spark.createDataFrame([([7, 8, 9],)], "actions array<int>")
    assert group.outputs[0](given).first()["actions"] == [[3.5, 4.0]]
