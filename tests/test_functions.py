"""Exact vectors for the column functions and transforms, and their inverses."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions import arrays, control, tokens
from strideframe.operators import asof, filters, handwave, pose, resample, sampling, sequence, stats, transforms, view
from strideframe.operators.frames import global_number, number_frames, remap, running_offset
from strideframe.sources import datasets


def one(spark, schema, row):
    return spark.createDataFrame([row], schema)


def episode(spark, values, name="v", episode_id=1):
    return spark.createDataFrame([(episode_id, i, v) for i, v in enumerate(values)], f"episode_id long, frame_index long, {name} double")


def in_order(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("episode_id", "frame_index").collect()]


def test_masks_and_deltas(spark):
    assert arrays.bool_mask(2, -2, 2) == [True, True, False, False, True, True]
    assert arrays.bool_mask(2, 0, 2) == [True] * 4
    df = one(spark, "state array<double>, actions array<array<double>>", ([1.0, 2.0, 3.0], [[3.0, 4.0, 5.0], [5.0, 6.0, 7.0]]))
    r = df.select(
        arrays.delta_actions(F.col("actions"), F.col("state"), [False, True]).alias("d"),
        arrays.absolute_actions(F.col("actions"), F.col("state"), [False, True]).alias("a"),
        arrays.delta_actions(F.col("actions"), F.col("state"), None).alias("n"),
        arrays.absolute_actions(arrays.delta_actions(F.col("actions"), F.col("state"), [True, True]), F.col("state"), [True, True]).alias("same"),
    ).first()
    assert r["d"] == [[3.0, 2.0, 5.0], [5.0, 4.0, 7.0]]
    assert r["a"] == [[3.0, 6.0, 5.0], [5.0, 8.0, 7.0]]
    assert r["n"] == r["same"] == [[3.0, 4.0, 5.0], [5.0, 6.0, 7.0]]


def test_repack_and_rename(spark):
    df = spark.sql("SELECT named_struct('c', 1) AS b, named_struct('f', 2) AS e, 9 AS _keep")
    out = df.transform(transforms.repack({"a": {"b": "b/c"}, "d": "e/f"})).first()
    assert (out["a"]["b"], out["d"], out["_keep"]) == (1, 2, 9)
    with pytest.raises(KeyError):
        df.transform(transforms.repack({"x": "b/nothing"}))
    names = ["a/b", "a/c"]
    assert transforms.rename_paths({"a/b": "x/y", "a/c": None}, names) == {"x/y": "a/b"}
    assert transforms.rename_paths({"b": "x"}, names) == {"a/b": "a/b", "a/c": "a/c"}
    assert transforms.rename_paths({".+": None}, names) == {}
    assert transforms.rename_paths({r"(.+)/c": r"\1/d"}, ["a/b", "a/c", "b/c"]) == {"a/b": "a/b", "a/d": "a/c", "b/d": "b/c"}
    with pytest.raises(ValueError):
        transforms.rename_paths({"a/b": "a/c"}, names)
    with pytest.raises(ValueError):
        transforms.rename_paths({"a/b": "a"}, names)


def test_group_order():
    g = transforms.Group().push(inputs=("a",), outputs=("x",)).push(inputs=("b",), outputs=("y",))
    assert g.inputs == ("a", "b") and g.outputs == ("y", "x")


def test_prompt_from_task(spark):
    tasks = spark.createDataFrame([(1, "Hello, world!")], "task_index long, task string")
    df = spark.createDataFrame([(1,)], "task_index long")
    assert df.transform(transforms.prompt_from_task(tasks)).first()["prompt"] == "Hello, world!"
    with pytest.raises(Exception, match="no task 2"):
        spark.createDataFrame([(2,)], "task_index long").transform(transforms.prompt_from_task(tasks)).collect()


def test_concat_errors(spark):
    df = one(spark, "a array<double>, b array<double>, _dataset_idx int", ([1.0], [2.0], 5))
    assert df.transform(transforms.concat_actions(["a", "b"], mask="m")).first()["m"] == [True, True]
    with pytest.raises(ValueError):
        df.transform(transforms.concat_actions(["a", "c"]))
    with pytest.raises(Exception, match="no such dataset"):
        df.transform(transforms.concat_by_dataset([["a"], ["b"]])).collect()


def test_running_stats_and_json(spark):
    x = np.arange(12, dtype=float).reshape(4, 3)
    df = spark.createDataFrame([("k", r.tolist()) for r in x], "key string, e array<double>")
    got = stats.running_stats(stats.by_dimension(df, "e", "key"), "key").orderBy("dim").collect()
    assert np.allclose([r["mean"] for r in got], x.mean(0)) and np.allclose([r["std"] for r in got], x.std(0))
    table = stats.running_stats(stats.by_dimension(df, "e", "key"), "key")
    text = datasets.stats_json(table, "key")
    assert json.loads(text)["norm_stats"]["k"]["mean"] == x.mean(0).tolist()
    back = datasets.stats_from_json(spark, text).orderBy("dim").collect()
    assert [r["mean"] for r in back] == x.mean(0).tolist() and back[0]["q01"] is None


def test_quantile_is_left_edge(spark):
    long = spark.createDataFrame([(0, float(v)) for v in range(100)], "dim int, x double")
    hist = stats.histogram(long, 10)
    assert stats.histogram_quantile(hist, 0.5).first()["value"] == pytest.approx(39.6, abs=0.1)


def test_nearest_ties_and_ends(spark):
    left = spark.createDataFrame([(1, t) for t in (5, 10, 15, 17, 100)] + [(2, 7)], "k long, ts long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k long, ts long, x string")
    got = asof.nearest(left, right, "k", "ts", ["x"]).orderBy("k", "ts").collect()
    assert [r["match_ts"] for r in got] == [10, 10, 10, 20, 20, None]
    assert [r["match_x"] for r in got] == ["a", "a", "a", "b", "b", None]
    assert len(left.columns) + 2 == len(got[0])


def test_nearest_against_search(spark):
    rng = np.random.default_rng(1)
    cam, ts = np.sort(rng.integers(0, 500, 60)), rng.integers(-20, 520, 300)
    got = asof.nearest(spark.createDataFrame([(0, int(t), i) for i, t in enumerate(ts)], "k long, ts long, i long"), spark.createDataFrame([(0, int(t)) for t in cam], "k long, ts long"), "k", "ts")
    idx = np.clip(np.searchsorted(cam, ts), 0, len(cam) - 1)
    prev = np.maximum(idx - 1, 0)
    want = np.where(np.abs(cam[idx] - ts) < np.abs(cam[prev] - ts), cam[idx], cam[prev])
    assert [r["match_ts"] for r in got.orderBy("i").collect()] == want.tolist()


def test_match_levels(spark):
    df = spark.createDataFrame([(20.0,), (20.1,), (50.0,), (50.1,)], "d double")
    assert [r[0] for r in df.select(asof.match_level(F.col("d"), 20, 50)).collect()] == ["ok", "warning", "warning", "severe"]


def test_blocks(spark):
    got = resample.blocks(episode(spark, [float(v) for v in range(1, 8)]), 5, resample.block_mean("v"))
    assert in_order(got, "v") == [3.0, 6.5]


def test_discretise(spark):
    df = spark.createDataFrame([(0.04,), (0.041,), (-0.041,)], "v double")
    assert [r[0] for r in df.select(control.discretise(F.col("v"), F.col("v"), F.col("v"))[0]).collect()] == [0.0, 0.2, -0.1]


def test_navigation_ends(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0, 0.0), (1, 1, 1.0, 0.0, 1.0, 0.0), (1, 2, 1.0, 2.0, 0.0, 1.0), (2, 0, 5.0, 5.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "episode_id long, frame_index long, x double, y double, hx double, hy double")
    got = in_order(sequence.navigation_command(df, "x", "y", "hx", "hy", 0.5), "vx", "vy", "yaw_rate")
    assert got[0] == (2.0, 0.0, 0.0) and got[1] == pytest.approx((0.0, 4.0, math.pi)) and got[2] == got[1] and got[3] == (0.0, 0.0, 0.0)


def test_tangent_of_a_pause(spark):
    df = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate([0.0, 0.0, 0.0, -1.0, -2.0, -2.0, -2.0])], "episode_id long, frame_index long, x double, y double")
    assert [x for x in in_order(sequence.with_tangent(df, "x", "y", 1), "dir_x")] == [1.0, 1.0, -1.0, -1.0, -1.0, -1.0, -1.0]


def test_sign_resets_at_zero(spark):
    vectors = [(1.0, 0.0), (-1.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, -1.0)]
    df = spark.createDataFrame([(1, i, *v) for i, v in enumerate(vectors)], "episode_id long, frame_index long, a double, b double")
    want, last = [], None
    for v in vectors:
        s = -1.0 if last is not None and np.dot(last, v) < 0 else 1.0
        want.append(s)
        last = np.array(v) * s
    assert in_order(sequence.continuous_sign(df, ["a", "b"]), "sign") == want


def test_integrate_undoes_navigation(spark):
    rng = np.random.default_rng(0)
    xy = np.cumsum(rng.normal(size=(40, 2)), 0)
    df = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "episode_id long, frame_index long, x double, y double")
    turned = sequence.with_tangent(df, "x", "y", 2)
    nav = sequence.navigation_command(turned, "x", "y", "dir_x", "dir_y", 0.1).drop("x", "y")
    back = np.array(in_order(sequence.integrate(nav, "vx", "vy", "yaw_rate", 0.1), "x", "y"))
    seen = np.array(in_order(sequence.rebase(turned, "x", "y", "dir_x", "dir_y"), "x0", "y0"))
    assert np.allclose(back, seen, atol=1e-9)


def test_action_chunk_clamps(spark):
    got = in_order(episode(spark, [0.0, 1.0, 2.0]).select("episode_id", "frame_index", sequence.look_ahead("v", 4).alias("a"), sequence.look_ahead_pad(4).alias("p")), "a", "p")
    assert got[1] == ([1.0, 2.0, 2.0, 2.0], [False, False, True, True])


def test_savgol_keeps_polynomials(spark):
    v = [float(i * i - 3 * i) for i in range(20)]
    for widest in (64, 1):
        got = in_order(sequence.smooth(episode(spark, v), "v", "s", 5, 2, widest), "s")
        assert np.allclose(got[2:-2], v[2:-2])
    assert in_order(sequence.smooth(episode(spark, [4.0, 9.0]), "v", "s", 5, 2), "s") == [4.0, 9.0]
    assert sequence.window_frames(15, 0.01) == 1501


def test_quotas_and_batches(spark):
    assert sampling.quotas([0.5, 0.3, 0.2], 7) == [3, 2, 2]
    rows = sampling.weighted_batches(spark, [40, 30, 30], [2, 1, 1], 8, seed=1, ranks=2)
    got = rows.groupBy("rank", "batch_id", "dataset").count().collect()
    assert {(r["dataset"], r["count"]) for r in got} == {(0, 4), (1, 2), (2, 2)} and len(got) == 2 * 6 * 3
    assert rows.where("(dataset = 0 AND row >= 40) OR (dataset = 1 AND (row < 40 OR row >= 70)) OR (dataset = 2 AND row < 70)").count() == 0
    assert rows.orderBy("rank", "batch_id", "place").collect() == sampling.weighted_batches(spark, [40, 30, 30], [2, 1, 1], 8, seed=1, ranks=2).orderBy("rank", "batch_id", "place").collect()
    with pytest.raises(ValueError):
        sampling.batches(spark.range(3), "id", 4)
    shuffled = sampling.batches(spark.range(10), "id", 4, shuffle_seed=5)
    assert shuffled.count() == 8 and shuffled.select("batch_id").distinct().count() == 2


def test_folder_order(spark):
    df = spark.createDataFrame([("misc",), ("0102_2",), ("0101_1",)], "name string")
    d, b = tokens.folder_key(F.col("name"))
    assert [r[0] for r in df.orderBy(d, b).collect()] == ["0101_1", "0102_2", "misc"]
    assert [r[0] for r in df.select(tokens.episode_number(F.lit("x/episode_12.hdf5"))).collect()] == [12] * 3


def test_digitise_and_codes(spark):
    x = [-1.1, -1.0, 0.0, 0.999, 1.0, 5.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert [r[0] for r in df.select(tokens.digitise(F.col("x"))).collect()] == [-1, 0, 128, 255, 255, 255]
    edges = np.linspace(-1, 1, 257)[:-1]
    more = [float(v) for v in np.concatenate([edges, np.nextafter(edges, -2), np.random.default_rng(0).uniform(-1.2, 1.2, 500)])]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in more], "x double").select(tokens.digitise(F.col("x"))).collect()]
    assert got == (np.digitize(more, edges) - 1).tolist()


def test_square_wave(spark):
    signal = [0.1, 0.2, 0.9, 0.95, 0.9, 0.1, 0.0]
    df = episode(spark, signal, "s").withColumn("w", F.lit(1.0))
    fit = handwave.fit_one_pulse(df, "s", "w").first()
    assert (fit["x"], fit["y"]) == (2, 5)
    assert handwave.fit_wave(df, "s", "w", "0-1-0").first()["edges"] == [2, 5]
    wave = control.square_wave(F.col("frame_index"), "0-1-0", [F.lit(2), F.lit(5)])
    assert in_order(df.withColumn("q", wave), "q") == [0, 0, 1, 1, 1, 0, 0]


def test_binarise_order_of_ties(spark):
    assert in_order(handwave.binarise(episode(spark, [0.5, 0.5]), "v"), "binary") == [0.0, 0.0]
    assert in_order(handwave.binarise(episode(spark, [0.9]), "v"), "binary") == [1.0]
    assert in_order(handwave.binarise(episode(spark, [0.1, 0.9, 0.8]), "v"), "binary") == [0.0, 1.0, 1.0]
    from strideframe.streaming.blend import one_change

    rng = np.random.default_rng(2)
    for _ in range(5):
        v = rng.random(12).round(3)
        assert in_order(handwave.binarise(episode(spark, v.tolist()), "v"), "binary") == one_change(v).tolist()


def test_enhance_goes_on_beyond_the_ends(spark):
    """Values above 1 and below 0 follow the same powers, as in the reference."""
    df = episode(spark, [-0.1, 0.5, 0.9, 1.0, 1.2])
    got = in_order(df.withColumn("e", control.enhance(F.col("v"), F.lit(0.8), F.lit(0.2), 2, 2)), "e")
    assert got == pytest.approx([0.05, 0.5, 0.95, 1.0, 0.8], abs=1e-12)
    got = in_order(df.withColumn("e", control.enhance(F.col("v"), F.lit(0.5), F.lit(0.5), 3, 3)), "e")
    assert got == pytest.approx([-0.004, 0.5, 0.996, 1.0, 1.032], abs=1e-12)


def test_shifted_edges(spark):
    df = episode(spark, [0.0, 0.0, 1.0, 1.0, 1.0, 0.0])
    assert in_order(sequence.shift_edges(df, "v", [-1, 1]), "shifted") == [0.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    with pytest.raises(Exception, match="out of order"):
        sequence.shift_edges(df, "v", [3, -3]).collect()


def test_replay_undoes_delta(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        rows.append((1, i, *[float(v) for v in (*rng.normal(size=3), *q)]))
    df = spark.createDataFrame(rows, "episode_id long, frame_index long, " + ", ".join(f"{c} double" for c in pose.POSE))
    back = pose.replay(pose.pose_delta(df).select("episode_id", "frame_index", "dx", "dy", "dz", "roll", "pitch", "yaw"), rows[0][2:])
    assert np.allclose(in_order(back, *pose.POSE[:3]), [r[2:5] for r in rows], atol=1e-9)
    smooth = np.array(in_order(pose.smooth_rotation(pose.continuous_rotation(df), 5, 2), *pose.POSE[3:]))
    assert np.allclose(np.linalg.norm(smooth, axis=1), 1)


def test_global_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("n"))
    assert running_offset(df, "k", "n", "o").where("o <> 2 * k").count() == 0
    assert global_number(df, "k").where("position <> k").count() == 0
    assert remap(df.select((F.col("k") * 3).alias("k")), "k", "e").where("k <> 3 * e").count() == 0
    assert number_frames(df.withColumn("g", F.col("k") % 10), "g", "k").where("frame_index <> floor(k / 10)").count() == 0


def test_keep_ranges(spark):
    df = episode(spark, [0.0] * 6)
    ranges = spark.createDataFrame([(1, 1, 3), (1, 2, 4)], "episode_id long, start long, stop long")
    assert in_order(filters.keep_ranges(df, ranges), "frame_index") == [1, 2, 3]
    assert filters.keep_ranges(df, None).count() == 6
    assert filters.keep_ranges(df, ranges.where("episode_id = 9")).count() == 0


def test_buffer_and_splat(spark):
    df = episode(spark, [float(i) for i in range(6)])
    got = {r["slot"]: r["v"] for r in view.frame_buffer(df, "episode_id", "frame_index", 3).collect()}
    slots: list = []
    for v in range(6):
        if len(slots) < 3:
            slots.insert(0, float(v))
        else:
            slots[0] = float(v)
    assert [got[i] for i in range(3)] == slots
    p = spark.createDataFrame([(1, 2.0, 3.0, 1.0, 0.5)], "img long, u double, v double, d double, c double")
    assert [(r["x"], r["y"], round(r["c"], 9)) for r in view.splat(p, "img", "u", "v", "d", ["c"], 8, 8).collect()] == [(2, 3, 0.5)]


def test_dataset_files(spark, tmp_path):
    df = episode(spark, [1.0, 2.0, 3.0])
    root = str(tmp_path / "set")
    datasets.write_episodes(df, root)
    with pytest.raises(Exception, match="(?i)exists"):
        datasets.write_episodes(df, root)
    assert datasets.append_episode(df, root) == 2 and datasets.append_episode(df.limit(0), root) == 3
    assert datasets.read_episodes(spark, root).count() == 6
    # a discarded episode uses its number up, or leaves it
    assert datasets.discard_episode(spark, root, keep_index=True) == 3 and datasets.discard_episode(spark, root) == 4
    assert datasets.append_episode(df, str(tmp_path / "new")) == 0 and datasets.next_episode(spark, root) == 4
    assert datasets.scan(spark, f"{root}/frames", columns=["v"], episodes=[2]).count() == 3
    assert datasets.files(spark, root, "*.parquet", most=1).count() == 1
    assert datasets.as_features(df, {"value": "v"}).dtypes[-1] == ("value", "array<float>")
    (tmp_path / "episodes.jsonl").write_text('{"episode_index": 0, "length": 3, "tasks": ["a"]}\n{"episode_index": 1, "length": 4, "tasks": ["b"]}\n')
    listed = running_offset(datasets.episode_list(spark, str(tmp_path / "episodes.jsonl")), "episode_index", "length", "start_index")
    assert [(r["task"], r["start_index"]) for r in listed.orderBy("episode_index").collect()] == [("a", 0), ("b", 3)]
