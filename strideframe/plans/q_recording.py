"""Queries over recordings as a whole, batches that start again, hands and camera paths."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strideframe.functions import control
from strideframe.functions import geometry as G
from strideframe.operators import filters, sampling, sequence, stats
from strideframe.plans.registry import frames, load, query, r6, rounded, s6
from strideframe.sources import datasets

@query(
    "WITH {frames}, c AS (SELECT episode_id, frame_index AS i, count(*) OVER (PARTITION BY episode_id) AS n, first_value(value) OVER (PARTITION BY episode_id ORDER BY frame_index) AS v FROM f), "
    "e AS (SELECT *, CAST(floor(v / 20) AS BIGINT) AS e0, CAST(floor(25 - v / 20) AS BIGINT) AS e1 FROM c), w AS (SELECT *, least(e0, n) AS a, least(e0 + 2, n) AS b, least(e0 + 5, n) AS c, least(e0 + 6, n) AS d, least(e0 + 8, n) AS g, least(e0 + 9, n) AS h FROM e) "
    "SELECT episode_id, i AS frame_index, 1 AS all1, 0 AS all0, CAST(i >= least(e0, n - 1) AS INTEGER) AS up, CAST(i < least(e0, n - 1) AS INTEGER) AS down, CAST(least(e0, n - 1) < least(e1, n) AND i >= least(e0, n - 1) AND i < least(e1, n) AS INTEGER) AS pulse, "
    "CAST(a < b AND b < c AND c < d AND (i >= a AND i < b OR i >= c AND i < d) AS INTEGER) AS two, CAST(a < b AND b < c AND c < d AND d < g AND g < h AND (i >= a AND i < b OR i >= c AND i < d OR i >= g AND i < h) AS INTEGER) AS three FROM w"
)
def square_wave_kinds(spark, sf_dir):
    """All seven kinds of waves, with edges from the data that may lie beyond the episode or out of order."""
    from pyspark.sql import Window

    by = Window.partitionBy("episode_id")
    f = frames(spark, sf_dir).withColumn("n", F.count("*").over(by)).withColumn("v", F.first("value").over(by.orderBy("frame_index")))
    e0, e1 = F.col("v") / 20, 25 - F.col("v") / 20
    edges = {"all1": ("1", []), "all0": ("0", []), "up": ("0-1", [e0]), "down": ("1-0", [e0]), "pulse": ("0-1-0", [e0, e1]), "two": ("0-1-0-1-0", [e0 + k for k in (0, 2, 5, 6)]), "three": ("0-1-0-1-0-1-0", [e0 + k for k in (0, 2, 5, 6, 8, 9)])}
    return f.select("episode_id", "frame_index", *[control.square_wave(F.col("frame_index"), kind, at, F.col("n")).cast("int").alias(c) for c, (kind, at) in edges.items()])


@query("WITH {frames} SELECT episode_id, count(*) AS n_frames, min(ts_us) AS start_time, max(ts_us) AS end_time, " + s6("(max(ts_us) - min(ts_us)) / 1e6") + " AS duration, " + s6("CASE WHEN max(ts_us) > min(ts_us) THEN (count(*) - 1) / ((max(ts_us) - min(ts_us)) / 1e6) ELSE 0 END") + " AS fps, 'walk' AS task_prompt FROM f GROUP BY 1")
def episode_attributes(spark, sf_dir):
    """The attributes that a write leaves beside the frames."""
    root = f"{datasets.scratch(spark)}/recorded-{uuid.uuid4().hex}"
    datasets.write_episodes(frames(spark, sf_dir).select("episode_id", "frame_index", "ts_us"), root, overwrite=True, ts="ts_us", per_second=1e6, attributes={"task_prompt": "walk"})
    return rounded(spark.read.parquet(f"{root}/episodes"), "duration", "fps")


@query("WITH {frames}, r AS (SELECT episode_id, frame_index, (ts_us - min(ts_us) OVER (PARTITION BY episode_id)) / 1e6 AS passed FROM f) SELECT episode_id, frame_index, " + s6("CASE WHEN passed > 0 THEN (frame_index + 1) / passed ELSE 0 END") + " AS rate FROM r WHERE (frame_index + 1) % 4 = 0")
def capture_rate(spark, sf_dir):
    """Frames a second since the episode began, at every fourth frame."""
    return rounded(sequence.capture_rate(frames(spark, sf_dir), "ts_us", 4), "rate").select("episode_id", "frame_index", "rate")


@query("SELECT folder, count(*) AS n_episodes, CASE WHEN folder = 'x' THEN 999999 ELSE CAST(split_part(folder, '_', 1) AS BIGINT) END AS date, CASE WHEN folder = 'x' THEN 999999 ELSE CAST(split_part(folder, '_', 2) AS BIGINT) END AS batch FROM (SELECT CASE WHEN o_custkey % 9 = 0 THEN 'x' ELSE '0' || (100 + o_orderkey % 5) || '_' || (o_custkey % 3) END AS folder FROM orders) GROUP BY 1")
def folder_summary(spark, sf_dir):
    """Episodes of each batch folder."""
    name = F.when(F.col("o_custkey") % 9 == 0, "x").otherwise(F.concat(F.lit("0"), (100 + F.col("o_orderkey") % 5).cast("string"), F.lit("_"), (F.col("o_custkey") % 3).cast("string")))
    return filters.folder_summary(load(spark, sf_dir, "orders").select(name.alias("folder")), "folder")


@query("SELECT event_type, count(value) AS n, round(sum(value), 4) + 0 AS seconds, " + s6("sum(value) / (SELECT sum(value) FROM events)") + " AS share FROM events GROUP BY 1")
def stage_totals(spark, sf_dir):
    """Times by stage and their shares."""
    out = stats.stage_totals(load(spark, sf_dir, "events"), "event_type", "value")
    return rounded(out, "share").withColumn("seconds", F.round("seconds", 4) + F.lit(0.0))


@query("WITH g AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, (SELECT count(*) FROM events) // 64 AS n FROM events), b AS (SELECT event_id, p // 64 AS batch_id, n FROM g WHERE p < n * 64), t AS (SELECT t.turn, t.turn % m.n AS batch_id FROM range(400) t(turn), (SELECT max(n) AS n FROM b) m) SELECT t.turn, t.batch_id, min(event_id) AS low, CAST(sum(event_id) AS BIGINT) AS ids FROM t JOIN b USING (batch_id) GROUP BY 1, 2")
def batch_restart(spark, sf_dir):
    """Four hundred batches, whether there are more or fewer."""
    numbered = sampling.batches(load(spark, sf_dir, "events").select("event_id"), "event_id", 64)
    return sampling.take_batches(numbered, 400).groupBy("turn", "batch_id").agg(F.min("event_id").alias("low"), F.sum("event_id").alias("ids"))


@query("SELECT t.k AS cut, CASE WHEN t.k < n THEN t.k // 32 ELSE n // 32 END AS n_batches, CASE WHEN t.k < n THEN t.k // 32 ELSE n // 32 END * 32 AS n_rows, CASE WHEN t.k < n THEN t.k // 32 ELSE n // 32 END * 32 AS n_distinct, t.k < n AS mixed FROM (SELECT count(*) AS n FROM events) e, (VALUES (200), (100000000)) t(k)")
def batch_subset(spark, sf_dir):
    """A bounded number of rows: so many full batches of different rows, from all over the table; all full batches in order where the bound is larger."""
    e = load(spark, sf_dir, "events").select("event_id")
    out = None
    for cut in (200, 100_000_000):
        got = sampling.bounded_batches(e, "event_id", 32, cut)
        first = e.agg(F.expr("percentile(event_id, 0.5)").alias("half"))
        one = got.join(F.broadcast(first)).agg(F.count_distinct("batch_id").alias("n_batches"), F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_distinct"), F.max(F.when((F.col("batch_id") == 0) & (F.col("event_id") > F.col("half")), True).otherwise(False)).alias("mixed"))
        one = one.select(F.lit(cut).alias("cut"), "*")
        out = one if out is None else out.union(one)
    return out


@query("SELECT vec_id, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS {n}" for n, i in zip(("x", "y", "z", "w"), (2, 3, 4, 1))) + ", CAST(embedding[1] AS DOUBLE) AS back, " + s6("0.25 + least(greatest(CAST(embedding[5] AS DOUBLE), 0), 1) * 0.5") + " AS thumb, " + s6("1 - least(greatest(CAST(embedding[5] AS DOUBLE), 0), 1) * 3") + " AS index_, CAST(embedding[6] > 0 AS INTEGER) AS left_, CASE WHEN vec_id % 3 = 0 THEN CAST(embedding[6] > 0 AS INTEGER) ELSE CAST(embedding[7] > 0 AS INTEGER) END AS right_ FROM embeddings")
def hand_columns(spark, sf_dir):
    """Quaternions in the other order and back, joints between an open and a closed hand, statuses as pairs."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    last = G.scalar_last(F.slice("e", 1, 4))
    joints = control.blend_hand(F.get("e", F.lit(4)), [0.25, 1.0], [0.75, -2.0])
    flags = [(F.get("e", F.lit(i)) > 0).cast("int") for i in (5, 6, 7)]
    pair = control.hand_pair(F.when(F.col("vec_id") % 3 == 0, F.array(flags[0])).otherwise(F.array(*flags)))
    out = e.select("vec_id", last.alias("q"), joints.alias("j"), pair.alias("p"))
    return out.select("vec_id", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate("xyzw")], F.get(G.scalar_first(F.col("q")), F.lit(0)).alias("back"), r6(F.get("j", F.lit(0))).alias("thumb"), r6(F.get("j", F.lit(1))).alias("index_"), F.get("p", F.lit(0)).alias("left_"), F.get("p", F.lit(1)).alias("right_"))


_SPAN = "(max({0}) OVER (PARTITION BY episode_id) - min({0}) OVER (PARTITION BY episode_id))"


def _unit(x: str) -> str:
    return f"CASE WHEN {_SPAN.format(x)} > 0 THEN ({x} - min({x}) OVER (PARTITION BY episode_id)) / {_SPAN.format(x)} ELSE 0 END"


_CLOSED = f"(0.3 * (1 - ({_unit('value')})) + 0.5 * ({_unit('bend')})) / 0.8"


@query(f"WITH {{frames}}, u AS (SELECT episode_id, frame_index, value, sin(value) AS bend FROM f) SELECT episode_id, frame_index, {s6(_CLOSED)} AS closed FROM u")
def weighted_trajectory(spark, sf_dir):
    """How closed a hand is: near tips and bent fingers, each scaled within its episode."""
    u = frames(spark, sf_dir).withColumn("bend", F.sin("value"))
    signal = control.weighted_signal(stats.scale_to_unit("value", "episode_id"), stats.scale_to_unit("bend", "episode_id"), 0.3, 0.5)
    return u.select("episode_id", "frame_index", r6(signal).alias("closed"))


_CAMERA = (
    "s AS (SELECT k.kind, p_partkey % 13 AS step, 1 + p_partkey % 7 / 10.0 AS depth, p_partkey FROM part, (VALUES ('left'), ('up'), ('zoom_in'), ('clockwise'), ('counterclockwise')) k(kind)), "
    "o AS (SELECT *, CASE kind WHEN 'left' THEN -step * 0.1 * depth / 13 WHEN 'clockwise' THEN 0.1 * (cos(2 * pi() * step / 12) - 1) * depth WHEN 'counterclockwise' THEN -0.1 * (cos(2 * pi() * step / 12) - 1) * depth ELSE 0 END AS x, "
    "CASE WHEN kind = 'up' THEN -step * 0.1 * depth / 13 WHEN kind LIKE '%wise' THEN 0.1 * sin(2 * pi() * step / 12) * depth ELSE 0 END AS y, CASE WHEN kind = 'zoom_in' THEN step * 0.1 * depth / 13 ELSE 0 END AS z FROM s), "
    "n AS (SELECT *, -x / sqrt(x*x + y*y + (depth-z)*(depth-z)) AS fx, -y / sqrt(x*x + y*y + (depth-z)*(depth-z)) AS fy, (depth-z) / sqrt(x*x + y*y + (depth-z)*(depth-z)) AS fz FROM o)"
)


@query(f"WITH {_CAMERA} SELECT p_partkey, kind, {s6('fx')} AS fx, {s6('fy')} AS fy, {s6('fz')} AS fz, {s6('fz / sqrt(fz*fz + fx*fx)')} AS rx, {s6('-fx / sqrt(fz*fz + fx*fx)')} AS rz, {s6('-x')} AS tx, {s6('-y')} AS ty, {s6('-z')} AS tz FROM n")
def camera_path(spark, sf_dir):
    """Where a camera stands and looks at the steps of straight and circling trajectories: forward and right axes and the shift of the origin."""
    part = load(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 13).alias("step"), (1 + F.col("p_partkey") % 7 / 10.0).alias("depth"))
    out = None
    for kind in ("left", "up", "zoom_in", "clockwise", "counterclockwise"):
        m = G.camera_step(kind, F.col("step"), 13, 0.1, F.col("depth"))
        cells = {"fx": m[2][0], "fy": m[2][1], "fz": m[2][2], "rx": m[0][0], "rz": m[0][2], "tx": m[0][3], "ty": m[1][3], "tz": m[2][3]}
        one = part.select("p_partkey", F.lit(kind).alias("kind"), *[r6(c).alias(n) for n, c in cells.items()])
        out = one if out is None else out.union(one)
    return out


@query(
    "SELECT CASE WHEN event_id % 2 = 0 THEN 'left_wrist' ELSE 'base' END AS camera, count(*) AS n, CASE WHEN event_id % 2 = 0 THEN 224 ELSE 212 END AS crop_w, CASE WHEN event_id % 2 = 0 THEN 160 ELSE 152 END AS crop_h, "
    "0 AS low_x, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 12 END AS high_x, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 8 END AS high_y, event_id % 2 = 1 AS turned, true AS coloured, true AS apart FROM events GROUP BY event_id % 2"
)
def distortions(spark, sf_dir):
    """Crops, angles and colours that fill their bounds, independent of each other, and none of the view at a wrist."""
    e = load(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "left_wrist").otherwise("base").alias("camera"))
    d = e.select("camera", *[c.alias(n) for n, c in sampling.distortion(F.col("event_id"), F.col("camera"), 224, 160).items()])
    fills = [(F.min(n) < -0.9 * most) & (F.max(n) > 0.9 * most) & (F.max(F.abs(n)) <= most) for n, most in sampling.COLOUR.items()]
    turned = (F.min("angle") < -4.5) & (F.max("angle") > 4.5) & (F.max(F.abs("angle")) <= 5)
    return d.groupBy("camera").agg(
        F.count("*").alias("n"),
        F.max("crop_w").alias("crop_w"),
        F.max("crop_h").alias("crop_h"),
        F.min("crop_x").alias("low_x"),
        F.max("crop_x").alias("high_x"),
        F.max("crop_y").alias("high_y"),
        turned.alias("turned"),
        (fills[0] & fills[1] & fills[2]).alias("coloured"),
        (F.abs(F.corr("brightness", "contrast")) < 0.2).alias("apart"),
    )
