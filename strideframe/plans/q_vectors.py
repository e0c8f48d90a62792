"""Queries over action and state vectors: statistics, normalisation, transforms, poses, tokens."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strideframe.functions import arrays, control, tokens
from strideframe.functions import geometry as G
from strideframe.operators import filters, pose, stats, transforms
from strideframe.plans.registry import load, pose_frames, query, r6, rounded, s6


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def exploded(df, array: str, *keys: str):
    """Elements as rows, rounded."""
    return df.select(*keys, F.posexplode(array).alias("dim", "x")).withColumn("x", r6("x"))


@query(f"WITH {{vectors}} SELECT label, CAST(dim AS INTEGER) AS dim, count(*) AS n, {s6('avg(x)')} AS mean, {s6('stddev_pop(x)')} AS std, {s6('min(x)')} AS lo, {s6('max(x)')} AS hi FROM v GROUP BY 1, 2")
def norm_stats(spark, sf_dir):
    long = stats.by_dimension(vectors(spark, sf_dir), "e", "label")
    return rounded(stats.running_stats(long, "label"), "mean", "std", "lo", "hi")


_BY = "s AS (SELECT label, dim, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM v GROUP BY 1, 2)"


def _by_label(spark, sf_dir):
    long = stats.by_dimension(vectors(spark, sf_dir), "e", "label")
    return long.groupBy("label", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.percentile("x", 0.01).alias("q01"), F.percentile("x", 0.99).alias("q99"))


@query(f"WITH {{vectors}}, {_BY} SELECT CAST(dim AS INTEGER) AS dim, {s6('sum(mean*n)/sum(n)')} AS mean, {s6('sum(std*n)/sum(n)')} AS std, {s6('min(q01)')} AS q01, {s6('max(q99)')} AS q99 FROM s GROUP BY 1")
def norm_stats_merge(spark, sf_dir):
    """Statistics of ten datasets as one: linear by rows, outer quantiles."""
    return rounded(stats.merge_stats(_by_label(spark, sf_dir), "n", "dim"), "mean", "std", "q01", "q99")


@query(f"WITH {{vectors}} SELECT CAST(dim AS INTEGER) AS dim, {s6('avg(x)')} AS mean, {s6('stddev_pop(x)')} AS std FROM v GROUP BY 1")
def norm_stats_pooled(spark, sf_dir):
    """The deviation of the union from the parts, against the union itself."""
    return rounded(stats.pooled_deviation(_by_label(spark, sf_dir), "n", "dim"), "mean", "std")


def _hist(q: float) -> str:
    return (
        "WITH b AS (SELECT event_type, min(value) - 1e-10 AS lo, (max(value) + 1e-10 - (min(value) - 1e-10)) / 5000 AS w FROM events GROUP BY 1), h AS (SELECT event_type, lo, w, least(floor((value - lo) / w), 4999) AS bin, count(*) AS n FROM events JOIN b USING (event_type) GROUP BY 1, 2, 3, 4), "
        f"c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS c, sum(n) OVER (PARTITION BY event_type) AS t FROM h) SELECT event_type, CAST(0 AS INTEGER) AS dim, {s6('min(lo + bin * w)')} AS value FROM c WHERE c >= {q} * t GROUP BY 1"
    )


def _quantile(spark, sf_dir, q):
    long = load(spark, sf_dir, "events").select("event_type", F.lit(0).alias("dim"), F.col("value").alias("x"))
    return rounded(stats.histogram_quantile(stats.histogram(long, 5000, "event_type"), q, "event_type"), "value")


@query(_hist(0.01))
def hist_quantile_01(spark, sf_dir):
    return _quantile(spark, sf_dir, 0.01)


@query(_hist(0.99))
def hist_quantile_99(spark, sf_dir):
    return _quantile(spark, sf_dir, 0.99)


_ST = "s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM v GROUP BY 1)"


def _with_stats(spark, sf_dir):
    """Vectors beside the statistics of all, as arrays: one row of statistics, as wide as a vector."""
    v = vectors(spark, sf_dir)
    long = stats.by_dimension(v, "e")
    one = long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.percentile("x", 0.01).alias("q01"), F.percentile("x", 0.99).alias("q99"))
    row = one.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "q01", "q99"))).alias("s")).first()["s"]
    return v, {k: F.array(*[F.lit(r[k]) for r in row]) for k in ("mean", "std", "q01", "q99")}


@query(f"WITH {{vectors}}, {_ST} SELECT vec_id, CAST(dim AS INTEGER) AS dim, {s6('(x - mean) / (std + 1e-6)')} AS x FROM v JOIN s USING (dim)")
def zscore_normalise(spark, sf_dir):
    v, s = _with_stats(spark, sf_dir)
    return exploded(v.select("vec_id", arrays.zscore(F.col("e"), s["mean"], s["std"]).alias("z")), "z", "vec_id")


@query(f"WITH {{vectors}}, {_ST} SELECT vec_id, CAST(dim AS INTEGER) AS dim, {s6('(x - q01) / (q99 - q01 + 1e-6) * 2 - 1')} AS x FROM v JOIN s USING (dim)")
def quantile_normalise(spark, sf_dir):
    v, s = _with_stats(spark, sf_dir)
    return exploded(v.select("vec_id", arrays.quantile_scale(F.col("e"), s["q01"], s["q99"]).alias("z")), "z", "vec_id")


@query(f"WITH {{vectors}} SELECT vec_id, CAST(dim AS INTEGER) AS dim, {s6('x')} AS z, {s6('x')} AS q FROM v")
def unnormalise_roundtrip(spark, sf_dir):
    v, s = _with_stats(spark, sf_dir)
    z = arrays.zscore_back(arrays.zscore(F.col("e"), s["mean"], s["std"]), s["mean"], s["std"])
    q = arrays.quantile_back(arrays.quantile_scale(F.col("e"), s["q01"], s["q99"]), s["q01"], s["q99"])
    return v.select("vec_id", F.posexplode(F.arrays_zip(z.alias("z"), q.alias("q"))).alias("dim", "p")).select("vec_id", "dim", r6("p.z").alias("z"), r6("p.q").alias("q"))


def _parts(spark, sf_dir):
    e = F.col("e")
    return vectors(spark, sf_dir).select("vec_id", F.slice(e, 1, 12).alias("delta_eef"), F.slice(e, 13, 1).alias("delta_height"), F.slice(e, 14, 3).alias("navigate"), F.slice(e, 17, 2).alias("hand_status"), (F.col("label") % 2).cast("int").alias("_dataset_idx"))


@query(f"WITH {{vectors}} SELECT vec_id, CAST(dim AS INTEGER) AS dim, {s6('x')} AS x FROM v WHERE dim < 18")
def concat_actions(spark, sf_dir):
    return exploded(_parts(spark, sf_dir).transform(transforms.concat_actions(["delta_eef", "delta_height", "navigate", "hand_status"], mask="m")), "actions", "vec_id")


@query(f"WITH {{vectors}} SELECT vec_id, CAST(dim AS INTEGER) AS dim, {s6('x')} AS x FROM v WHERE dim < CASE WHEN label % 2 = 0 THEN 18 ELSE 16 END")
def per_dataset_concat(spark, sf_dir):
    """The second dataset has no hand status."""
    keys = ["delta_eef", "delta_height", "navigate", "hand_status"]
    return exploded(_parts(spark, sf_dir).transform(transforms.concat_by_dataset([keys, keys[:3]])), "actions", "vec_id")


@query(f"WITH {{vectors}}, d AS (SELECT * FROM v WHERE dim < 18 UNION ALL SELECT vec_id, label, 0, unnest(range(18, 32)) FROM embeddings) SELECT vec_id, CAST(dim AS INTEGER) AS dim, {s6('x')} AS x FROM d")
def pad_actions(spark, sf_dir):
    return exploded(vectors(spark, sf_dir).select("vec_id", arrays.pad_to(F.slice("e", 1, 18), 32).alias("a")), "a", "vec_id")


@query(f"WITH {{vectors}} SELECT vec_id, CAST(dim AS INTEGER) AS dim, {s6('x')} AS x FROM v WHERE dim < 32")
def pad_and_cut(spark, sf_dir):
    return exploded(vectors(spark, sf_dir).select("vec_id", arrays.fit_to(F.col("e"), 32).alias("a")), "a", "vec_id")


@query(f"WITH {{vectors}} SELECT vec_id, CAST(dim // 3 AS INTEGER) AS dim, {s6('x')} AS x FROM v WHERE dim % 3 = 0")
def subsample_actions(spark, sf_dir):
    return exploded(vectors(spark, sf_dir).select("vec_id", arrays.stride(F.col("e"), 3).alias("a")), "a", "vec_id")


_MASK = arrays.bool_mask(6, -1, 6, -1)


def _chunks(spark, sf_dir):
    """Three rows of actions of fourteen, and a state of fourteen."""
    e = F.col("e")
    return vectors(spark, sf_dir).select("vec_id", F.slice(e, 1, 14).alias("state"), F.array(*[F.slice(e, 15 + 14 * k, 14) for k in range(3)]).alias("actions"))


def _shift_sql(sign: str) -> str:
    held = " OR ".join(f"a.dim % 14 = {i}" for i, m in enumerate(_MASK) if m)
    return f"WITH {{vectors}} SELECT a.vec_id, CAST((a.dim - 14) // 14 AS INTEGER) AS row, CAST(a.dim % 14 AS INTEGER) AS dim, {s6(f'a.x {sign} CASE WHEN {held} THEN s.x ELSE 0 END')} AS x FROM v a JOIN v s ON a.vec_id = s.vec_id AND s.dim = a.dim % 14 WHERE a.dim BETWEEN 14 AND 55"


def _chunk_rows(df):
    return exploded(df.select("vec_id", F.posexplode("a").alias("row", "r")), "r", "vec_id", "row")


@query(_shift_sql("-"))
def delta_actions(spark, sf_dir):
    return _chunk_rows(_chunks(spark, sf_dir).select("vec_id", arrays.delta_actions(F.col("actions"), F.col("state"), _MASK).alias("a")))


@query(_shift_sql("+"))
def absolute_actions(spark, sf_dir):
    return _chunk_rows(_chunks(spark, sf_dir).select("vec_id", arrays.absolute_actions(F.col("actions"), F.col("state"), _MASK).alias("a")))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS flag FROM lineitem WHERE l_orderkey < 500")
def repack(spark, sf_dir):
    """Columns into a nested sample, renamed by patterns, and back to leaves."""
    li = load(spark, sf_dir, "lineitem").where("l_orderkey < 500")
    nested = li.transform(transforms.compose(transforms.repack({"obs": {"id": "l_orderkey", "line": "l_linenumber"}, "act": {"quantity": "l_quantity", "price": "l_extendedprice", "tax": "l_tax"}, "flag": "l_returnflag"}), transforms.rename({r"act/tax": None, r"act/(.+)": r"action/\1"})))
    return nested.select("obs.id", "obs.line", "action.quantity", "action.price", "flag")


@query("SELECT conv_id, turn, 'task ' || (conv_id % 5) AS prompt FROM conversations")
def prompt_join(spark, sf_dir):
    tasks = spark.createDataFrame([(i, f"task {i}") for i in range(5)], "task_index long, task string")
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 5).alias("task_index"))
    return c.transform(transforms.prompt_from_task(tasks)).select("conv_id", "turn", "prompt")


@query("SELECT conv_id, turn, translate(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '_' || chr(10), '  ') AS prompt FROM conversations")
def prompt_clean(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.clean_prompt(F.col("text")).alias("prompt"))


@query("WITH {vectors} SELECT vec_id, CAST(dim AS INTEGER) AS dim, CAST(CASE WHEN x * 4 < -1 THEN -1 ELSE least(floor(x * 4 * 128) + 128, 255) END AS INTEGER) AS digit FROM v")
def state_digitise(spark, sf_dir):
    d = F.transform("e", lambda v: tokens.digitise(v * 4))
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(d).alias("dim", "digit"))


@query(
    "WITH {vectors}, s AS (SELECT vec_id, string_agg(CAST(CASE WHEN x < -1 THEN -1 ELSE least(floor(x * 128) + 128, 255) END AS INTEGER), ' ' ORDER BY dim) AS digits FROM v WHERE dim < 8 GROUP BY 1) "
    "SELECT vec_id, 'Task: pick up ' || vec_id || ', State: ' || digits || ';' || chr(10) || 'Action: ' AS prompt FROM s"
)
def state_prompt(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", tokens.state_prompt(F.concat(F.lit(" Pick_up\n"), F.col("vec_id").cast("string")), F.slice("e", 1, 8)).alias("prompt"))


@query(
    "WITH t AS (SELECT vec_id, label + 2 AS n FROM embeddings) SELECT vec_id, CAST(i AS INTEGER) AS place, CAST(CASE WHEN i < n THEN i * 7 % 11 ELSE 0 END AS INTEGER) AS token, i < n AS valid, CASE WHEN i >= 3 AND i < n THEN 1 ELSE 0 END AS loss FROM t CROSS JOIN range(10) r(i)"
)
def token_pad_mask(spark, sf_dir):
    """Token arrays cut or padded to ten, their mask, and the mask of what comes behind a prefix of three."""
    t = vectors(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.col("label") + 1), lambda i: i * 7 % 11).alias("t"))
    post = F.slice("t", 4, 100)
    z = F.arrays_zip(tokens.pad_tokens(F.col("t"), 10).alias("t"), tokens.token_mask(F.col("t"), 10).alias("m"), F.when(F.size("t") >= 3, tokens.postfix_mask(F.slice("t", 1, 3), post, 10)).otherwise(F.array_repeat(F.lit(0), 10)).alias("l"))
    return t.select("vec_id", F.posexplode(z).alias("place", "z")).select("vec_id", "place", F.col("z.t").cast("int").alias("token"), F.col("z.m").alias("valid"), F.col("z.l").alias("loss"))


@query("SELECT event_id, 257152 - 1 - 128 - event_id % 2048 AS token, (event_id % 8) * 1 + (event_id // 8 % 6) * 8 + (event_id // 48 % 5) * 48 AS code, event_id % 8 AS d0, event_id // 8 % 6 AS d1, event_id // 48 % 5 AS d2 FROM events")
def token_codes(spark, sf_dir):
    """Action tokens from behind, and digits of a mixed radix to a code and back."""
    i = F.col("event_id")
    digits = F.array(i % 8, F.floor(i / 8) % 6, F.floor(i / 48) % 5)
    code = tokens.fsq_index(digits, [8, 6, 5])
    back = tokens.fsq_digits(code, [8, 6, 5])
    out = load(spark, sf_dir, "events").select("event_id", tokens.action_token(i % 2048, 257152).cast("long").alias("token"), code.cast("long").alias("code"), back.alias("b"))
    return out.select("event_id", "token", "code", *[F.get("b", F.lit(k)).cast("long").alias(f"d{k}") for k in range(3)])


@query(f"WITH t AS (SELECT vec_id, label FROM embeddings) SELECT vec_id, CAST(i AS INTEGER) AS place, {s6('CASE WHEN i <= label THEN (i * 3 % 16) / 16.0 * 2 - 1 ELSE 0 END')} AS value FROM t CROSS JOIN range(6) r(i)")
def token_unbin(spark, sf_dir):
    t = vectors(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.col("label")), lambda i: i * 3 % 16).alias("t"))
    return t.select("vec_id", F.posexplode(tokens.unbin(F.col("t"), 16, 6)).alias("place", "value")).withColumn("value", r6("value"))


@query(
    "WITH {vectors}, a AS (SELECT vec_id, dim, CASE WHEN x > 0 THEN 1 ELSE 0 END AS s, x > -0.1 AS ok FROM v WHERE dim < 6), c AS (SELECT *, sum(s) OVER (PARTITION BY vec_id ORDER BY dim) AS c FROM a) "
    "SELECT q.vec_id, CAST(q.dim AS INTEGER) AS q, CAST(k.dim AS INTEGER) AS k, k.c <= q.c AND k.ok AND q.ok AS attends FROM c q JOIN c k ON q.vec_id = k.vec_id"
)
def block_causal_mask(spark, sf_dir):
    e = F.slice("e", 1, 6)
    m = vectors(spark, sf_dir).select("vec_id", F.transform(e, lambda v: (v > 0).cast("int")).alias("s"), F.transform(e, lambda v: v > -0.1).alias("ok"))
    m = m.select("vec_id", F.posexplode(tokens.block_causal(F.col("s"), F.col("ok"))).alias("q", "r"))
    return m.select("vec_id", "q", F.posexplode("r").alias("k", "attends"))


def _poses(spark, sf_dir):
    f = pose_frames(spark, sf_dir)
    return f.withColumns(pose.pose_columns(F.col("e"))).drop("e")


_P = (
    "e AS (SELECT CAST(label AS BIGINT) AS episode_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
    "n AS (SELECT episode_id, frame_index, e[1] AS px, e[2] AS py, e[3] AS pz, sqrt(e[4]*e[4]+e[5]*e[5]+e[6]*e[6]+e[7]*e[7]) AS l, e FROM e), q AS (SELECT episode_id, frame_index, px, py, pz, e[4]/l AS x, e[5]/l AS y, e[6]/l AS z, e[7]/l AS w FROM n)"
)
_MAT = {"00": "1-2*(y*y+z*z)", "01": "2*(x*y-z*w)", "02": "2*(x*z+y*w)", "10": "2*(x*y+z*w)", "11": "1-2*(x*x+z*z)", "12": "2*(y*z-x*w)", "20": "2*(x*z-y*w)", "21": "2*(y*z+x*w)", "22": "1-2*(x*x+y*y)"}
_M = "m AS (SELECT *, " + ", ".join(f"{v} AS r{k}" for k, v in _MAT.items()) + " FROM q)"
_LAG = "g AS (SELECT *, " + ", ".join(f"lag({c}) OVER (PARTITION BY episode_id ORDER BY frame_index) AS o{c}" for c in [*[f"r{k}" for k in _MAT], "px", "py", "pz"]) + " FROM m)"
_REL = "d AS (SELECT *, " + ", ".join(f"or0{i}*r0{j} + or1{i}*r1{j} + or2{i}*r2{j} AS d{i}{j}" for i in range(3) for j in range(3)) + " FROM g)"


@query(
    f"WITH {_P}, {_M}, {_LAG}, {_REL} SELECT episode_id, frame_index, "
    + ", ".join(f"{s6(f'coalesce(or0{i}*(px-opx) + or1{i}*(py-opy) + or2{i}*(pz-opz), 0)')} AS {n}" for i, n in enumerate(("dx", "dy", "dz")))
    + f", {s6('coalesce(atan2(d21, d22), 0)')} AS roll, {s6('coalesce(asin(CASE WHEN -d20 > 1 THEN 1 WHEN -d20 < -1 THEN -1 ELSE -d20 END), 0)')} AS pitch, {s6('coalesce(atan2(d10, d00), 0)')} AS yaw FROM d"
)
def pose_delta(spark, sf_dir):
    """Differences of poses, against rotation matrices."""
    out = pose.pose_delta(_poses(spark, sf_dir))
    return rounded(out, "dx", "dy", "dz", "roll", "pitch", "yaw").select("episode_id", "frame_index", "dx", "dy", "dz", "roll", "pitch", "yaw")


@query(f"WITH {_P}, {_M} SELECT episode_id, frame_index, {s6('atan2(r21, r22)')} AS roll, {s6('asin(greatest(least(-r20, 1), -1))')} AS pitch, {s6('atan2(r10, r00)')} AS yaw FROM m")
def quat_to_rpy(spark, sf_dir):
    p = _poses(spark, sf_dir)
    r = G.rpy(tuple(F.col(c) for c in pose.POSE[3:]))
    return p.select("episode_id", "frame_index", *[r6(c).alias(n) for c, n in zip(r, ("roll", "pitch", "yaw"))])


@query(
    f"WITH {_P}, {_M}, f AS (SELECT episode_id, px AS bx, py AS bpy, pz AS bz, " + ", ".join(f"r{k} AS b{k}" for k in _MAT) + " FROM m WHERE frame_index = 0) SELECT m.episode_id, m.frame_index, "
    + ", ".join(f"{s6(f'b0{i}*(px-bx) + b1{i}*(py-bpy) + b2{i}*(pz-bz)')} AS {n}" for i, n in enumerate(("x", "y", "z")))
    + " FROM m JOIN f USING (episode_id)"
)
def base_frame_pose(spark, sf_dir):
    """Positions seen from the first pose of the episode."""
    from strideframe.operators.frames import whole

    p = _poses(spark, sf_dir)
    first = tuple(F.first(c).over(whole()) for c in pose.POSE)
    moved, _ = G.relative_pose((first[:3], first[3:]), (tuple(F.col(c) for c in pose.POSE[:3]), tuple(F.col(c) for c in pose.POSE[3:])))
    return p.select("episode_id", "frame_index", *[r6(c).alias(n) for c, n in zip(moved, "xyz")])


@query(f"WITH {_P}, {_M} SELECT episode_id, frame_index, {s6('-pz')} AS x, {s6('-px')} AS y, {s6('py')} AS z, {s6('-r20')} AS r00, {s6('-r00')} AS r10, {s6('r10')} AS r20 FROM m")
def world_reframe(spark, sf_dir):
    """Poses in the robot's world: position, and the first column of the rotation."""
    p = _poses(spark, sf_dir)
    pos, q = G.world_frame(tuple(F.col(c) for c in pose.POSE[:3]), tuple(F.col(c) for c in pose.POSE[3:]))
    axis = G.rotate(q, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return p.select("episode_id", "frame_index", *[r6(c).alias(n) for c, n in zip((*pos, *axis), ("x", "y", "z", "r00", "r10", "r20"))])


@query(f"WITH {_P}, {_M} SELECT episode_id, frame_index, {s6('-r01')} AS l, {s6('r01')} AS s, {s6('-r02')} AS d FROM m")
def hand_reframe(spark, sf_dir):
    """Local axes of the hands: the second axis of the left and right hand, and the third one of both, in x."""
    p = _poses(spark, sf_dir)
    q = tuple(F.col(c) for c in pose.POSE[3:])
    left, right = G.hand_frame(q, True), G.hand_frame(q, False)
    y, z = (F.lit(0.0), F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return p.select("episode_id", "frame_index", r6(G.rotate(right, y)[0]).alias("l"), r6(G.rotate(left, y)[0]).alias("s"), r6(G.rotate(right, z)[0]).alias("d"))


@query(f"WITH {_P}, {_LAG.replace(', lag(r00)', ', x AS x0, lag(r00)').replace('FROM m', 'FROM (SELECT *, 0 AS r00, 0 AS r01, 0 AS r02, 0 AS r10, 0 AS r11, 0 AS r12, 0 AS r20, 0 AS r21, 0 AS r22 FROM q)')}, h AS (SELECT *, lag(x) OVER k AS ox, lag(y) OVER k AS oy, lag(z) OVER k AS oz, lag(w) OVER k AS ow FROM g WINDOW k AS (PARTITION BY episode_id ORDER BY frame_index)), i AS (SELECT *, CASE WHEN x*ox+y*oy+z*oz+w*ow < 0 THEN -1 ELSE 1 END AS sg FROM h WHERE ox IS NOT NULL), b AS (SELECT *, ox*0.75+x*sg*0.25 AS bx, oy*0.75+y*sg*0.25 AS by_, oz*0.75+z*sg*0.25 AS bz, ow*0.75+w*sg*0.25 AS bw FROM i) SELECT episode_id, frame_index, {s6('opx*0.75+px*0.25')} AS px, {s6('bx/sqrt(bx*bx+by_*by_+bz*bz+bw*bw)')} AS qx, {s6('bw/sqrt(bx*bx+by_*by_+bz*bz+bw*bw)')} AS qw FROM b")
def pose_interpolation(spark, sf_dir):
    """A quarter of the way from the pose before to this one."""
    from strideframe.operators.frames import in_order

    p = _poses(spark, sf_dir)
    old = tuple(F.lag(c).over(in_order()) for c in pose.POSE)
    now = tuple(F.col(c) for c in pose.POSE)
    pos, q = G.blend_pose((old[:3], old[3:]), (now[:3], now[3:]), F.lit(0.25))
    return p.select("episode_id", "frame_index", r6(pos[0]).alias("px"), r6(q[0]).alias("qx"), r6(q[3]).alias("qw")).where("px IS NOT NULL")


@query(f"WITH {_P} SELECT episode_id, frame_index, round(px, 5) + 0 AS px, round(py, 5) + 0 AS py, round(pz, 5) + 0 AS pz FROM q")
def pose_replay(spark, sf_dir):
    """Differences replayed from the first pose give the poses back."""
    p = _poses(spark, sf_dir)
    d = pose.pose_delta(p).select("episode_id", "frame_index", "dx", "dy", "dz", "roll", "pitch", "yaw")
    first = p.where("frame_index = 0").select("episode_id", *[F.col(c).alias(f"f_{c}") for c in pose.POSE])
    out = pose.replay(d).join(first, "episode_id")
    moved, _ = G.compose_pose((tuple(F.col(f"f_{c}") for c in pose.POSE[:3]), tuple(F.col(f"f_{c}") for c in pose.POSE[3:])), (tuple(F.col(c) for c in pose.POSE[:3]), tuple(F.col(c) for c in pose.POSE[3:])))
    return out.select("episode_id", "frame_index", *[(F.round(c, 5) + F.lit(0.0)).alias(n) for c, n in zip(moved, ("px", "py", "pz"))])


@query()
def pose_smoothing(spark, sf_dir):
    """Rotations smoothed in the tangent space of the middle frame; not expressible in SQL."""
    return pose.smooth_rotation(pose.continuous_rotation(_poses(spark, sf_dir)), 11, 3).select("episode_id", "frame_index", *pose.POSE)


@query(f"SELECT vec_id, {s6('-embedding[3]::DOUBLE + 0.55')} AS x, {s6('-embedding[1]::DOUBLE')} AS y, {s6('embedding[2]::DOUBLE + 0.7')} AS z, {s6('(embedding[1]::DOUBLE + embedding[4]) / 2')} AS mid FROM embeddings")
def axis_transform(spark, sf_dir):
    v = vectors(spark, sf_dir)
    p, b = G.body_axes(G.parts(F.col("e"), 0, 3)), G.mid_point(G.parts(F.col("e"), 0, 3), G.parts(F.col("e"), 3, 3))
    return v.select("vec_id", *[r6(c).alias(n) for c, n in zip(p, "xyz")], r6(b[0]).alias("mid"))


_T = "t AS (SELECT vec_id, dim // 3 AS k, max(CASE WHEN dim % 3 = 0 THEN x END) AS x, max(CASE WHEN dim % 3 = 1 THEN x END) AS y, max(CASE WHEN dim % 3 = 2 THEN x END) AS z FROM v WHERE dim < 15 GROUP BY 1, 2)"


def _points(spark, sf_dir):
    e = F.col("e")
    return vectors(spark, sf_dir).select("vec_id", F.array(*[F.slice(e, 3 * k + 1, 3) for k in range(5)]).alias("p"))


@query(f"WITH {{vectors}}, {_T}, d AS (SELECT a.vec_id, a.k, avg(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.k <> b.k GROUP BY 1, 2) SELECT vec_id, {s6('avg(d)')} AS tip FROM d GROUP BY 1")
def tip_distance(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", r6(control.tip_distance(F.col("p"))).alias("tip"))


@query(
    f"WITH {{vectors}}, {_T}, s AS (SELECT a.vec_id, sum(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS path FROM t a JOIN t b ON a.vec_id = b.vec_id AND b.k = a.k + 1 GROUP BY 1), "
    f"c AS (SELECT a.vec_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS chord FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.k = 0 AND b.k = 4) SELECT vec_id, {s6('CASE WHEN chord > 1e-6 THEN path / chord ELSE 1 END')} AS curvature FROM s JOIN c USING (vec_id)"
)
def finger_curvature(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", r6(control.finger_curvature(F.col("p"))).alias("curvature"))


@query(
    f"SELECT vec_id, {s6('embedding[1]::DOUBLE * -1')} AS j0, {s6('embedding[2]::DOUBLE')} AS j1, {s6('CASE WHEN abs(embedding[3]::DOUBLE) > 0.1 THEN 0 ELSE embedding[3]::DOUBLE END')} AS held, "
    f"{s6('(embedding[4]::DOUBLE + 0.5476 + 0.6213) / (1.4910 + 0.6213)')} AS grip, {s6('(asin(least(greatest((0.022*0.022 + g*g - 0.036*0.036) / (2*0.022*g), -1), 1)) - 0.5476) / (1.6296 - 0.5476)')} AS angle FROM (SELECT *, abs(embedding[5]::DOUBLE) * (0.058 - 0.01844) + 0.01844 AS g FROM embeddings)"
)
def arm_adapters(spark, sf_dir):
    """Flipped joints, out-of-range zeroing, gripper maps."""
    e = F.col("e")
    flipped = control.flip_joints(F.slice(e, 1, 2), [-1, 1])
    return vectors(spark, sf_dir).select(
        "vec_id", r6(F.get(flipped, F.lit(0))).alias("j0"), r6(F.get(flipped, F.lit(1))).alias("j1"), r6(F.get(arrays.zero_out_of_range(F.slice(e, 3, 1), 0.1), F.lit(0))).alias("held"),
        r6(control.gripper_from_angular(F.get(e, F.lit(3)))).alias("grip"), r6(control.gripper_to_angular(F.abs(F.get(e, F.lit(4))))).alias("angle"),
    )


@query(
    f"WITH {{vectors}} SELECT vec_id, {s6('sum(CASE WHEN x > 0 THEN x ELSE 0 END) / greatest(count(*) FILTER (x > 0), 1)')} AS masked, bool_and((vec_id % 3) * 8e-6 <= 1e-5 + 1e-5 * abs(x + (vec_id % 3) * 8e-6)) AS same, {s6('sqrt(sum(x * x) FILTER (dim < 8))')} AS length FROM v GROUP BY 1"
)
def vector_checks(spark, sf_dir):
    """Masked mean, closeness to a vector a little off, distance to the origin."""
    e = F.col("e")
    head = F.slice(e, 1, 8)
    return vectors(spark, sf_dir).select("vec_id", r6(arrays.mean_where(e, F.transform(e, lambda v: v > 0))).alias("masked"), arrays.close_to(e, F.transform(e, lambda v: v + F.col("vec_id") % 3 * F.lit(8e-6))).alias("same"), r6(arrays.distance(head, F.transform(head, lambda _: F.lit(0.0)))).alias("length"))


@query(
    f"WITH {{vectors}}, w AS (SELECT vec_id, dim, x, CASE WHEN dim = 0 THEN power(0.9, 7) ELSE 0.1 * power(0.9, 7 - dim) END AS g FROM v WHERE dim < 8) SELECT vec_id, {s6('sum(x * g)')} AS ema, {s6('sum(CASE WHEN dim = 3 THEN 9 ELSE x END)')} AS put FROM w GROUP BY 1"
)
def vector_folds(spark, sf_dir):
    """Exponential mean along an array, and a value put at a place."""
    head = F.slice("e", 1, 8)
    put = F.aggregate(arrays.put_at(head, F.lit(3), F.lit(9.0)), F.lit(0.0), lambda s, v: s + v)
    return vectors(spark, sf_dir).select("vec_id", r6(arrays.exponential_mean(head, 0.9)).alias("ema"), r6(put).alias("put"))


@query(f"WITH {{vectors}}, k AS (SELECT vec_id, label % 6 + 1 AS n FROM embeddings) SELECT v.vec_id, CAST((dim + 8 - n) % 8 AS INTEGER) AS dim, {s6('x')} AS x FROM v JOIN k USING (vec_id) WHERE dim < 8")
def align_right(spark, sf_dir):
    """The first n elements rolled to the end."""
    v = vectors(spark, sf_dir).select("vec_id", F.slice("e", 1, 8).alias("a"), (F.col("label") % 6 + 1).alias("n"))
    valid = F.transform("a", lambda _, i: i < F.col("n"))
    return exploded(v.select("vec_id", arrays.align_right(F.col("a"), valid).alias("b")), "b", "vec_id")


@query(
    "SELECT event_id, "
    + ", ".join(f"{s6(f'{fn}(value / 100 * {2 * math.pi / (0.004 * 1000 ** (i / 3))!r})')} AS {fn}{i}" for fn in ("sin", "cos") for i in range(4))
    + " FROM events"
)
def position_embedding(spark, sf_dir):
    p = arrays.sinusoid(F.col("value") / 100, 8, 0.004, 4.0)
    e = load(spark, sf_dir, "events").select("event_id", p.alias("p"))
    return e.select("event_id", *[r6(F.get("p", F.lit(k))).alias(f"{'sin' if k < 4 else 'cos'}{k % 4}") for k in range(8)])


#: Fixed values of a six-joint arm, in metres: (alpha, a, d, angle offset) of each link.
ARM = [
    (0.0, 0.0, 0.123, 0.0),
    (-math.pi / 2, 0.0, 0.0, -math.pi * 172.22 / 180),
    (0.0, 0.28503, 0.0, -math.pi * 102.78 / 180),
    (math.pi / 2, -0.02198, 0.25075, 0.0),
    (-math.pi / 2, 0.0, 0.0, 0.0),
    (math.pi / 2, 0.0, 0.091, 0.0),
]


def _fk_sql() -> str:
    """The hand's place, from the last link back to the base: x' = c x - s y + a and so on."""
    out = "WITH k6 AS (SELECT vec_id, embedding, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM embeddings)"
    for i in range(6, 0, -1):
        alpha, a, d, off = ARM[i - 1]
        t = f"(embedding[{i}]::DOUBLE + {off!r})"
        ca, sa = math.cos(alpha), math.sin(alpha)
        u = f"(sin({t}) * x + cos({t}) * y)"
        out += f", k{i - 1} AS (SELECT vec_id, embedding, cos({t}) * x - sin({t}) * y + {a!r} AS x, {ca!r} * {u} - {sa!r} * (z + {d!r}) AS y, {sa!r} * {u} + {ca!r} * (z + {d!r}) AS z FROM k{i})"
    return out + f" SELECT vec_id, {s6('x')} AS x, {s6('y')} AS y, {s6('z')} AS z FROM k0"


@query(_fk_sql())
def forward_kinematics(spark, sf_dir):
    v = vectors(spark, sf_dir)
    m = G.forward_kinematics([F.get("e", F.lit(i)) for i in range(6)], ARM)
    return v.select("vec_id", *[r6(m[i][3]).alias(n) for i, n in enumerate("xyz")])


@query("SELECT doc_id, source FROM documents WHERE lang IS NOT NULL")
def required_columns(spark, sf_dir):
    """Rows that have all required parts; the others are reported elsewhere."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.array_compact(F.array(F.when(F.col("lang").isNotNull(), "lang"), F.lit("source"))).alias("have"))
    return filters.require_columns(d, "have", ["lang", "source"])[0].select("doc_id", "source")


@query(
    f"WITH {{vectors}}, m AS (SELECT vec_id, dim, x, CASE WHEN dim < 2 THEN (x - 0.5) / (2 + 1e-6) ELSE x END AS z, CASE WHEN dim < 2 THEN (x - (-3)) / (3 - (-3) + 1e-6) * 2 - 1 ELSE x END AS q FROM v WHERE dim < 3) "
    f"SELECT vec_id, {s6('sum(CASE WHEN dim < 2 THEN z END)')} AS z, {s6('sum(CASE WHEN dim < 2 THEN q END)')} AS q, {s6('max(x) FILTER (dim = 2)')} AS other, {s6('sum(x) FILTER (dim < 2)')} AS back FROM m GROUP BY 1"
)
def normalise_tree(spark, sf_dir):
    """Leaves by their statistics, by deviation and by quantile, and back; a leaf without statistics, and no statistics at all, change nothing."""
    e = F.col("e")
    tree = vectors(spark, sf_dir).select("vec_id", F.struct(F.slice(e, 1, 2).alias("state"), F.slice(e, 3, 1).alias("other")).alias("obs"))
    stats = {"obs/state": {"mean": [0.5, 0.5], "std": [2, 2], "q01": [-3, -3], "q99": [3, 3]}}

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    out = tree.transform(transforms.normalise(None)).transform(transforms.normalise(stats, strict=True))
    scaled = tree.transform(transforms.normalise(stats | {"absent": {"q01": [0], "q99": [1]}}, quantiles=True))
    back = out.transform(transforms.unnormalise(stats)).transform(transforms.normalise(stats, quantiles=True)).transform(transforms.unnormalise(stats, quantiles=True))
    both = out.select("vec_id", r6(total(F.col("obs.state"))).alias("z"), r6(F.get("obs.other", F.lit(0))).alias("other"))
    return both.join(scaled.select("vec_id", r6(total(F.col("obs.state"))).alias("q")), "vec_id").join(back.select("vec_id", r6(total(F.col("obs.state"))).alias("back")), "vec_id")
