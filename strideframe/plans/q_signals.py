"""Queries over trajectories, hand signals and action streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strideframe.functions import control
from strideframe.functions import geometry as G
from strideframe.operators import frames as fr
from strideframe.operators import handwave, sequence, stats
from strideframe.plans.registry import frames, query, r6, rounded, s6
from strideframe.streaming import blend

_PATH = "{frames}, p AS (SELECT episode_id, frame_index, value / 100 AS x, frame_index * 0.1 AS y FROM f)"
_W = "OVER (PARTITION BY episode_id ORDER BY frame_index)"
_UPTO = "OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "OVER (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_ALL = "OVER (PARTITION BY episode_id)"


def path(spark, sf_dir):
    return frames(spark, sf_dir).select("episode_id", "frame_index", (F.col("value") / 100).alias("x"), (F.col("frame_index") * F.lit(0.1)).alias("y"))


_TANGENT = (
    _PATH + f", n AS (SELECT *, max(frame_index) {_ALL} AS last FROM p), d AS (SELECT n.episode_id, n.frame_index, b.x - a.x AS dx, b.y - a.y AS dy FROM n JOIN p a ON a.episode_id = n.episode_id AND a.frame_index = greatest(n.frame_index - 2, 0) "
    f"JOIN p b ON b.episode_id = n.episode_id AND b.frame_index = least(n.frame_index + 2, last)), u AS (SELECT episode_id, frame_index, CASE WHEN sqrt(dx*dx+dy*dy) >= 1e-9 THEN dx / sqrt(dx*dx+dy*dy) END AS ux, CASE WHEN sqrt(dx*dx+dy*dy) >= 1e-9 THEN dy / sqrt(dx*dx+dy*dy) END AS uy FROM d), "
    f"t AS (SELECT episode_id, frame_index, coalesce(last_value(ux IGNORE NULLS) {_UPTO}, 1) AS hx, coalesce(last_value(uy IGNORE NULLS) {_UPTO}, 0) AS hy FROM u)"
)


def heading(spark, sf_dir):
    return sequence.with_tangent(path(spark, sf_dir), "x", "y", 2)


@query(f"WITH {_TANGENT} SELECT episode_id, frame_index, {s6('hx')} AS dir_x, {s6('hy')} AS dir_y FROM t")
def tangent_direction(spark, sf_dir):
    return rounded(heading(spark, sf_dir), "dir_x", "dir_y").select("episode_id", "frame_index", "dir_x", "dir_y")


_SIGN = (
    f"q AS (SELECT episode_id, frame_index, a, b, a * lag(a) {_W} + b * lag(b) {_W} AS dot FROM s), i AS (SELECT *, count(*) FILTER (dot = 0) {_UPTO} AS island FROM q), "
    "c AS (SELECT episode_id, frame_index, a, b, CASE WHEN count(*) FILTER (dot < 0) OVER (PARTITION BY episode_id, island ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 2 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE AS sign FROM i)"
)


@query("WITH {frames}, s AS (SELECT episode_id, frame_index, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE cos(value) END AS a, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE sin(value) END AS b FROM f), " + _SIGN + f" SELECT episode_id, frame_index, sign, {s6('a * sign')} AS hx, {s6('b * sign')} AS hy FROM c")
def heading_continuity(spark, sf_dir):
    """Headings without flips, zeros planted."""
    zero = F.col("event_id") % 7 == 0
    h = frames(spark, sf_dir).select("episode_id", "frame_index", F.when(zero, 0.0).otherwise(F.cos("value")).alias("a"), F.when(zero, 0.0).otherwise(F.sin("value")).alias("b"))
    out = sequence.continuous_sign(h, ["a", "b"])
    return out.select("episode_id", "frame_index", "sign", r6(F.col("a") * F.col("sign")).alias("hx"), r6(F.col("b") * F.col("sign")).alias("hy"))


_NAV = (
    _TANGENT + f", st AS (SELECT t.episode_id, t.frame_index, p.x, p.y, hx, hy, lead(p.x) {{w}} - p.x AS dx, lead(p.y) {{w}} - p.y AS dy, lead(hx) {{w}} AS nx, lead(hy) {{w}} AS ny FROM t JOIN p USING (episode_id, frame_index)), "
    "g AS (SELECT *, (dx*hx + dy*hy) / 0.1 AS a, (dy*hx - dx*hy) / 0.1 AS b, atan2(hx*ny - hy*nx, hx*nx + hy*ny) / 0.1 AS c FROM st), "
    f"nav AS (SELECT episode_id, frame_index, x, y, hx, hy, coalesce(a, lag(a) {_W}, 0) AS vx, coalesce(b, lag(b) {_W}, 0) AS vy, coalesce(c, lag(c) {_W}, 0) AS wz FROM g)"
).replace("{w}", "OVER (PARTITION BY t.episode_id ORDER BY t.frame_index)")


def navigation(spark, sf_dir):
    return sequence.navigation_command(heading(spark, sf_dir), "x", "y", "dir_x", "dir_y", 0.1)


@query(f"WITH {_NAV} SELECT episode_id, frame_index, {s6('vx')} AS vx, {s6('vy')} AS vy, {s6('wz')} AS yaw_rate FROM nav")
def nav_command(spark, sf_dir):
    return rounded(navigation(spark, sf_dir), "vx", "vy", "yaw_rate").select("episode_id", "frame_index", "vx", "vy", "yaw_rate")


_INTEGRATED = (
    _NAV + f", ya AS (SELECT *, coalesce(sum(wz * 0.1) {_BEFORE}, 0) AS yaw FROM nav), mv AS (SELECT episode_id, frame_index, yaw, (cos(yaw)*vx - sin(yaw)*vy) * 0.1 AS mx, (sin(yaw)*vx + cos(yaw)*vy) * 0.1 AS my FROM ya) "
    f"SELECT episode_id, frame_index, round(yaw, 5) + 0 AS yaw, round(coalesce(sum(mx) {_BEFORE}, 0), 5) + 0 AS x, round(coalesce(sum(my) {_BEFORE}, 0), 5) + 0 AS y FROM mv"
)


@query("WITH " + _INTEGRATED)
def integrate_nav(spark, sf_dir):
    """Commands back to a path, seen from the first frame."""
    out = sequence.integrate(navigation(spark, sf_dir).drop("x", "y"), "vx", "vy", "yaw_rate", 0.1)
    return out.select("episode_id", "frame_index", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("yaw", "x", "y")])


@query(
    f"WITH {_TANGENT}, z AS (SELECT p.episode_id, p.frame_index, p.x - first_value(p.x) w AS dx, p.y - first_value(p.y) w AS dy, first_value(hx) w AS ax, first_value(hy) w AS ay FROM p JOIN t USING (episode_id, frame_index)) "
    f"SELECT episode_id, frame_index, {s6('dx*ax + dy*ay')} AS x0, {s6('dy*ax - dx*ay')} AS y0 FROM z".replace(" w AS", " OVER (PARTITION BY p.episode_id ORDER BY p.frame_index) AS").replace("first_value(p.x) w", "first_value(p.x) OVER (PARTITION BY p.episode_id ORDER BY p.frame_index)")
)
def frame0_rebase(spark, sf_dir):
    return rounded(sequence.rebase(heading(spark, sf_dir), "x", "y", "dir_x", "dir_y"), "x0", "y0").select("episode_id", "frame_index", "x0", "y0")


def _savgol_sql(window: int, order: int) -> str:
    shapes: dict = {}
    for n in range(3, window + 1):
        shapes.setdefault(sequence.savgol_shape(n, window, order), n)
    table = ", ".join(f"({least}, {i - wl // 2}, {w!r})" for (wl, po), least in shapes.items() for i, w in enumerate(sequence.savgol_coefficients(wl, po)))
    return (
        f"WITH {{frames}}, c(least, off, weight) AS (VALUES {table}), n AS (SELECT episode_id, count(*) AS n FROM f GROUP BY 1), m AS (SELECT episode_id, n, (SELECT max(least) FROM c WHERE least <= n.n) AS least FROM n) "
        "SELECT f.episode_id, f.frame_index, round(coalesce(sum(g.value * c.weight), any_value(f.value)), 5) + 0 AS smooth FROM f JOIN m USING (episode_id) LEFT JOIN c ON c.least = m.least "
        "LEFT JOIN f g ON g.episode_id = f.episode_id AND g.frame_index = greatest(least(f.frame_index + c.off, m.n - 1), 0) GROUP BY 1, 2"
    )


def _smoothed(spark, sf_dir, window, order, widest=64):
    out = sequence.smooth(frames(spark, sf_dir).select("episode_id", "frame_index", "value"), "value", "smooth", window, order, widest)
    return out.select("episode_id", "frame_index", (F.round("smooth", 5) + F.lit(0.0)).alias("smooth"))


@query(_savgol_sql(5, 2))
def savgol_w5(spark, sf_dir):
    return _smoothed(spark, sf_dir, 5, 2)


@query(_savgol_sql(11, 3))
def savgol_w11(spark, sf_dir):
    return _smoothed(spark, sf_dir, 11, 3)


@query(_savgol_sql(75, 3))
def savgol_wide(spark, sf_dir):
    """A window as wide as a whole episode, through convolutions."""
    return _smoothed(spark, sf_dir, 75, 3)


@query(f"SELECT event_id, {s6(f'value - {2 * math.pi!r} * floor((value + {math.pi!r}) / {2 * math.pi!r})')} AS angle FROM events")
def wrap_to_pi(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", r6(G.wrap_to_pi(F.col("value"))).alias("angle"))


@query(f"WITH {{frames}} SELECT episode_id, frame_index, {s6(f'CASE WHEN max(value) {_ALL} > min(value) {_ALL} THEN (value - min(value) {_ALL}) / (max(value) {_ALL} - min(value) {_ALL}) ELSE 0 END')} AS unit FROM f")
def minmax_norm(spark, sf_dir):
    return frames(spark, sf_dir).select("episode_id", "frame_index", r6(stats.scale_to_unit("value", "episode_id")).alias("unit"))


_UNIT = "(value - 0.01) / 490.02"


@query(
    f"WITH {{frames}}, u AS (SELECT episode_id, frame_index, {_UNIT} AS s, least(greatest(avg({_UNIT}) {_ALL} + 0.25, 0), 1) AS m FROM f) "
    f"SELECT episode_id, frame_index, {s6('CASE WHEN s >= m AND m < 1 THEN m + (1 - power(1 - (s - m) / (1 - m), 3)) * (1 - m) WHEN s <= m AND m > 0 THEN power(s / m, 3) * m ELSE s END')} AS by_mean, "
    f"{s6('CASE WHEN s >= 0.8 THEN 0.8 + (1 - power(1 - (s - 0.8) / 0.2, 2)) * 0.2 WHEN s <= 0.2 THEN power(s / 0.2, 2) * 0.2 ELSE s END')} AS by_bounds FROM u"
)
def enhance_signal(spark, sf_dir):
    s = (F.col("value") - 0.01) / 490.02
    u = frames(spark, sf_dir).withColumn("s", s).withColumn("m", control.mean_threshold(F.avg("s").over(fr.Window.partitionBy("episode_id"))))
    c = F.col("s")
    return u.select("episode_id", "frame_index", r6(control.enhance(c, F.col("m"), F.col("m"), 3, 3)).alias("by_mean"), r6(control.enhance(c, F.lit(0.8), F.lit(0.2), 2, 2)).alias("by_bounds"))


@query("WITH {frames} SELECT episode_id, frame_index, CASE WHEN frame_index >= 12 THEN 0 WHEN frame_index >= 4 THEN 1 ELSE 0 END AS pulse, CASE WHEN frame_index >= 20 THEN 0 WHEN frame_index >= 12 THEN 1 WHEN frame_index >= 6 THEN 0 WHEN frame_index >= 2 THEN 1 ELSE 0 END AS two FROM f")
def square_wave_generate(spark, sf_dir):
    i = F.col("frame_index")
    wave = lambda kind, *e: control.square_wave(i, kind, [F.lit(x) for x in e]).cast("int")
    return frames(spark, sf_dir).select("episode_id", "frame_index", wave("0-1-0", 4, 12).alias("pulse"), wave("0-1-0-1-0", 2, 6, 12, 20).alias("two"))


_FITTED = f"{{frames}}, u AS (SELECT episode_id, frame_index, {_UNIT} AS s, 1 + event_id % 3 AS g FROM f)"


def _signal(spark, sf_dir):
    return frames(spark, sf_dir).select("episode_id", "frame_index", ((F.col("value") - 0.01) / 490.02).alias("s"), (1 + F.col("event_id") % 3).cast("double").alias("g"))


@query(
    f"WITH {_FITTED}, c AS (SELECT episode_id, frame_index, sum(g * ((1-s)*(1-s) - s*s)) {_UPTO} AS p1, sum(g * ((1-s)*(1-s) - s*s)) {_UPTO} - g * ((1-s)*(1-s) - s*s) AS p0, sum(g*s*s) {_ALL} AS zero FROM u), "
    "o AS (SELECT a.episode_id, a.frame_index AS x, b.frame_index + 1 AS y, a.zero + b.p1 - a.p0 AS error FROM c a JOIN c b ON a.episode_id = b.episode_id AND a.frame_index <= b.frame_index) "
    f"SELECT episode_id, {s6('min(error)')} AS error FROM o GROUP BY 1"
)
def square_wave_fit(spark, sf_dir):
    """Least error of a wave 0-1-0, against all pairs of edges."""
    return rounded(handwave.fit_one_pulse(_signal(spark, sf_dir), "s", "g"), "error").select("episode_id", "error")


@query(
    f"WITH {_FITTED}, c AS (SELECT episode_id, frame_index + 1 AS at, max(frame_index) {_ALL} + 1 AS n, sum(g*s*s) {_UPTO} AS z, sum(g*(1-s)*(1-s)) {_UPTO} AS o, sum(g*s*s) {_ALL} AS tz FROM u) "
    f"SELECT a.episode_id, {s6('min(a.z + b.o - a.o + b.tz - b.z)')} AS error FROM c a JOIN c b ON a.episode_id = b.episode_id AND a.at < b.at AND b.at < b.n GROUP BY 1"
)
def square_wave_fit_general(spark, sf_dir):
    """The general fit, by dynamic programming; levels last at least one frame."""
    return rounded(handwave.fit_wave(_signal(spark, sf_dir), "s", "g", "0-1-0"), "error").where("NOT isnan(error)").select("episode_id", "error")


_CHUNKS = f"f2 AS (SELECT episode_id * 1000 + frame_index // 10 AS episode_id, frame_index % 10 AS frame_index, round({_UNIT}, 4) AS v FROM f)"


@query(
    "WITH {frames}, " + _CHUNKS + f", k AS (SELECT *, count(*) {_ALL} AS n FROM f2), b AS (SELECT k.*, p.kind, p.cut FROM k CROSS JOIN (SELECT 0 AS kind, 0 AS cut UNION ALL SELECT 1, 0 UNION ALL SELECT unnest([2, 3]) AS kind, a FROM range(1, 10) t(a)) p WHERE p.cut < k.n AND (k.n > 1 OR p.kind < 2)), "
    "e AS (SELECT episode_id, kind, cut, round(sum(power(CASE WHEN kind = 1 OR kind = 2 AND frame_index >= cut OR kind = 3 AND frame_index < cut THEN 1 ELSE 0 END - v, 2)), 9) AS e FROM b GROUP BY 1, 2, 3) SELECT k.episode_id, round(min(e), 8) + 0 AS error FROM k JOIN e USING (episode_id) WHERE n > 1 GROUP BY 1"
)
def gripper_binarise(spark, sf_dir):
    """Chunks of ten as 0s and 1s with one change at most: the error, against all patterns."""
    v = F.round((F.col("value") - 0.01) / 490.02, 4)
    chunks = frames(spark, sf_dir).select((F.col("episode_id") * 1000 + F.floor(F.col("frame_index") / 10)).alias("episode_id"), (F.col("frame_index") % 10).alias("frame_index"), v.alias("v"))
    out = handwave.binarise(chunks, "v")
    err = out.groupBy("episode_id").agg(F.sum((F.col("binary") - F.col("v")) ** 2).alias("error"), F.count("*").alias("n"))
    return err.where("n > 1").select("episode_id", (F.round("error", 8) + F.lit(0.0)).alias("error"))


_LEVELS = f"{{frames}}, l AS (SELECT episode_id, frame_index, CASE WHEN value > 60 THEN 1 ELSE 0 END AS level FROM f), ed AS (SELECT *, lag(level) {_W} AS p FROM l), e AS (SELECT episode_id, frame_index, level, row_number() {_W} - 1 AS edge FROM ed WHERE p <> level)"


def levels(spark, sf_dir):
    return frames(spark, sf_dir).select("episode_id", "frame_index", (F.col("value") > 60).cast("int").alias("level"))


@query(f"WITH {_LEVELS} SELECT episode_id, frame_index, level, CAST(edge AS INTEGER) AS edge FROM e")
def transition_edges(spark, sf_dir):
    return sequence.edges(levels(spark, sf_dir), "level")


@query(
    f"WITH {_LEVELS}, n AS (SELECT episode_id, count(*) AS n, arg_min(level, frame_index) AS first FROM l GROUP BY 1), m AS (SELECT e.episode_id, edge, level, least(greatest(frame_index + 1, 0), n) AS at FROM e JOIN n USING (episode_id)) "
    "SELECT l.episode_id, l.frame_index, coalesce(arg_max(m.level, m.edge), any_value(n.first)) AS shifted FROM l JOIN n USING (episode_id) LEFT JOIN m ON m.episode_id = l.episode_id AND m.at <= l.frame_index GROUP BY 1, 2"
)
def transition_shift(spark, sf_dir):
    """All changes one frame later."""
    return sequence.shift_edges(levels(spark, sf_dir), "level", [1] * 64).select("episode_id", "frame_index", "shifted")


@query(
    f"WITH {_LEVELS}, r AS (SELECT *, count(*) FILTER (level > 0.5) {_UPTO} AS run FROM l) SELECT episode_id, frame_index, CASE WHEN run > 0 THEN count(*) FILTER (level <= 0.5) OVER (PARTITION BY episode_id, run ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS open_frames, "
    "CASE WHEN run > 0 THEN count(*) FILTER (level <= 0.5) OVER (PARTITION BY episode_id, run ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END >= 3 AS stop FROM r"
)
def auto_stop_detect(spark, sf_dir):
    return sequence.stopped(levels(spark, sf_dir), "level", 3).select("episode_id", "frame_index", "open_frames", "stop")


@query(
    f"WITH {_LEVELS}, k AS (SELECT *, coalesce(p > 0.1 AND level <= 0.1, FALSE) AS fall FROM ed), c AS (SELECT *, count(*) FILTER (fall) {_UPTO} AS n FROM k), s AS (SELECT *, min(CASE WHEN fall AND n = 2 THEN frame_index END) {_ALL} AS start FROM c) "
    "SELECT episode_id, frame_index, CASE WHEN frame_index >= start AND frame_index < start + 4 THEN 1.0 ELSE level END::DOUBLE AS held FROM s"
)
def kth_transition_hold(spark, sf_dir):
    return sequence.hold_after_edge(levels(spark, sf_dir).withColumn("level", F.col("level").cast("double")), "level", 2, 4).select("episode_id", "frame_index", "held")


@query(f"WITH {{frames}} SELECT episode_id, frame_index, bool_or(value <= 5) {_UPTO} AS latched FROM f")
def zero_latch(spark, sf_dir):
    return sequence.latch(frames(spark, sf_dir), F.col("value") <= 5, "latched").select("episode_id", "frame_index", "latched")


@query("WITH {frames} SELECT episode_id, frame_index, frame_index // 2 * 5 + CASE WHEN frame_index % 2 = 1 THEN 2 ELSE 0 END + k AS step FROM f CROSS JOIN range(3) t(k) WHERE k < CASE WHEN frame_index % 2 = 0 THEN 2 ELSE 3 END")
def repeat_2_3(spark, sf_dir):
    return sequence.repeat_2_3(frames(spark, sf_dir)).select("episode_id", "frame_index", "step")


@query("WITH {frames} SELECT episode_id, frame_index, frame_index // 10 AS chunk, CAST(frame_index % 10 AS BIGINT) AS j, value FROM f")
def broker_steps(spark, sf_dir):
    """Steps served from chunks: which chunk, and which place in it."""
    return blend.broker(frames(spark, sf_dir), 10).select("episode_id", "frame_index", "chunk", "j", "value")


@query(
    "WITH {frames}, c AS (SELECT episode_id, frame_index // 10 AS chunk, frame_index % 10 AS j, value FROM f), n AS (SELECT episode_id, chunk, count(*) AS n FROM c GROUP BY 1, 2), "
    "o AS (SELECT c.episode_id, c.chunk, c.j, c.value, n.n, m.n AS old_n, m.n - 4 AS pending FROM c JOIN n USING (episode_id, chunk) LEFT JOIN n m ON m.episode_id = c.episode_id AND m.chunk = c.chunk - 1), "
    "w AS (SELECT o.*, least(greatest(pending, 4), n) AS overlap, old.value AS old_value FROM o LEFT JOIN c old ON old.episode_id = o.episode_id AND old.chunk = o.chunk - 1 AND old.j = least(4 + o.j, o.old_n - 1)) "
    f"SELECT episode_id, chunk, j, {s6('CASE WHEN old_n IS NULL OR pending <= 0 OR j >= overlap THEN value WHEN overlap = 1 THEN old_value ELSE old_value * (1 - j / (overlap - 1)) + value * (j / (overlap - 1)) END')} AS blended FROM w"
)
def chunk_blend(spark, sf_dir):
    """Each chunk blended with what was pending of the one before, four actions after that began."""
    c = frames(spark, sf_dir).select("episode_id", F.floor(F.col("frame_index") / 10).alias("chunk"), (F.col("frame_index") % 10).alias("j"), "value")
    return rounded(blend.blend_chunks(c, "value", consumed=4, least=4), "blended").select("episode_id", "chunk", "j", "blended")


@query(f"WITH {{frames}}, a AS (SELECT event_type AS g, value AS x, value % 17 AS m FROM f) SELECT g, {s6('sum(CASE WHEN m < 9 THEN x ELSE 0 END) / greatest(count(*) FILTER (m < 9), 1)')} AS masked, {s6('coalesce(sum(CASE WHEN x <= 10 THEN x END), 0) / greatest(count(*) FILTER (x <= 10), 1)')} AS below FROM a GROUP BY g")
def loss_means(spark, sf_dir):
    """Means over a mask and over values below a limit."""
    g = frames(spark, sf_dir).select(F.col("event_type").alias("g"), F.col("value").alias("x"), (F.col("value") % 17 < 9).alias("ok"))
    masked = F.sum(F.when(F.col("ok"), F.col("x")).otherwise(0.0)) / F.greatest(F.count_if("ok"), F.lit(1))
    return rounded(g.groupBy("g").agg(masked.alias("masked"), stats.mean_below("x", 10).alias("below")), "masked", "below")


@query(f"WITH {{frames}} SELECT frame_index // 20 AS interval, {s6('avg(value)')} AS value FROM f GROUP BY 1")
def interval_means(spark, sf_dir):
    return rounded(stats.interval_means(frames(spark, sf_dir), "frame_index", 20, "value"), "value")


@query(
    "SELECT event_id, least(greatest(value / 100, 0.36), 0.74) AS height, CASE WHEN value > 50 OR value % 10 > 5 THEN 1 ELSE 0 END AS trigger, "
    f"{s6('CASE WHEN event_id % 1000 < 100 THEN 1e-5 / 101 + (1e-5 - 1e-5 / 101) * (event_id % 1000) / 100 ELSE 1e-7 + (1e-5 - 1e-7) * 0.5 * (1 + cos(least((event_id % 1000 - 100) / 700, 1) * pi())) END * 1e5')} AS cosine, "
    f"{s6('CASE WHEN event_id % 1000 < 100 THEN 1e-5 / 101 + (1e-5 - 1e-5 / 101) * (event_id % 1000) / 100 ELSE 1e-5 / sqrt((10000 + event_id % 1000 - 100) / 10000) END * 1e5')} AS rsqrt FROM events"
)
def schedules_and_clamps(spark, sf_dir):
    """Height clamp, trigger, and two learning-rate schedules."""
    e, step = frames(spark, sf_dir), F.col("event_id") % 1000
    return e.select(
        "event_id",
        control.clamp(F.col("value") / 100, 0.36, 0.74).alias("height"),
        control.trigger_status(F.col("value") / 100, (F.col("value") % 10) / 10).alias("trigger"),
        r6(control.cosine_schedule(step, 100, 1e-5, 800, 1e-7) * 1e5).alias("cosine"),
        r6(control.rsqrt_schedule(step, 100, 1e-5, 10000.0) * 1e5).alias("rsqrt"),
    )
