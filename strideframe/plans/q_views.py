"""Queries over pixel tables, buffers, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import geometry as G
from strideframe.operators import sampling, stats, transforms, view
from strideframe.plans.registry import frames, load, query, r6, rounded, s6
from strideframe.sources import datasets
from strideframe.streaming import blend

#: A grid of pixels from line items: images by order, with a depth and a colour.
_GRID = "g AS (SELECT l_orderkey % 4 AS img, l_partkey % 12 AS x, l_suppkey % 10 AS y, avg(l_quantity) / 10 AS depth, avg(l_discount) AS c FROM lineitem GROUP BY 1, 2, 3)"


def grid(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    keys = [(F.col("l_orderkey") % 4).alias("img"), (F.col("l_partkey") % 12).alias("x"), (F.col("l_suppkey") % 10).alias("y")]
    return li.groupBy(*keys).agg((F.avg("l_quantity") / 10).alias("depth"), F.avg("l_discount").alias("c"))


@query(
    f"WITH {_GRID}, t AS (SELECT img, x + 0.3 * depth AS u, y - 0.2 * depth AS v, depth, c FROM g), z AS (SELECT *, exp(ln(1 + greatest(depth, 0)) / (max(ln(1 + greatest(depth, 0))) OVER (PARTITION BY img) + 1e-7) * 50) + 1e-7 AS z FROM t), "
    "k AS (SELECT img, floor(u) AS x, floor(v) AS y, (1-(u-floor(u)))*(1-(v-floor(v)))/z AS w, c FROM z UNION ALL SELECT img, floor(u), ceil(v), (1-(u-floor(u)))*(1-(ceil(v)-v))/z, c FROM z UNION ALL SELECT img, ceil(u), floor(v), (1-(ceil(u)-u))*(1-(v-floor(v)))/z, c FROM z UNION ALL SELECT img, ceil(u), ceil(v), (1-(ceil(u)-u))*(1-(ceil(v)-v))/z, c FROM z) "
    f"SELECT img, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, {s6('sum(w*c)/sum(w)')} AS c FROM k WHERE x >= 0 AND x < 12 AND y >= 0 AND y < 10 GROUP BY 1, 2, 3 HAVING sum(w) > 0"
)
def splat_image(spark, sf_dir):
    moved = grid(spark, sf_dir).withColumn("u", F.col("x") + 0.3 * F.col("depth")).withColumn("v", F.col("y") - 0.2 * F.col("depth")).drop("x", "y")
    return rounded(view.splat(moved, "img", "u", "v", "depth", ["c"], 12, 10), "c").select("img", "x", "y", "c")


@query(
    f"WITH {_GRID} SELECT a.img, a.x, a.y, (max(b.depth) - min(b.depth)) / (sum(b.depth) / 25 + 1e-6) < 1.5 AND a.depth > 0 AS reliable FROM g a JOIN g b ON a.img = b.img AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.img, a.x, a.y, a.depth"
)
def reliable_mask(spark, sf_dir):
    return view.reliable(grid(spark, sf_dir), "img", "depth", 5, 1.5).select("img", "x", "y", "reliable")


@query(f"WITH {_GRID} SELECT img, x, y, {s6('(x - 6) / 313.7 * depth')} AS px, {s6('(y - 5) / 287.3 * depth')} AS py, {s6('(x - 6) / 313.7 * depth * 313.7 / depth + 6')} AS u FROM g")
def unproject_project(spark, sf_dir):
    g = grid(spark, sf_dir)
    p = G.unproject(F.col("x"), F.col("y"), G.clean_depth(F.col("depth")), 313.7, 287.3, 6.0, 5.0)
    return g.select("img", "x", "y", r6(p[0]).alias("px"), r6(p[1]).alias("py"), r6(G.project(p, 313.7, 287.3, 6.0, 5.0)[0]).alias("u"))


@query(
    "WITH b AS (SELECT p_partkey, p_size * 40 AS w, p_size * 17 + 3 AS h, greatest(p_size * 40 / 224.0, (p_size * 17 + 3) / 224.0) AS r FROM part) "
    "SELECT p_partkey, CAST(floor(w / r) AS BIGINT) AS new_w, CAST(floor(h / r) AS BIGINT) AS new_h, CAST(floor((224 - floor(w / r)) / 2) AS BIGINT) AS pad_left, CAST(floor((224 - floor(h / r)) / 2) AS BIGINT) AS pad_top FROM b"
)
def resize_with_pad(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    box = G.fit_box(F.col("p_size") * 40, F.col("p_size") * 17 + 3, 224, 224)
    return p.select("p_partkey", *[box[c].cast("long").alias(c) for c in ("new_w", "new_h", "pad_left", "pad_top")])


_MASK = "m AS (SELECT l_orderkey % 30 AS batch, l_linenumber AS buffer, CASE WHEN l_discount > 0.03 THEN 1.0 ELSE 0.0 END::DOUBLE AS mask FROM lineitem)"


def masks(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 30).alias("batch"), F.col("l_linenumber").alias("buffer"), F.when(F.col("l_discount") > 0.03, 1.0).otherwise(0.0).alias("mask"))


@query(f"WITH {_MASK}, s AS (SELECT batch, buffer, sum(mask) AS score FROM m GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch ORDER BY score DESC, buffer) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 3")
def best_buffers(spark, sf_dir):
    return view.best_buffers(masks(spark, sf_dir), "batch", "buffer", "mask", 3)


@query(f"WITH {_MASK}, s AS (SELECT batch, buffer, avg(mask) AS a FROM m GROUP BY 1, 2), f AS (SELECT batch, min(buffer) AS one FROM s WHERE a >= 0.65 GROUP BY 1) SELECT s.batch, buffer, {s6('a')} AS mean_mask FROM s LEFT JOIN f USING (batch) WHERE one IS NULL OR one = buffer")
def exclusive_buffer(spark, sf_dir):
    return rounded(view.exclusive_full(masks(spark, sf_dir), "batch", "buffer", "mask", 0.65), "mean_mask")


@query("WITH {frames}, n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY frame_index DESC) - 1 AS slot FROM f) SELECT episode_id, event_id, CAST(slot AS INTEGER) AS slot FROM n WHERE slot < 4")
def newest_frames(spark, sf_dir):
    return view.newest(frames(spark, sf_dir), "episode_id", "frame_index", 4).select("episode_id", "event_id", "slot")


@query(
    "WITH {frames}, n AS (SELECT episode_id, event_id, frame_index + 1 AS n, count(*) OVER (PARTITION BY episode_id) AS total FROM f) SELECT episode_id, event_id, CAST(CASE WHEN n = total THEN 0 ELSE least(4, total) - n END AS INTEGER) AS slot FROM n WHERE n = total OR n < least(4, total)"
)
def frame_buffer(spark, sf_dir):
    """What a buffer of four slots holds in the end."""
    return view.frame_buffer(frames(spark, sf_dir), "episode_id", "frame_index", 4).select("episode_id", "event_id", "slot")


@query("WITH {frames} SELECT episode_id, frame_index, CASE WHEN frame_index % 3 = 0 THEN value * 2 ELSE value END AS value, (frame_index + 1) || '/' || count(*) OVER (PARTITION BY episode_id) AS label FROM f")
def replace_processed(spark, sf_dir):
    """Processed frames over the source, and the text over each frame."""
    from strideframe.operators.frames import frame_count

    f = frames(spark, sf_dir).select("episode_id", "frame_index", "value")
    done = f.where("frame_index % 3 = 0").withColumn("value", F.col("value") * 2)
    out = view.replace_frames(f, done, ["episode_id", "frame_index"], "value")
    return out.withColumn("label", view.overlay(F.col("frame_index"), frame_count()))


@query(f"WITH b AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.1) AS x0, quantile_cont(l_quantity, 0.9) AS x1, quantile_cont(l_extendedprice, 0.1) AS y0, quantile_cont(l_extendedprice, 0.9) AS y1 FROM lineitem GROUP BY 1) SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) + 0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0 AS intercept, count(*) AS n_used FROM lineitem JOIN b USING (l_returnflag) WHERE l_quantity BETWEEN x0 AND x1 AND l_extendedprice BETWEEN y0 AND y1 GROUP BY 1")
def trimmed_line_fit(spark, sf_dir):
    out = stats.trimmed_line(load(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.withColumns({c: F.round(c, 3) + F.lit(0.0) for c in ("slope", "intercept")})


@query(
    "WITH {frames}, s AS (SELECT episode_id, frame_index, event_type, value, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS b FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index)) "
    "SELECT episode_id, frame_index, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS click, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS view FROM s WINDOW w AS (PARTITION BY episode_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def latest_values(spark, sf_dir):
    """The last click and view at every frame."""
    out = blend.latest_values(frames(spark, sf_dir), "episode_id", "frame_index", "event_type", "value", ["click", "view"])
    return out.select("episode_id", "frame_index", "click", "view")


@query("SELECT 1024 AS n, 1024 AS inside, 1024 AS n_distinct, 1024 AS same, 1024 AS token_rows, true AS spread, true AS seeded")
def fake_source(spark, sf_dir):
    """A seeded source: so many different rows, within bounds and all over them, the same for one seed and others for another."""
    a, again, other = (datasets.fake(spark, 1024, {"state": 4}, {"tokens": 3}, seed=s).select("id", "state", "tokens") for s in (0, 0, 1))
    both = a.join(again.select("id", F.col("state").alias("again")), "id").join(other.select("id", F.col("state").alias("other")), "id")
    return both.agg(
        F.count("*").alias("n"),
        F.count_if((F.size("state") == 4) & F.forall("state", lambda v: (v >= -1) & (v < 1))).alias("inside"),
        F.count_distinct("state").alias("n_distinct"),
        F.count_if(F.col("state") == F.col("again")).alias("same"),
        F.count_if((F.size("tokens") == 3) & F.forall("tokens", lambda v: (v >= 0) & (v < 2048))).alias("token_rows"),
        ((F.min(F.array_min("state")) < -0.95) & (F.max(F.array_max("state")) > 0.95) & (F.abs(F.avg(F.get("state", F.lit(0)))) < 0.1)).alias("spread"),
        (F.count_if(F.col("state") == F.col("other")) == 0).alias("seeded"),
    )


@query(f"WITH {{frames}} SELECT episode_id, count(*) AS frame_count, {s6('avg(value)')} AS mean_value FROM f GROUP BY 1")
def sink_round_trip(spark, sf_dir):
    """Frames written by episode and read again, with the dimension of episodes."""
    import uuid

    root = f"{datasets.scratch(spark)}/episodes-{uuid.uuid4().hex}"
    f = frames(spark, sf_dir).select("episode_id", "frame_index", "value")
    datasets.write_episodes(f, root, overwrite=True)
    back = datasets.read_episodes(spark, root)
    return rounded(back.groupBy("episode_id").agg(F.count("*").alias("frame_count"), F.avg("value").alias("mean_value")), "mean_value")


@query("SELECT t.i AS choice, true AS fair, n_users, n_events, true AS jitter_fair, true AS seeded FROM (SELECT count(DISTINCT user_id) AS n_users, count(*) AS n_events FROM events), (VALUES (0), (1), (2)) t(i)")
def episode_choice(spark, sf_dir):
    """One of three instructions for each episode, always the same one, each about as often; a jitter that fills its bounds."""
    e = load(spark, sf_dir, "events").select("user_id", sampling.choose(F.col("user_id"), [F.lit(i) for i in range(3)], 4).alias("choice"), sampling.jitter(F.col("event_id"), 2.0).alias("j"), sampling.jitter(F.col("event_id"), 2.0, 1).alias("k"))
    users = e.groupBy("user_id").agg(F.min("choice").alias("choice"), F.max("choice").alias("other")).where("choice = other")
    whole = e.agg(F.count_if(F.abs("j") <= 2).alias("n_events"), ((F.min("j") < -1.9) & (F.max("j") > 1.9) & (F.abs(F.avg("j")) < 0.15)).alias("jitter_fair"), (F.avg((F.abs(F.col("j") - F.col("k")) < 1e-9).cast("int")) < 0.01).alias("seeded"))
    total = users.agg(F.count("*").alias("n_users"))
    counts = users.groupBy("choice").agg(F.count("*").alias("n")).join(F.broadcast(total)).join(F.broadcast(whole))
    # a third of the users, within four deviations
    return counts.select("choice", (F.abs(F.col("n") - F.col("n_users") / 3) < 4 * F.sqrt(F.col("n_users") * 2 / 9)).alias("fair"), "n_users", "n_events", "jitter_fair", "seeded")


@query("SELECT 3 * n_nationkey + 1 AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'go' END AS prompt, 2 AS n_kept FROM nation")
def leaf_operations(spark, sf_dir):
    """A function over selected leaves, default prompts where there are none, and dropped strings."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nested = n.transform(transforms.repack({"a": {"id": "n_nationkey"}, "b": {"name": "n_name"}}))
    changed = nested.transform(transforms.apply_leaves(["a/id"], lambda _, c: (c * 3 + 1).cast("int"), strict=True))
    has = changed.where("(a.id - 1) / 3 % 2 = 0").withColumn("prompt", F.col("b.name")).transform(transforms.default_prompt("go"))
    out = has.unionByName(changed.where("(a.id - 1) / 3 % 2 = 1").transform(transforms.default_prompt("go")))
    kept = transforms.drop_strings(out.withColumn("extra", F.lit("x")))
    return out.select(F.col("a.id").alias("id"), F.col("b.name").alias("name"), "prompt", F.lit(len(kept.columns)).alias("n_kept"))
