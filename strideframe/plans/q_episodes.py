"""Queries over episodes and frames: sources, joins, resampling, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions import control, tokens
from strideframe.operators import asof, filters, frames as fr, resample, sampling, sequence
from strideframe.plans.registry import frames, load, query, r6, rounded, s6


@query(
    "WITH {frames}, e AS (SELECT episode_id, count(*) AS n_frames, min(ts_us) AS start_ts, max(ts_us) AS end_ts FROM f GROUP BY 1) "
    f"SELECT episode_id, n_frames, start_ts, end_ts, {s6('(end_ts - start_ts) / 1e6')} AS duration_s, CAST(coalesce(sum(n_frames) OVER (ORDER BY episode_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index FROM e"
)
def episode_index(spark, sf_dir):
    """Length, span and running start of each episode."""
    e = fr.episode_summary(frames(spark, sf_dir), "ts_us", 1e6)
    return rounded(fr.running_offset(e, "episode_id", "n_frames", "start_index"), "duration_s")


@query("WITH {frames} SELECT episode_id, frame_index, value FROM f WHERE episode_id IN (1, 5, 42, 77)")
def episode_scan_subset(spark, sf_dir):
    return frames(spark, sf_dir).where(F.col("episode_id").isin(1, 5, 42, 77)).select("episode_id", "frame_index", "value")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def episode_pairing(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return filters.pairing(docs.select("doc_id", "lang"), labels, "doc_id")[0]


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def episode_pairing_missing(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return filters.pairing(docs.select("doc_id", "lang"), labels, "doc_id")[1]


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS has_raw FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def three_way_lookup(spark, sf_dir):
    return filters.three_way(load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    "WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) "
    "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b ON a.user_id = b.user_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"
)
def batch_count_mismatch(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return filters.count_differences(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id")


@query(
    "WITH k AS (SELECT doc_id, source, coalesce(TRY_CAST(nullif(regexp_extract(source, '^src(\\d+)$', 1), '') AS BIGINT), 999999) AS batch FROM documents) "
    "SELECT doc_id, source, row_number() OVER (ORDER BY batch, doc_id) - 1 AS position FROM k"
)
def chronological_reorder(spark, sf_dir):
    """New numbers in the order (number in the folder's name, old number)."""
    batch = F.coalesce(F.nullif(F.regexp_extract("source", r"^src(\d+)$", 1), F.lit("")).cast("long"), F.lit(999999))
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", batch.alias("batch"))
    return fr.global_number(docs, "batch", "doc_id").drop("batch")


@query(
    "SELECT s AS name, coalesce(TRY_CAST(nullif(regexp_extract(s, 'episode_(\\d+)', 1), '') AS BIGINT), 0) AS episode, coalesce(TRY_CAST(nullif(regexp_extract(s, '^(\\d+)_(\\d+)$', 1), '') AS BIGINT), 999999) AS date, "
    "coalesce(TRY_CAST(nullif(regexp_extract(s, '^(\\d+)_(\\d+)$', 2), '') AS BIGINT), 999999) AS batch FROM (SELECT 'episode_' || user_id AS s FROM events UNION SELECT (user_id % 12 + 1) || '_' || event_type FROM events UNION SELECT (user_id % 12 + 1) || '_' || user_id % 5 FROM events)"
)
def name_keys(spark, sf_dir):
    """Numbers in the names of files and folders."""
    e = load(spark, sf_dir, "events")
    parts = [F.concat(F.lit("episode_"), "user_id"), F.concat_ws("_", (F.col("user_id") % 12 + 1).cast("string"), "event_type"), F.concat_ws("_", (F.col("user_id") % 12 + 1).cast("string"), (F.col("user_id") % 5).cast("string"))]
    names = e.select(F.explode(F.array(*parts)).alias("name")).distinct()
    date, batch = tokens.folder_key(F.col("name"))
    return names.select("name", tokens.episode_number(F.col("name")).alias("episode"), date.cast("long").alias("date"), batch.cast("long").alias("batch"))


@query("SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS episode_id FROM orders")
def episode_remap(spark, sf_dir):
    return fr.remap(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "episode_id")


@query("SELECT n.n_nationkey, n.n_name, coalesce(r.r_name, CAST(n.n_regionkey AS VARCHAR)) AS region FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n.n_regionkey = r.r_regionkey")
def dimension_lookup(spark, sf_dir):
    """The name from a dimension, or the key itself."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("k"))
    region = load(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").cast("string").alias("k"), F.col("r_name").alias("region"))
    return filters.lookup(nation, region, "k", "region").drop("k")


_MATCH = """WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), w AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
 m AS (SELECT c.user_id, c.event_id, c.t, w.t AS match_ts, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(w.t - c.t), w.t) AS k FROM c LEFT JOIN w USING (user_id)),
 n AS (SELECT user_id, event_id, t AS ts_us, match_ts, abs(match_ts - t) / 3.6e9 AS diff_h FROM m WHERE k = 1)"""
_LEVEL = "CASE WHEN diff_h > 50 THEN 'severe' WHEN diff_h > 20 THEN 'warning' ELSE 'ok' END"


def _matched(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    m = asof.nearest(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), "user_id", "ts_us")
    return m.withColumn("diff_h", F.abs(F.col("match_ts") - F.col("ts_us")) / 3.6e9)


@query(f"{_MATCH} SELECT user_id, event_id, ts_us, match_ts, {s6('diff_h')} AS diff_h FROM n")
def nearest_match(spark, sf_dir):
    """The nearest view of each click."""
    return rounded(_matched(spark, sf_dir), "diff_h")


_REPORT = f"count(*) AS frame_count, count(*) FILTER ({_LEVEL} = 'warning') AS warning_count, count(*) FILTER ({_LEVEL} = 'severe') AS severe_count, {s6('avg(diff_h)')} AS avg_diff, {s6('max(diff_h)')} AS max_diff"


@query(f"{_MATCH} SELECT user_id, {_REPORT} FROM n GROUP BY user_id")
def match_report(spark, sf_dir):
    return rounded(asof.match_report(_matched(spark, sf_dir), "user_id", "diff_h", 20, 50), "avg_diff", "max_diff")


@query(f"{_MATCH} SELECT user_id, {_REPORT} FROM n GROUP BY ROLLUP (user_id)")
def match_report_rollup(spark, sf_dir):
    return rounded(asof.match_report(_matched(spark, sf_dir), "user_id", "diff_h", 20, 50, total=True), "avg_diff", "max_diff")


@query(
    f"{_MATCH}, g AS (SELECT *, {_LEVEL} AS level FROM n), h AS (SELECT user_id, event_id, level, CAST(row_number() OVER (PARTITION BY user_id ORDER BY level <> 'severe', event_id) AS INTEGER) AS rank FROM g WHERE level <> 'ok') SELECT * FROM h WHERE rank <= 10"
)
def match_flagged_top10(spark, sf_dir):
    return asof.flagged(_matched(spark, sf_dir), "user_id", "event_id", "diff_h", 20, 50).select("user_id", "event_id", "level", "rank")


@query(f"WITH {{frames}} SELECT episode_id, frame_index // 5 AS frame_index, {s6('avg(value)')} AS value, arg_min(ts_us, frame_index) AS ts_us FROM f GROUP BY 1, 2")
def downsample_mean(spark, sf_dir):
    """Means of five frames, and their first time."""
    return rounded(resample.blocks(frames(spark, sf_dir), 5, resample.block_mean("value"), resample.block_first("ts_us")), "value")


@query("WITH {frames} SELECT episode_id, frame_index // 5 AS frame_index, arg_min(value, frame_index) AS value, arg_min(event_id, frame_index) AS event_id FROM f GROUP BY 1, 2")
def downsample_first(spark, sf_dir):
    return resample.blocks(frames(spark, sf_dir), 5, resample.block_first("value"), resample.block_first("event_id"))


@query("WITH {frames} SELECT episode_id, frame_index // 5 AS frame_index, value FROM f WHERE frame_index % 5 = 0")
def downsample_stride(spark, sf_dir):
    return resample.every(frames(spark, sf_dir), 5).select("episode_id", "frame_index", "value")


@query(
    "WITH {frames}, t AS (SELECT DISTINCT episode_id, frame_index // 3 AS frame_index FROM f), n AS (SELECT episode_id, count(*) AS n FROM f GROUP BY 1) "
    "SELECT t.episode_id, t.frame_index, f.value FROM t JOIN n USING (episode_id) JOIN f ON f.episode_id = t.episode_id AND f.frame_index = least(t.frame_index * 4, n - 1)"
)
def index_gather(spark, sf_dir):
    """Frame 4 i of the source, or its last one, for each target frame i."""
    f = frames(spark, sf_dir)
    target = resample.every(f, 3).select("episode_id", "frame_index")
    return resample.gather(target, f.select("episode_id", "frame_index", "value"), 4, ["value"])


@query("WITH {frames} SELECT a.episode_id, a.frame_index, a.value, b.event_id FROM f a JOIN f b ON a.episode_id = b.episode_id AND a.frame_index = b.frame_index")
def length_matched_zip(spark, sf_dir):
    f = frames(spark, sf_dir)
    return resample.zip_frames(f.select("episode_id", "frame_index", "value"), f.select("episode_id", "frame_index", "event_id"))


@query(f"WITH {{frames}} SELECT episode_id, frame_index, {s6('coalesce(value - lag(value) OVER (PARTITION BY episode_id ORDER BY frame_index), 0)')} AS delta FROM f")
def delta_height(spark, sf_dir):
    return frames(spark, sf_dir).select("episode_id", "frame_index", r6(sequence.delta("value")).alias("delta"))


_CENTRE = "(value - 100) / 1000"


@query(
    f"SELECT event_id, CASE WHEN {_CENTRE} > 0.04 THEN 0.2 WHEN {_CENTRE} < -0.04 THEN -0.1 ELSE 0.0 END::DOUBLE AS vx, CASE WHEN {_CENTRE} > 0.04 THEN 0.2 WHEN {_CENTRE} < -0.04 THEN -0.2 ELSE 0.0 END::DOUBLE AS vy, "
    f"CASE WHEN {_CENTRE} > 0.2 THEN 0.3 WHEN {_CENTRE} < -0.2 THEN -0.3 ELSE 0.0 END::DOUBLE AS yaw FROM events"
)
def discretise_command(spark, sf_dir):
    x = (F.col("value") - 100) / 1000
    return load(spark, sf_dir, "events").select("event_id", *[c.alias(n) for c, n in zip(control.discretise(x, x, x), ("vx", "vy", "yaw"))])


@query(
    f"SELECT event_id, CASE WHEN {_CENTRE} > 0.15 THEN 0.25 ELSE 0.0 END::DOUBLE AS garbage_vx, CASE WHEN {_CENTRE} < -0.04 OR {_CENTRE} > 0.04 THEN 0.0 WHEN {_CENTRE} > 0.1 THEN 0.3 ELSE 0.0 END::DOUBLE AS toy_vx, "
    f"{s6(f'CASE WHEN {_CENTRE} < -0.04 THEN -0.5 WHEN {_CENTRE} > 0.04 THEN 0.5 ELSE {_CENTRE} END')} AS toy_yaw FROM events"
)
def deploy_discretise(spark, sf_dir):
    x = (F.col("value") - 100) / 1000
    garbage, toy = control.deploy_discretise(x, x, "garbage"), control.deploy_discretise(x, x, "toy")
    return load(spark, sf_dir, "events").select("event_id", garbage[0].alias("garbage_vx"), toy[0].alias("toy_vx"), r6(toy[2]).alias("toy_yaw"))


@query(
    "WITH {frames}, r AS (SELECT DISTINCT episode_id, episode_id % 3 AS start, episode_id % 3 + 4 AS stop FROM f WHERE episode_id % 2 = 0 UNION ALL SELECT DISTINCT episode_id, 5, 9 FROM f WHERE episode_id % 4 = 0) "
    "SELECT episode_id, frame_index, value FROM f WHERE EXISTS (SELECT 1 FROM r WHERE r.episode_id = f.episode_id AND r.start <= f.frame_index AND f.frame_index < r.stop)"
)
def keep_range_filter(spark, sf_dir):
    f = frames(spark, sf_dir)
    ids = f.select("episode_id").distinct()
    a = ids.where("episode_id % 2 = 0").select("episode_id", (F.col("episode_id") % 3).alias("start"), (F.col("episode_id") % 3 + 4).alias("stop"))
    b = ids.where("episode_id % 4 = 0").select("episode_id", F.lit(5).cast("long").alias("start"), F.lit(9).cast("long").alias("stop"))
    return filters.keep_ranges(f, a.union(b)).select("episode_id", "frame_index", "value")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[a-z.]+/en/[0-9]*[02468]([?#]|$)')")
def path_filter(spark, sf_dir):
    """Pages in English with an even number."""
    return load(spark, sf_dir, "pages").where(F.col("url").rlike("^https?://[a-z.]+/en/[0-9]*[02468]([?#]|$)")).select("page_id", "url")


@query("SELECT doc_id, doc_id % 3 = 1 OR source LIKE '%1%' AS succeeded FROM documents")
def success_filter(spark, sf_dir):
    """Paths that tell of success in some part; what only comes near it does not count."""
    d = load(spark, sf_dir, "documents")
    path = F.concat(F.lit("runs/"), F.when(F.col("source").contains("1"), "a_success_").otherwise("succes/"), F.when(F.col("doc_id") % 3 == 1, "success").otherwise("failure"), F.lit("/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", filters.succeeded(path).alias("succeeded"))


@query(
    "WITH {frames}, e AS (SELECT episode_id, count(*) AS n, max(CASE WHEN event_type = 'error' OR value > 480 THEN 1 ELSE 0 END) AS bad, sum(value) AS total FROM f GROUP BY 1) "
    f"SELECT episode_id, CASE WHEN bad = 0 THEN {s6('total')} END AS total, CASE WHEN bad = 1 THEN 'ValueError: episode ' || episode_id || ' of ' || n || ' frames' END AS error FROM e"
)
def episode_isolation(spark, sf_dir):
    """Episodes with an error or a value out of range fail, each for itself, with its reason; the others are worked on."""

    def work(episode):
        if (episode["event_type"] == "error").any() or (episode["value"] > 480).any():
            raise ValueError(f"episode {episode['episode_id'].iloc[0]} of {len(episode)} frames")
        return episode.groupby("episode_id", as_index=False)["value"].sum().rename(columns={"value": "total"})

    done, failed = filters.isolate(frames(spark, sf_dir), work, "episode_id long, total double")
    return done.select("episode_id", r6("total").alias("total"), F.lit(None).cast("string").alias("error")).unionByName(failed.select("episode_id", F.lit(None).cast("double").alias("total"), "error"))


@query(
    "WITH {frames}, e AS (SELECT episode_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS has FROM f GROUP BY 1) "
    "SELECT episode_id, CASE WHEN NOT has THEN 'a dataset is missing' WHEN n = 0 THEN 'empty' WHEN n < 20 THEN 'too short' END AS reason FROM e"
)
def validity_gates(spark, sf_dir):
    e = frames(spark, sf_dir).groupBy("episode_id").agg(F.count("*").alias("n"), F.max((F.col("event_type") == "purchase").cast("int")).alias("has"))
    return e.select("episode_id", filters.validity(F.col("n"), F.col("has") == 1, 20).alias("reason"))


@query(
    "WITH {frames}, g AS (SELECT episode_id, frame_index, value, lag(value) OVER (PARTITION BY episode_id ORDER BY frame_index) AS p FROM f) SELECT episode_id, frame_index, value FROM g WHERE p IS NULL OR abs(value - p) > 50"
)
def data_changed(spark, sf_dir):
    return sequence.changed(frames(spark, sf_dir), ["value"], 50).select("episode_id", "frame_index", "value")


@query(
    "WITH {frames}, h AS (SELECT a.episode_id, a.frame_index, g.j, arg_min(b.value, b.frame_index) FILTER (b.frame_index = least(a.frame_index + g.j, n.last)) AS value, a.frame_index + g.j > n.last AS is_pad "
    "FROM f a CROSS JOIN (SELECT unnest(range(8)) AS j) g JOIN (SELECT episode_id, max(frame_index) AS last FROM f GROUP BY 1) n ON n.episode_id = a.episode_id JOIN f b ON b.episode_id = a.episode_id AND b.frame_index BETWEEN a.frame_index AND a.frame_index + 7 GROUP BY ALL) "
    "SELECT episode_id, frame_index, CAST(j AS INTEGER) AS j, value, is_pad FROM h"
)
def action_chunk(spark, sf_dir):
    """The values of the next eight frames, held at the end, one row for each place."""
    f = frames(spark, sf_dir)
    chunk = f.select("episode_id", "frame_index", sequence.look_ahead("value", 8).alias("a"), sequence.look_ahead_pad(8).alias("p"))
    return chunk.select("episode_id", "frame_index", F.posexplode(F.arrays_zip("a", "p")).alias("j", "z")).select("episode_id", "frame_index", "j", F.col("z.a").alias("value"), F.col("z.p").alias("is_pad"))


@query("WITH g AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, (SELECT count(*) FROM events) AS n FROM events) SELECT event_id, p // 32 AS batch_id, CAST(p % 32 AS INTEGER) AS place FROM g WHERE p < n // 32 * 32")
def drop_last_batches(spark, sf_dir):
    return sampling.batches(load(spark, sf_dir, "events").select("event_id"), "event_id", 32)


_QUOTA = "(SELECT * FROM (VALUES (0, 16), (1, 9), (2, 7)) q(dataset, quota))"


@query(
    f"SELECT CAST(dataset AS INTEGER) AS dataset, CAST(quota AS BIGINT) AS per_batch, CAST(quota * ((SELECT count(*) FROM embeddings WHERE label < 3) // 32) AS BIGINT) AS total, true AS in_range, true AS spread, true AS permuted FROM {_QUOTA}"
)
def weighted_sample_counts(spark, sf_dir):
    """Rows that the weighted sampler takes from each dataset: by quota in every batch, within the dataset, many different ones, at changing places."""
    sizes = {r["label"]: r["count"] for r in load(spark, sf_dir, "embeddings").where("label < 3").groupBy("label").count().collect()}
    rows = sampling.weighted_batches(spark, [sizes[i] for i in range(3)], [0.5, 0.3, 0.2], 32, seed=3)
    first = F.element_at(F.array(*[F.lit(sum(sizes[j] for j in range(i))) for i in range(4)]), F.col("dataset") + 1)
    size = F.element_at(F.array(*[F.lit(sizes[i]) for i in range(3)]), F.col("dataset") + 1)
    per = rows.groupBy("batch_id", "dataset").agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high"), F.collect_set("row").alias("rows"), F.array_sort(F.collect_list("place")).alias("places"))
    out = per.groupBy("dataset").agg(F.max("n").alias("per_batch"), F.sum("n").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("seen"), F.count_distinct("places").alias("orders"))
    # of n draws with replacement from s rows some s * (1 - exp(-n / s)) are different
    likely = size * (1 - F.exp(-F.col("total") / size))
    return out.select("dataset", "per_batch", "total", ((F.col("low") >= first) & (F.col("high") < first + size)).alias("in_range"), F.col("seen").between(0.7 * likely, 1.3 * likely).alias("spread"), (F.col("orders") > 1).alias("permuted"))


@query(
    "WITH b AS (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS batch), w AS (SELECT batch, CAST(trunc(batch * CAST(0.5 AS DOUBLE)) AS INTEGER) AS a, CAST(trunc(batch * CAST(0.3 AS DOUBLE)) AS INTEGER) AS b FROM b) "
    "SELECT batch, CAST(0 AS INTEGER) AS dataset, a AS quota FROM w UNION ALL SELECT batch, 1, b FROM w UNION ALL SELECT batch, 2, batch - a - b FROM w"
)
def batch_quota(spark, sf_dir):
    """Quotas of three datasets in batches of 1 to 64."""
    return spark.createDataFrame([(n, i, q) for n in range(1, 65) for i, q in enumerate(sampling.quotas([0.5, 0.3, 0.2], n))], "batch int, dataset int, quota int")


@query("SELECT n_nationkey, n_name, CAST(unnest(range(3)) AS INTEGER) AS epoch FROM nation")
def epoch_repeat(spark, sf_dir):
    return sampling.epochs(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 3)


@query("WITH g AS (SELECT event_id, value, (row_number() OVER (ORDER BY event_id) - 1) AS p, (SELECT count(*) FROM events) AS n FROM events) SELECT p // 16 AS batch_id, round(sum(value * (p % 16)), 4) AS weighted, CAST(count(*) AS INTEGER) AS size FROM g WHERE p < n // 16 * 16 GROUP BY 1")
def collate_batches(spark, sf_dir):
    """Batches as arrays in the order of their places, checked by a place-weighted sum."""
    b = sampling.collate(sampling.batches(load(spark, sf_dir, "events").select("event_id", "value"), "event_id", 16), "value")
    total = F.aggregate(F.transform("value", lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v)
    return b.select("batch_id", F.round(total, 4).alias("weighted"), F.size("value").alias("size"))


@query("SELECT CAST(0 AS INTEGER) AS _dataset_idx, s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT 1, c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def dataset_union(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return sampling.union_datasets([s, c])


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").exceptAll(load(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def key_intersection(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("SELECT user_id FROM events UNION SELECT c_custkey FROM customer")
def key_union(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id").union(load(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def first_n(spark, sf_dir):
    """The first hundred rows of a total order: a limit is the feature."""
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)
