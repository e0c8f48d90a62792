"""Streams against plain replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.streaming import blend


def test_stream_rules():
    s = blend.ActionStream()
    assert s.pop() is None
    s.put([[1.0], [2.0], [3.0]], max_drop=4)
    assert [s.pop()[0], s.pop()[0]] == [1.0, 2.0]
    s.put([[10.0]] * 2, max_drop=4)  # as many actions ran as the chunk has: ignored
    assert s.pop()[0] == 3.0 and s.last[0] == 3.0 and s.taken == 3
    s.put([[9.0]] * 4, max_drop=1, least=8)  # nothing pending: fades from the last action
    assert np.allclose([a[0] for a in s.queue], [3.0, 6.0, 9.0]) and s.taken == 0


def test_overlap_of_one_keeps_the_old():
    s = blend.ActionStream([[5.0]])
    s.put([[7.0]], 0, least=1)
    assert s.queue[0][0] == 5.0


def test_hands_are_binary():
    s = blend.ActionStream([np.full(18, 0.4)] * 3)
    s.put([np.full(18, 0.9)] * 6, 0, least=2)
    q = np.array(s.queue)
    assert set(q[:, 16:18].ravel()) <= {0.0, 1.0} and not set(q[:, 0]) <= {0.0, 1.0}


def test_batch_twin(spark):
    rng = np.random.default_rng(0)
    chunks = [rng.random(10) for _ in range(4)]
    df = spark.createDataFrame([(1, c, j, float(v)) for c, chunk in enumerate(chunks) for j, v in enumerate(chunk)], "episode_id long, chunk long, j long, v double")
    got = [r["blended"] for r in blend.blend_chunks(df, "v", consumed=4, least=4).orderBy("chunk", "j").collect()]
    want = list(chunks[0])
    for old, new in zip(chunks, chunks[1:]):
        s = blend.ActionStream([[v] for v in old[4:]])
        s.put([[v] for v in new], 0, least=4)
        want += [a[0] for a in s.queue]
    assert np.allclose(got, want)


def test_keyed_stream(spark, tmp_path):
    pytest.importorskip("pandas")
    schema = "stream_id long, ts timestamp, seq long, actions array<array<double>>"
    spark.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "false")
    rows = [(1, 0, 0, [[1.0], [2.0], [3.0]]), (1, 1, 1, None), (1, 2, 2, None), (1, 3, 3, [[10.0]] * 6), (1, 4, 4, None), (2, 1, 0, None)]
    src = tmp_path / "in"
    spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "stream_id long, t long, seq long, actions array<array<double>>").select("stream_id", F.timestamp_seconds("t").alias("ts"), "seq", "actions").write.parquet(str(src))
    out = blend.blend_stream(spark.readStream.schema(schema).parquet(str(src)), max_drop=8, least=2)
    q = out.writeStream.format("memory").queryName("actions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["stream_id"], r["seq"]): r["action"] for r in spark.table("actions").collect()}
    s = blend.ActionStream()
    s.put([[1.0], [2.0], [3.0]], 8, 2)
    first = [s.pop().tolist(), s.pop().tolist()]
    s.put([[10.0]] * 6, 8, 2)
    assert got == {(1, 1): first[0], (1, 2): first[1], (1, 4): s.pop().tolist(), (2, 0): None}


def streamed(spark, tmp_path, rows, schema, make, name):
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, schema)
    df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.parquet(src)
    stream = make(spark.readStream.schema(schema.replace("ts long", "ts timestamp")).parquet(src))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    table = spark.table(name)
    return spark.createDataFrame(table.collect(), table.schema)


def test_latest_stream(spark, tmp_path):
    rows = [(1, 0, 0, "a", 1.0), (1, 1, 1, None, None), (1, 2, 2, "b", 5.0), (1, 2, 3, "a", 2.0), (1, 3, 4, None, None), (2, 0, 5, None, None), (1, 4, 6, "other", 9.0), (1, 5, 7, None, None)]
    got = streamed(spark, tmp_path, rows, "stream_id long, ts long, seq long, topic string, value double", lambda e: blend.latest_stream(e, ["a", "b"]), "latest")
    assert {r["seq"]: (r["a"], r["b"]) for r in got.collect()} == {1: (1.0, None), 4: (2.0, 5.0), 5: (None, None), 7: (2.0, 5.0)}


def test_recordings(spark, tmp_path):
    commands = [None, "toggle", None, None, "toggle", None, "toggle", None, "discard", "toggle", "toggle", "toggle", None, "toggle", "discard", "toggle", None]
    rows = [(1, i, i, c) for i, c in enumerate(commands)]
    got = streamed(spark, tmp_path, rows, "stream_id long, ts long, seq long, command string", blend.recordings, "recorded")
    assert [(r["seq"], r["episode"], r["what"]) for r in got.where("what <> 'frame'").orderBy("seq").collect()] == [(4, 0, "saved"), (8, 1, "discarded"), (13, 1, "saved")]
    assert sorted((r["seq"], r["episode"], r["frame_index"]) for r in blend.saved(got).collect()) == [(2, 0, 0), (3, 0, 1), (12, 1, 0)]


def test_windows_and_sessions(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(100).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") + F.when(F.col("id") >= 50, 1000).otherwise(0)).alias("ts"), F.lit(1.0).alias("v")).write.parquet(str(src))
    stream = spark.readStream.schema("k long, ts timestamp, v double").parquet(str(src))
    plans = {"w": (blend.windowed(stream, "ts", "1 minute", "10 seconds", F.sum("v").alias("n")), "complete"), "s": (blend.sessions(stream, "k", "ts", "1 minute", "30 seconds", F.count("*").alias("n")), "complete")}
    for name, (df, mode) in plans.items():
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("w").collect()) == 100.0
    assert sorted(r["n"] for r in spark.table("s").collect()) == [25, 25, 25, 25]
