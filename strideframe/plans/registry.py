"""Registered queries: each with its SQL twin, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.operators.frames import number_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; ``{frames}`` and ``{vectors}`` in the SQL stand for common tables."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.replace("{frames}", FRAMES).replace("{vectors}", VECTORS)
        return fn

    return add


#: Frames of an episode: the events of a user in time.
FRAMES = """f AS (SELECT user_id AS episode_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_index,
 event_id, event_type, value, epoch_us(ts) AS ts_us FROM events)"""
#: Elements of vectors: dim counts from 0.
VECTORS = """v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim FROM embeddings)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return number_frames(events.select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")), "user_id", "ts_us", "event_id")


def pose_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label as the frames of an episode."""
    v = load(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return number_frames(v, "label", "vec_id")


def r6(c) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def s6(x: str) -> str:
    return f"(round({x}, 6) + 0)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})
