"""Episodes and frames: order, windows, running offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORDER = "episode_id", "frame_index"


def in_order(key: str = KEY, order: str = ORDER) -> WindowSpec:
    """The frames of an episode in order. All operators use this window, so one exchange serves them all."""
    return Window.partitionBy(key).orderBy(order)


def whole(key: str = KEY, order: str = ORDER) -> WindowSpec:
    return in_order(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def number_frames(df: DataFrame, key: str, *order: str) -> DataFrame:
    """episode_id from a key, and frame_index from an order that has no ties."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).alias(KEY), (F.row_number().over(w) - 1).cast("long").alias(ORDER), *[c for c in df.columns if c != key])


def frame_count(key: str = KEY) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(key))


def episode_summary(frames: DataFrame, ts: str, per_second: float) -> DataFrame:
    """Frames, first and last time, and duration in seconds of each episode."""
    return frames.groupBy(KEY).agg(F.count("*").alias("n_frames"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")).withColumn("duration_s", (F.col("end_ts") - F.col("start_ts")) / per_second)


#: Rows that one range of an order should have.
RANGE_ROWS = 1 << 20


def _ranges(df: DataFrame, order: str, shards: int | None) -> DataFrame:
    """The rows with ``shard__``, the range of the order column that they are in: as many ranges as the rows fill, found by bisection."""
    shards = shards or max(1, -(-df.count() // RANGE_ROWS))
    cuts = sorted(set(df.approxQuantile(order, [i / shards for i in range(1, shards)], min(0.001, 0.1 / shards)))) if shards > 1 else []
    if not cuts:
        return df.withColumn("shard__", F.lit(0))
    from pyspark.ml.feature import Bucketizer

    numbered = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at__", outputCol="shard__", handleInvalid="keep").transform(df.withColumn("at__", F.col(order).cast("double")))
    return numbered.withColumn("shard__", F.col("shard__").cast("int")).drop("at__")


def running_offset(df: DataFrame, order: str, value: str, out: str, shards: int | None = None) -> DataFrame:
    """The sum of ``value`` over all rows before each one, in the order of a numeric column without ties.

    Rows are cut into ranges of the order column, whose few sums are added up first, so no task sees all rows.
    """
    cut = _ranges(df, order, shards)
    sums = cut.groupBy("shard__").agg(F.sum(value).alias("sum__"))
    before = Window.orderBy("shard__").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    base = sums.select("shard__", F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("base__"))
    inside = Window.partitionBy("shard__").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(base), "shard__").withColumn(out, F.col("base__") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("shard__", "base__")


def global_number(df: DataFrame, first: str, *rest: str, out: str = "position", shards: int | None = None) -> DataFrame:
    """The 0-based place of each row in the order (first, *rest), ``first`` being numeric, without one task that sees all rows."""
    cut = _ranges(df, first, shards)
    counts = cut.groupBy("shard__").agg(F.count("*").alias("n__"))
    before = Window.orderBy("shard__").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    base = counts.select("shard__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("base__"))
    inside = Window.partitionBy("shard__").orderBy(first, *rest)
    return cut.join(F.broadcast(base), "shard__").withColumn(out, F.col("base__") + F.row_number().over(inside) - 1).drop("shard__", "base__")


def remap(df: DataFrame, key: str, out: str) -> DataFrame:
    """Keys replaced by 0..k-1 in their order; the key table is numbered, not the rows."""
    keys = global_number(df.select(key).distinct(), key, out=out)
    return df.join(keys, key)
