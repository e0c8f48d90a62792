"""Down-sampling by blocks, strides and gathers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.operators.frames import KEY, ORDER, frame_count


def blocks(frames: DataFrame, ratio: int, *aggregates: Column) -> DataFrame:
    """One row for every ``ratio`` frames; a last block may be shorter. frame_index is the number of the block."""
    block = F.floor(F.col(ORDER) / ratio)
    return frames.groupBy(KEY, block.alias("block__")).agg(*aggregates).withColumnRenamed("block__", ORDER)


def block_mean(col: str) -> Column:
    return F.avg(col).alias(col)


def block_first(col: str) -> Column:
    return F.min_by(col, ORDER).alias(col)


def every(frames: DataFrame, step: int) -> DataFrame:
    """Each ``step``-th frame, numbered anew."""
    return frames.where(F.col(ORDER) % step == 0).withColumn(ORDER, F.floor(F.col(ORDER) / step))


def gather(target: DataFrame, source: DataFrame, factor: int, columns: list[str]) -> DataFrame:
    """For each target frame i the source frame i * factor, or the last one."""
    n = source.withColumn("n__", frame_count()).select(KEY, F.col(ORDER).alias("at__"), "n__", *columns)
    last = source.groupBy(KEY).agg(F.count("*").alias("n__"))
    at = target.join(last, KEY).withColumn("at__", F.least(F.col(ORDER) * factor, F.col("n__") - 1)).drop("n__")
    return at.join(n.drop("n__"), [KEY, "at__"]).drop("at__")


def zip_frames(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames of two tables side by side; episodes whose lengths differ are an error."""
    counts = left.groupBy(KEY).agg(F.count("*").alias("a")).join(right.groupBy(KEY).agg(F.count("*").alias("b")), KEY)
    same = counts.select(KEY, F.when(F.col("a") == F.col("b"), F.lit(True)).otherwise(F.raise_error(F.lit("episodes differ in length")).cast("boolean")).alias("ok__"))
    return left.join(right, [KEY, ORDER]).join(same.where("ok__"), KEY).drop("ok__")
