"""Nearest match in time, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, key: str, ts: str, keep: list[str] | None = None) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time; of two equally near, the earlier.

    Both sides meet in one shuffle and are ordered by (key, time), once forwards and once backwards, so that both
    candidates, the last before and the first not before, are carried along: the work is that of two sorts, with no
    inequality join and no frame that is read again. Every left row stays; where the right side has no row of the key
    the match is null. Of right rows with equal times any one may be the match.
    """
    keep = keep or []
    payload = F.struct(F.col(ts).alias("ts"), *[F.col(c) for c in keep])
    sides = left.select(key, ts, F.lit(1).alias("side__"), F.struct(*left.columns).alias("l__"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("r__"))
    other = right.select(key, ts, F.lit(0).alias("side__"), F.lit(None).cast(sides.schema["l__"].dataType).alias("l__"), payload.alias("r__"))
    # at equal times the right side comes behind the left one going forwards, and before it going backwards
    before = Window.partitionBy(key).orderBy(ts, F.desc("side__")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(F.desc(ts), "side__").rowsBetween(Window.unboundedPreceding, 0)
    both = sides.unionByName(other)
    both = both.withColumn("p__", F.last("r__", True).over(before)).withColumn("n__", F.last("r__", True).over(after)).where("side__ = 1")
    nearer = F.col("p__").isNull() | (F.abs(F.col("n__.ts") - F.col(ts)) < F.abs(F.col("p__.ts") - F.col(ts)))
    pick = F.when(F.col("n__").isNotNull() & nearer, F.col("n__")).otherwise(F.col("p__"))
    return both.withColumn("m__", pick).select("l__.*", F.col("m__.ts").alias("match_ts"), *[F.col(f"m__.{c}").alias(f"match_{c}") for c in keep])


def match_level(diff: Column, warn: float, severe: float) -> Column:
    """severe, warning or ok; both bounds are strict."""
    return F.when(diff > severe, "severe").when(diff > warn, "warning").otherwise("ok")


def match_report(matched: DataFrame, key: str, diff: str, warn: float, severe: float, total: bool = False) -> DataFrame:
    """Counts and differences by episode; with ``total`` a last row over all frames, so its mean is weighted by frames."""
    grouped = matched.rollup(key) if total else matched.groupBy(key)
    level = match_level(F.col(diff), warn, severe)
    return grouped.agg(
        F.count("*").alias("frame_count"),
        F.count_if(level == "warning").alias("warning_count"),
        F.count_if(level == "severe").alias("severe_count"),
        F.avg(diff).alias("avg_diff"),
        F.max(diff).alias("max_diff"),
    )


def flagged(matched: DataFrame, key: str, order: str, diff: str, warn: float, severe: float, top: int = 10) -> DataFrame:
    """The first severe frames of each episode in their order, then warnings, up to ``top``."""
    level = match_level(F.col(diff), warn, severe)
    rank = Window.partitionBy(key).orderBy(F.when(F.col("level") == "severe", 0).otherwise(1), order)
    return matched.withColumn("level", level).where("level <> 'ok'").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
