"""Statistics of vectors by dimension, histogram quantiles, merges and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.arrays import mean_where
from strideframe.schema import HISTOGRAM_BINS


def by_dimension(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    """One row for each element: keys, dim, x."""
    return df.select(*keys, F.posexplode(F.col(vector)).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def running_stats(long: DataFrame, *keys: str) -> DataFrame:
    """Count, mean, population deviation, least and largest of each dimension. One partial and one final aggregation."""
    return long.groupBy(*keys, "dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def histogram(long: DataFrame, bins: int = HISTOGRAM_BINS, *keys: str) -> DataFrame:
    """Counts of equal bins over [min - 1e-10, max + 1e-10] of each dimension; the last bin is closed."""
    ends = long.groupBy(*keys, "dim").agg((F.min("x") - 1e-10).alias("lo"), (F.max("x") + 1e-10).alias("hi"))
    # one row for each dimension and key, as few as the vectors have elements
    binned = long.join(ends, [*keys, "dim"]).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    return binned.groupBy(*keys, "dim", "lo", "w", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantile(hist: DataFrame, q: float, *keys: str) -> DataFrame:
    """The left edge of the first bin up to which at least the share ``q`` of the values lies."""
    by = Window.partitionBy(*keys, "dim")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    reached = hist.withColumn("c", F.sum("n").over(upto)).withColumn("t", F.sum("n").over(by)).where(F.col("c") >= q * F.col("t"))
    return reached.groupBy(*keys, "dim").agg(F.min(F.col("lo") + F.col("bin") * F.col("w")).alias("value"))


def merge_stats(stats: DataFrame, weight: str, *keys: str) -> DataFrame:
    """Statistics of several datasets as one: means and deviations by weight, the outer quantiles."""
    total = F.sum(weight)
    return stats.groupBy(*keys).agg(
        (F.sum(F.col("mean") * F.col(weight)) / total).alias("mean"), (F.sum(F.col("std") * F.col(weight)) / total).alias("std"), F.min("q01").alias("q01"), F.max("q99").alias("q99")
    )


def pooled_deviation(stats: DataFrame, weight: str, *keys: str) -> DataFrame:
    """The deviation of the union, from the parts' means and deviations."""
    total = F.sum(weight)
    mean = F.sum(F.col("mean") * F.col(weight)) / total
    square = F.sum((F.col("std") ** 2 + F.col("mean") ** 2) * F.col(weight)) / total
    return stats.groupBy(*keys).agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"))


def scale_to_unit(col: str, *keys: str) -> Column:
    """Min-max scaling within a group; a constant signal is 0."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(0.0)


def masked_mean(x: Column, mask: Column) -> Column:
    return mean_where(x, mask)


def mean_below(loss: str, limit: float) -> Column:
    """Mean of the values up to a limit, over their count, at least 1."""
    kept = F.col(loss) <= limit
    return F.coalesce(F.sum(F.when(kept, F.col(loss))), F.lit(0.0)) / F.greatest(F.count_if(kept), F.lit(1))


def trimmed_line(df: DataFrame, x: str, y: str, *keys: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Slope and intercept of y over x, of the rows between both quantiles on both sides."""
    cuts = [F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"{c}__") for c in (x, y)]
    bounds = df.groupBy(*keys).agg(*cuts)
    inside = (F.col(x) >= F.col(f"{x}__")[0]) & (F.col(x) <= F.col(f"{x}__")[1]) & (F.col(y) >= F.col(f"{y}__")[0]) & (F.col(y) <= F.col(f"{y}__")[1])
    return df.join(bounds, [*keys]).where(inside).groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n_used"))


def interval_means(df: DataFrame, step: str, every: int, *columns: str) -> DataFrame:
    return df.groupBy(F.floor(F.col(step) / every).alias("interval")).agg(*[F.avg(c).alias(c) for c in columns])


def stage_totals(times: DataFrame, stage: str, seconds: str, *keys: str) -> DataFrame:
    """How often each stage ran, its seconds, and its share of all (of the keys); the shares are of few rows."""
    out = times.groupBy(*keys, stage).agg(F.count(seconds).alias("n"), F.sum(seconds).alias("seconds"))
    total = F.sum("seconds").over(Window.partitionBy(*(keys or [F.lit(1)])))
    return out.withColumn("share", F.when(total > 0, F.col("seconds") / total).otherwise(0.0))
